"""Composite scores and interaction features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import clip
from ..functions.numbers import one_row, ratio
from .aggregates import fit_minmax, minmax
from .joins import lookup_chain
from .quantiles import group_agg

# ---- fixed values: score weights, centres and rules ----
WALK_WEIGHTS = {"transit": 0.35, "bus": 0.15, "amenities": 0.30, "bike": 0.10, "park": 0.10}
CONNECTIVITY_WEIGHTS = {"metro": 0.30, "commercial": 0.25, "bus": 0.20, "metro_inverse": 0.15, "intersections": 0.10}
COMMERCIAL_WEIGHTS = {"hypermarket": 3, "supermarket": 2, "bank": 1, "restaurant": 1, "hotel": 1}
CLASS_RULES = {
    "is_condo": "^R",
    "is_multifamily": "^[CD]",
    "is_single_fam": "^A",
    "is_mixed_use": "^S",
    "has_elevator": "^(D|R[12])",
}
# ---- end of fixed values ----


def walk_parts(transit: str, bus: str, amenities: str, bike: str, park: str, eps: float = 1e-6) -> dict[str, Column]:
    """Raw walkability parts: inverse distances and a count."""
    inv = lambda c: F.lit(1.0) / clip(F.col(c).cast("double"), lo=eps)
    return {"transit": inv(transit), "bus": inv(bus), "amenities": F.col(amenities).cast("double"),
            "bike": inv(bike), "park": inv(park)}


def connectivity_parts(metro: str, commercial: str, bus: str, metro_dist: str, intersections: str) -> dict[str, Column]:
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return {"metro": zero(metro), "commercial": zero(commercial), "bus": zero(bus),
            "metro_inverse": F.coalesce(F.lit(1.0) / clip(metro_dist, lo=1.0), F.lit(0.0)),
            "intersections": zero(intersections)}


def fit_score(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Parameter row for a weighted score: minimum and maximum of every part."""
    return fit_minmax(df.select(*[c.alias(n) for n, c in parts.items()]), list(parts))


def apply_score(df: DataFrame, params: DataFrame, parts: dict[str, Column], weights: dict[str, float], out: str) -> DataFrame:
    """100 × weighted sum of the min-max scaled parts; new data are clipped to the fitted range."""
    p = F.col("_ends")
    total = sum((minmax(parts[n], p, n) * w for n, w in weights.items()), F.lit(0.0))
    return df.withColumn("_ends", one_row(params)).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))).drop("_ends")


def air_score(df: DataFrame, params: DataFrame, pollutants: list[str], out: str = "air_quality_score") -> DataFrame:
    """100 minus the mean scaled pollutant load; params from ``fit_minmax``."""
    p = one_row(params)
    load = sum((minmax(F.col(c), p, c) for c in pollutants), F.lit(0.0)) / len(pollutants)
    return df.withColumn(out, 100 - load * 100)


def commercial_density(df: DataFrame, counts: dict[str, str], weights: dict[str, int] = COMMERCIAL_WEIGHTS,
                       out: str = "commercial_density_score") -> DataFrame:
    return df.withColumn(out, sum((F.col(counts[n]) * w for n, w in weights.items()), F.lit(0)))


def interactions(df: DataFrame, borough: str, crime: str, sqft: str, floors: str, income: str, units: str, land: str,
                 prior: str, core_borough: int = 1) -> DataFrame:
    """Products and ratios of structure, region and history columns."""
    core = (F.col(borough) == core_borough).cast("int")
    fl, area = clip(F.col(floors).cast("double"), lo=1.0), clip(F.col(sqft).cast("double"), lo=1.0)
    return df.withColumns({
        "is_core": core,
        "crime_x_core": F.col(crime) * core,
        "crime_x_rest": F.col(crime) * (1 - core),
        "sqft_per_floor": F.col(sqft) / fl,
        "income_over_crime": F.col(income) / (F.col(crime) + 1.0),
        "density_index": F.col(units) / area * 1000.0,
        "log_sqft_x_floors": F.log1p(area) * F.log1p(fl),
        "log_land": F.log1p(clip(F.col(land).cast("double"), lo=1.0)),
        "lot_coverage": clip(ratio(sqft, F.col(land).cast("double"), 1.0), hi=10.0),
        "volume_proxy": F.log1p(F.col(sqft) * fl),
        "prior_psf": F.col(prior) / area,
    })


def type_interactions(df: DataFrame, type_flags: list[str], columns: list[str]) -> DataFrame:
    return df.withColumns({f"{t}_x_{c}": F.col(t) * F.col(c) for t in type_flags for c in columns})


def structure_features(df: DataFrame, built_year: str, sale_year: int, builtfar: str, facilfar: str, residfar: str,
                       renovated: str, since_renovation: str) -> DataFrame:
    """Age, floor-area utilisation in [0, 5] and renovation fall-backs (never renovated: age)."""
    age = clip(F.lit(sale_year) - F.col(built_year), lo=0)
    allowed = clip(F.coalesce(F.col(facilfar), F.col(residfar)).cast("double"), lo=0.01)
    return df.withColumns({
        "building_age": age,
        "far_utilization": clip(F.col(builtfar) / allowed, 0.0, 5.0),
        renovated: F.coalesce(F.col(renovated), F.lit(0)).cast("int"),
        since_renovation: F.coalesce(F.col(since_renovation), age),
    })


def deviation_from_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value minus its group's median (e.g. region income against its borough)."""
    from .aggregates import group_stat_back

    return group_stat_back(df, keys, value, "_mid").withColumn(out, F.col(value) - F.col("_mid")).drop("_mid")


def asking_premium(df: DataFrame, asking: str, paid: str, out: str = "asking_premium", unknown: float | None = None) -> DataFrame:
    """Asking over paid median; a missing or zero side gives ``unknown``."""
    r = F.nullif(F.col(asking).cast("double"), F.lit(0.0)) / F.nullif(F.col(paid).cast("double"), F.lit(0.0))
    return df.withColumn(out, r if unknown is None else F.coalesce(r, F.lit(unknown)))


def typed_index(df: DataFrame, index: DataFrame, period: str, kind: str, value: str, out: str = "type_index") -> DataFrame:
    """Index of the row's type in its period, else the type's mean, else 100."""
    by_type = index.groupBy(kind).agg(F.avg(value).alias(value))
    return lookup_chain(df, [(index, [period, kind], value), (by_type, [kind], value)], out, 100.0)


def vs_city(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median per district and its relative distance from the median over all rows."""
    city = group_agg(df, [], [], {"m": (value, 0.5)}).scalar()
    s = group_agg(df, [key], [F.count(F.lit(1)).alias("volume")], {"median_price": (value, 0.5)})
    return s.withColumn("vs_city", F.col("median_price") / city - 1)
