"""Filters, trimming, clipping, schema alignment, audits and record validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import clip
from ..functions.numbers import null_nan, one_row, to_number
from .quantiles import group_agg

# ---- fixed values: study areas (lat_lo, lat_hi, lon_lo, lon_hi) and price bounds ----
NYC_BOX = (40.45, 40.95, -74.30, -73.70)
RIYADH_BOX = (23.5, 26.0, 45.5, 48.0)
MIN_SALE_PRICE = 10_000
LISTING_PRICE = (100_000, 50_000_000)
LISTING_PSQM = (300, 40_000)
LISTING_AREA = {"apartment": (20, 1_000), "villa": (50, 5_000), "plot": (50, 50_000), "building": (50, 20_000)}
# ---- end of fixed values ----


def valid_sales(df: DataFrame, price: str, lat: str, lon: str, min_price: float = MIN_SALE_PRICE) -> DataFrame:
    """Sales with coordinates and a price above the minimum, after numeric coercion of all three."""
    fixed = df.withColumns({c: to_number(c) for c in (price, lat, lon)})
    return fixed.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(price) > min_price))


def in_bbox(lat, lon, box: tuple[float, float, float, float], inclusive: bool = True) -> Column:
    y, x = F.col(lat), F.col(lon)
    if inclusive:
        return y.between(box[0], box[1]) & x.between(box[2], box[3])
    return (y > box[0]) & (y < box[1]) & (x > box[2]) & (x < box[3])


def clean_panel(df: DataFrame, city_col: str, city: str, type_col: str, types: list[str], count_col: str,
                price_col: str, district_col: str, min_count: int = 3) -> DataFrame:
    """One city's residential panel rows with enough deeds, a positive price and a real district name."""
    return df.filter(
        (F.col(city_col) == city) & F.col(type_col).isin(types) & (F.col(count_col) >= min_count)
        & (F.col(price_col) > 0) & F.col(district_col).isNotNull() & ~F.col(district_col).isin("NULL", "")
    )


def sane_range(df: DataFrame, value: str, lo: float, hi: float, bounds: str = "[]") -> DataFrame:
    """Keep rows whose value lies in the range; ``bounds`` says which ends are closed, e.g. ``(]``."""
    v = F.col(value)
    low = v >= lo if bounds[0] == "[" else v > lo
    high = v <= hi if bounds[1] == "]" else v < hi
    return df.filter(low & high)


def plausible_listings(df: DataFrame, price: str, area: str, kind: str,
                       areas: dict[str, tuple[float, float]] = LISTING_AREA,
                       price_range=LISTING_PRICE, psqm_range=LISTING_PSQM) -> DataFrame:
    """Listings with believable price, price per m² and an area that fits the property type; unknown types drop."""
    fits = reduce(lambda a, b: a | b, [(F.col(kind) == t) & F.col(area).between(lo, hi) for t, (lo, hi) in areas.items()])
    psqm = F.bround(F.col(price) / F.col(area), 2)
    return df.filter(F.col(price).between(*price_range) & psqm.between(*psqm_range) & fits)


def standardise_type(df: DataFrame, kind: str, use: str, rules: dict[str, list[str]], land: str, land_label: str,
                     residential: str) -> DataFrame:
    """Canonical type; land counts only when its use is residential. Rows without a canonical type drop."""
    out = F
    for label, names in rules.items():
        out = out.when(F.col(kind).isin(names), label)
    out = out.when((F.col(kind) == land) & (F.col(use) == residential), land_label)
    return df.withColumn("std_type", out).filter(F.col("std_type").isNotNull())


def trim_percentiles(df: DataFrame, values: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Drop rows outside the [lo, hi] quantiles of the whole set, per column."""
    q = {f"{v}_{i}": (v, p) for v in values for i, p in (("lo", lo), ("hi", hi))}
    cuts = one_row(group_agg(df, [], [], q))
    return df.filter(reduce(lambda a, b: a & b, [F.col(v).between(cuts[f"{v}_lo"], cuts[f"{v}_hi"]) for v in values]))


def fit_winsor(work: DataFrame, values: list[str], p: float = 0.99) -> DataFrame:
    """One row of upper caps, taken from the work set only."""
    return group_agg(work, [], [], {f"{v}_cap": (v, p) for v in values})


def apply_winsor(df: DataFrame, caps: DataFrame, values: list[str]) -> DataFrame:
    """Clip the upper tail at the fitted caps; null stays null."""
    c = one_row(caps)
    return df.withColumns({v: F.when(F.col(v).isNotNull(), F.least(F.col(v), c[f"{v}_cap"])) for v in values})


def validate_batch(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (ok, rejected); rejected rows carry the texts of all rules they break.

    A rule is text → condition that must be true; null counts as broken.
    """
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in rules.items()]))
    marked = df.withColumn("errors", errors)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def subject_rules(required: list[str], ranges: dict[str, tuple[float, float]], positive: list[str] = (),
                  allowed: dict[str, list] | None = None, optional: list[str] = ()) -> dict[str, Column]:
    """Rules for ``validate_batch``: presence, ranges, positivity and allowed values; optional columns may be null."""
    rules = {f"{c} is missing": F.col(c).isNotNull() for c in required}

    def or_absent(c: str, cond: Column) -> Column:
        return cond | F.col(c).isNull()

    for c, (lo, hi) in ranges.items():
        rules[f"{c} is not in {lo}..{hi}"] = or_absent(c, F.col(c).between(lo, hi))
    for c in positive:
        rules[f"{c} is not positive"] = or_absent(c, F.col(c) > 0)
    for c, values in (allowed or {}).items():
        rules[f"{c} is not known"] = or_absent(c, F.col(c).isin(values))
    return rules


def align_to(df: DataFrame, target: T.StructType, medians: DataFrame | None = None) -> DataFrame:
    """Select the target columns in order and type; a missing number takes the median, a missing text ''."""
    fill = one_row(medians) if medians is not None else None
    have_median = set(medians.columns) if medians is not None else set()

    def pick(f: T.StructField) -> Column:
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.lit("").alias(f.name)
        value = fill[f.name] if f.name in have_median else F.lit(None)
        return value.cast(f.dataType).alias(f.name)

    return df.select(*[pick(f) for f in target.fields])


def feature_matrix(df: DataFrame, names: list[str], keep: list[str] = (), vector: bool = False) -> DataFrame:
    """Ordered, de-duplicated, present features as doubles with null and NaN set to 0."""
    present = list(dict.fromkeys(n for n in names if n in df.columns))
    out = df.select(*keep, *[F.coalesce(null_nan(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in present])
    if not vector:
        return out
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=present, outputCol="features").transform(out)


def audit_nulls(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(column, null_share) for columns above the threshold, all columns in one pass."""
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        hit = F.col(c).isNull()
        return hit | F.isnan(c) if kinds[c] in ("double", "float") else hit

    shares = df.agg(*[F.avg(missing(c).cast("double")).alias(c) for c in df.columns])
    return shares.unpivot([], list(df.columns), "column", "null_share").filter(F.col("null_share") > threshold)


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, min, median, p90, max) for numeric columns."""
    aggs, q = [], {}
    for c in columns:
        aggs += [F.count(c).alias(f"{c}|n"), F.min(F.col(c).cast("double")).alias(f"{c}|min"),
                 F.max(F.col(c).cast("double")).alias(f"{c}|max")]
        q |= {f"{c}|median": (c, 0.5), f"{c}|p90": (c, 0.9)}
    wide = group_agg(df, [], aggs, q)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("n", "min", "median", "p90", "max")])
                     for c in columns])
    return wide.select(F.inline(rows))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are in both sets, only in the first, only in the second."""
    left = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                    F.count_if(F.col("_b").isNull()).alias("n_only_first"),
                    F.count_if(F.col("_a").isNull()).alias("n_only_second"))


def clip_columns(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in limits.items()})


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing in one source are null, differing types are widened to double or text."""
    types: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            types.setdefault(name, set()).add(kind)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    common = {n: ("double" if k <= numeric else "string") for n, k in types.items() if len(k) > 1}
    fixed = [f.withColumns({n: F.col(n).cast(t) for n, t in common.items() if n in f.columns}) for f in frames]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), fixed)
