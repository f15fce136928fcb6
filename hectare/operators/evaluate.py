"""Error metrics, segment tables, confidence, quality flags and acceptance checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import band, one_row
from ..session import stored
from .quantiles import group_agg, join_groups

# ---- fixed values: price tiers, grades and flag limits ----
TIER_BREAKS = [500_000, 1_000_000, 3_000_000, 10_000_000]
TIER_LABELS = ["<$500K", "$500K–1M", "$1M–3M", "$3M–10M", ">$10M"]
GRADES = [(85, "A"), (75, "B"), (65, "C")]
LOWEST_GRADE = "D"
QC_SPARSE_COMPS = 5
QC_LUXURY_PRICE = 3_000_000
QC_UNCERTAIN_PCT = 30.0
QC_METRO_PRICE = 1_000_000
# ---- end of fixed values ----


def price_tier(price: str) -> Column:
    return band(price, TIER_BREAKS, TIER_LABELS)


def _ape(actual: str, predicted: str, floor: float | None) -> Column:
    base = F.greatest(F.col(actual), F.lit(floor)) if floor is not None else F.nullif(F.col(actual), F.lit(0.0))
    return F.abs(F.col(predicted) - F.col(actual)) / base * 100


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str] = (), floor: float | None = 1.0) -> DataFrame:
    """R² in log space, mean absolute error and median absolute percentage error, per group, in one pass.

    ``floor`` bounds the denominator of the percentage error from below; None divides by the actual value.
    """
    y, p = F.log1p(actual), F.log1p(predicted)
    sse = F.sum((y - p) * (y - p))
    s = group_agg(df, list(by), [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"),
        (1 - sse / F.nullif(F.regr_sxx(y, y), F.lit(0.0))).alias("r2_log"),
    ], {"medape": (_ape(actual, predicted, floor), 0.5)})
    return s


def segment_metrics(df: DataFrame, actual: str, predicted: str, segments: dict[str, Column], min_n: int = 10,
                    floor: float | None = 1.0) -> DataFrame:
    """The same metrics for several segmentations plus the whole, from one scan: rows (segment_kind, segment, …)."""
    kinds = [F.struct(F.lit("all").alias("segment_kind"), F.lit("all").alias("segment"))] + [
        F.struct(F.lit(k).alias("segment_kind"), c.cast("string").alias("segment")) for k, c in segments.items()]
    long = df.select(actual, predicted, F.explode(F.array(*kinds)).alias("s")).select(actual, predicted, "s.*")
    return metrics(long, actual, predicted, ["segment_kind", "segment"], floor).filter(F.col("n") >= min_n)


def confidence(df: DataFrame, price: str, borough: str, errors: DataFrame) -> DataFrame:
    """Interval, score and grade from the worse of the borough's and the price tier's error.

    ``errors`` is a table (segment_kind in all/borough/tier, segment, medape); a missing segment takes the overall error.
    """
    errors, _ = stored(errors.select("segment_kind", "segment", "medape"), "segment-errors")  # read three times below
    overall = errors.filter(F.col("segment_kind") == "all").agg(F.max("medape")).scalar()
    pick = lambda kind, name: errors.filter(F.col("segment_kind") == kind).select(
        F.col("segment").alias(f"_{kind}"), F.col("medape").alias(name))
    out = df.withColumns({"_borough": F.col(borough).cast("string"), "tier": price_tier(price)}).withColumn("_tier", F.col("tier"))
    out = out.join(pick("borough", "_eb"), "_borough", "left").join(pick("tier", "_et"), "_tier", "left")
    worst = F.greatest(F.coalesce("_eb", overall), F.coalesce("_et", overall))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - worst).cast("int")))
    grade = F
    for limit, letter in GRADES:
        grade = grade.when(F.col("confidence_score") >= limit, letter)
    return out.withColumn("segment_medape", F.bround(worst, 2)).withColumns({
        "confidence_score": score,
        "confidence_low": F.bround(F.col(price) * (1 - F.col("segment_medape") / 100)).cast("bigint"),
        "confidence_high": F.bround(F.col(price) * (1 + F.col("segment_medape") / 100)).cast("bigint"),
    }).withColumn("confidence_grade", grade.otherwise(LOWEST_GRADE)).drop("_borough", "_tier", "_eb", "_et")


def clamp_interval(df: DataFrame, unit_price: str, error_pct: Column, lo: float = 10.0, hi: float = 50.0) -> DataFrame:
    """Interval from a district's error held between ``lo`` and ``hi`` percent; ends are truncated to whole units."""
    e = F.greatest(F.lit(lo), F.least(F.lit(hi), error_pct))
    return df.withColumns({
        "conf_pct": e,
        "conf_low": (F.col(unit_price) * (1 - e / 100)).cast("bigint"),
        "conf_high": (F.col(unit_price) * (1 + e / 100)).cast("bigint"),
    })


def qc_flags(df: DataFrame, comps: str, price: str, error_pct: str, borough: str) -> DataFrame:
    """Array column of quality-control flags in fixed order."""
    p = F.col(price)
    flags = {
        "SPARSE_MARKET": F.col(comps) < QC_SPARSE_COMPS,
        "LUXURY_SEGMENT": p > QC_LUXURY_PRICE,
        "HIGH_UNCERTAINTY": F.col(error_pct) > QC_UNCERTAIN_PCT,
        "METRO_CORE": (F.col(borough) == 1) & (p > QC_METRO_PRICE),
    }
    return df.withColumn("qc_flags", F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])))


def validate_market(df: DataFrame, predicted: str, asking: str, by: list[str]) -> DataFrame:
    """Predicted against asking unit prices per segment: median error, means, share within 20 %."""
    ape = F.abs(F.col(predicted) - F.col(asking)) / F.col(asking) * 100
    rows = df.filter(F.col(asking) > 0).withColumn("_ape", ape)
    return group_agg(rows, by, [
        F.count(F.lit(1)).alias("n"), F.avg(asking).alias("mean_asking"), F.avg(predicted).alias("mean_predicted"),
        F.avg(F.abs(F.col(predicted) - F.col(asking))).alias("mean_abs_error"),
        F.avg((F.col("_ape") <= 20).cast("double")).alias("within_20pct")], {"medape": ("_ape", 0.5)})


def accept_model(old: DataFrame, new: DataFrame, metric: str = "r2_log", tolerance: float = 0.002) -> DataFrame:
    """One row: both scores and whether the new model is kept."""
    o, n = old.agg(F.max(metric)).scalar(), new.agg(F.max(metric)).scalar()
    return new.limit(1).select(o.alias("old_score"), n.alias("new_score"), (n >= o - tolerance).cast("int").alias("accepted"))


def shift_check(df: DataFrame, predicted: str, baseline: str, factor: float = 3.0, spread: float = 1.5) -> DataFrame:
    """Has the distribution of predictions moved? One row per check with its value and outcome."""
    q = one_row(group_agg(df, [], [F.min(predicted).alias("lo")], {
        "p25": (predicted, 0.25), "p50": (predicted, 0.5), "p75": (predicted, 0.75), "base": (baseline, 0.5)}))
    row = lambda name, value, ok: F.struct(F.lit(name).alias("check"), value.alias("value"), ok.cast("int").alias("passed"))
    ratio = q["p50"] / q["base"]
    checks = F.array(row("median_ratio", ratio, ratio.between(1 / factor, factor)),
                     row("quartile_spread", q["p75"] / q["p25"], q["p75"] >= spread * q["p25"]),
                     row("positive", q["lo"], q["lo"] > 0))
    return df.sparkSession.range(1).select(F.inline(checks))


def check_pins(df: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Compare values with pinned ones: (key, value, pinned, tolerance_pct) → within tolerance or not."""
    out = expected.join(df.select(key, value), key, "left")
    off = F.abs(F.col(value) / F.col("pinned") - 1) * 100
    return out.withColumns({"deviation_pct": off, "passed": F.coalesce((off <= F.col("tolerance_pct")).cast("int"), F.lit(0))})


def blend_segment(df: DataFrame, base: str, special: str, threshold: float, out: str) -> DataFrame:
    """Glide from the main to the special model between the threshold and twice the threshold."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(base) - threshold) / threshold))
    return df.withColumn(out, (1 - a) * F.col(base) + a * F.col(special))


def district_errors(df: DataFrame, actual: str, predicted: str, district: str) -> DataFrame:
    return metrics(df, actual, predicted, [district], None).select(district, "medape", "n")


def attach_error(df: DataFrame, errors: DataFrame, district: str, overall: Column, out: str = "district_medape") -> DataFrame:
    e = errors.select(district, F.col("medape").alias(out))
    return join_groups(df, e, [district]).withColumn(out, F.coalesce(F.col(out), overall))
