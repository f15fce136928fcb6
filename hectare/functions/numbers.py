"""Numeric coercion, safe ratios, bands and unit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import clip
from .geo import col

SQM_PER_SQFT = 0.0929


def to_number(value) -> Column:
    """Number, or null where the text is no number; NaN counts as null."""
    v = F.trim(col(value).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def null_nan(value) -> Column:
    return F.nullif(col(value), F.lit(float("nan")))


def log1p_clip(value, lo: float = 0.0) -> Column:
    return F.log1p(clip(value, lo=lo))


def ratio(numerator, denominator, min_denominator: float | None = None) -> Column:
    """Division with the denominator held at a minimum, or null on a zero denominator when there is none."""
    den = col(denominator)
    den = clip(den, lo=min_denominator) if min_denominator is not None else F.nullif(den, F.lit(0.0))
    return col(numerator) / den


def band(value, breaks: list[float], labels: list[str]) -> Column:
    """Half-open bands: label i holds ``breaks[i-1] <= value < breaks[i]``; the last label is open above."""
    v = col(value)
    out = F
    for limit, label in zip(breaks, labels):
        out = out.when(v < limit, label)
    return out.when(v.isNotNull(), labels[-1])


def versus_band(value, reference, tolerance: float = 0.05) -> Column:
    """'below' / 'near' / 'above' by relative distance from a reference value."""
    rel = col(value) / col(reference) - 1
    return F.when(rel < -tolerance, "below").when(rel > tolerance, "above").when(rel.isNotNull(), "near")


def unit_rates(df: DataFrame, price: str, sqft: str) -> DataFrame:
    """Whole-unit price per square foot and per square metre (half-even); no area gives null."""
    area = F.when(F.col(sqft) > 0, F.col(sqft))
    return df.withColumns({
        "price_per_sqft": F.bround(F.col(price) / area).cast("bigint"),
        "price_per_sqm": F.bround(F.col(price) / (area * SQM_PER_SQFT)).cast("bigint"),
    })


def bbl_key(borough, block, lot) -> Column:
    """Parcel key borough*10^9 + block*10^4 + lot from loosely typed parts; any bad part gives null."""
    parts = [to_number(c).try_cast("bigint") for c in (borough, block, lot)]
    return parts[0] * 1_000_000_000 + parts[1] * 10_000 + parts[2]


def minmax_position(df: DataFrame, value: str, out: str, invert: bool = False) -> DataFrame:
    """Linear position of a value between the column's minimum and maximum; a constant column gives 0.5."""
    ends = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    span = ends["hi"] - ends["lo"]
    t = F.when(span == 0, F.lit(0.5)).otherwise((F.col(value) - ends["lo"]) / span)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), 1 - t if invert else t))


def one_row(totals: DataFrame) -> Column:
    """A one-row aggregate as a struct expression (scalar subquery): no join, nothing to broadcast."""
    return totals.select(F.struct("*").alias("totals")).scalar()
