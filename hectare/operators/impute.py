"""Imputation: ratios, non-zero medians, hierarchical fills and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import clip
from ..functions.numbers import null_nan, one_row
from .quantiles import group_agg, join_groups


def fit_ratio_impute(work: DataFrame, numerator: str, denominator: str, by: str) -> DataFrame:
    """Median ratio per group and over all (``global_ratio``) from rows where both sides are positive."""
    both = work.filter((F.col(numerator) > 0) & (F.col(denominator) > 0)).select(
        by, (F.col(numerator) / F.col(denominator)).alias("_r"))
    overall = group_agg(both, [], [], {"m": ("_r", 0.5)}).scalar()
    return group_agg(both, [by], [], {"ratio": ("_r", 0.5)}).withColumn("global_ratio", overall)


def apply_ratio_impute(df: DataFrame, ratios: DataFrame, numerator: str, denominator: str, by: str) -> DataFrame:
    """Missing or zero numerators become denominator × ratio where the denominator is positive."""
    overall = ratios.agg(F.max("global_ratio")).scalar()
    out = join_groups(df, ratios.select(by, "ratio"), [by])
    gap = (F.col(numerator).isNull() | (F.col(numerator) == 0)) & (F.col(denominator) > 0)
    guess = F.col(denominator) * F.coalesce(F.col("ratio"), overall)
    return out.withColumn(numerator, F.when(gap, guess).otherwise(F.col(numerator))).drop("ratio")


def nonzero_median(work: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median of each column over its non-null, non-zero values."""
    return group_agg(work, [], [], {c: (F.nullif(F.col(c).cast("double"), F.lit(0.0)), 0.5) for c in columns})


def fill_with(df: DataFrame, fill: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN take the fitted value."""
    f = one_row(fill)
    return df.withColumns({c: F.coalesce(null_nan(F.col(c).cast("double")), f[c]) for c in columns})


def fill_chain(df: DataFrame, column: str, by: list[list[str]], default: float | None = None,
               work: DataFrame | None = None) -> DataFrame:
    """Null takes the median of the first key list that has one, then the global median, then the default."""
    fit = df if work is None else work
    steps = [F.col(column)]
    out = df
    for i, keys in enumerate(by):
        out = join_groups(out, group_agg(fit.select(*keys, column), keys, [], {f"_m{i}": (column, 0.5)}), keys)
        steps.append(F.col(f"_m{i}"))
    steps.append(group_agg(fit.select(column), [], [], {"m": (column, 0.5)}).scalar())
    if default is not None:
        steps.append(F.lit(default))
    return out.withColumn(column, F.coalesce(*steps)).drop(*[f"_m{i}" for i in range(len(by))])


def quality_rules(df: DataFrame, area: str, floors: str, age: str, score: str, far: str, building: str, borough: str, work: DataFrame | None = None) -> DataFrame:
    """Area and floors from their class in the borough, age capped at 200, score from the borough, missing FAR 0.

    Medians come from ``work`` (all rows, if it is not given).
    """
    fit = df if work is None else work
    out = fill_chain(df, area, [[building, borough]], work=fit)
    out = fill_chain(out, floors, [[building, borough]], work=fit)
    out = fill_chain(out, score, [[borough]], work=fit)
    return out.withColumns({age: clip(age, 0, 200), far: F.coalesce(F.col(far), F.lit(0.0))})


def fill_from_dim(df: DataFrame, dim: DataFrame, key: str, counts: list[str], prices: list[str]) -> DataFrame:
    """Left join district figures: missing counts are 0, missing prices the median over districts."""
    mid = one_row(group_agg(dim, [], [], {p: (p, 0.5) for p in prices}))
    out = df.join(dim.select(key, *counts, *prices), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
                           | {p: F.coalesce(F.col(p), mid[p]) for p in prices})
