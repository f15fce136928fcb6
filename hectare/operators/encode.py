"""Target encodings and one-hot flags; every fit takes the work set explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach
from .quantiles import group_agg, join_groups


def fit_target_encoding(work: DataFrame, keys: list[str], target: Column, k: float = 0.0, where: Column | None = None) -> DataFrame:
    """(keys…, encoded): mean target per key, shrunk towards the global mean by weight ``k``."""
    base = work if where is None else work.filter(where)
    base = base.select(*keys, target.alias("_t"))
    s = base.groupBy(*keys).agg(F.sum("_t").alias("_s"), F.count("_t").alias("_n"))
    if k:
        overall = base.agg(F.avg("_t")).scalar()
        return s.select(*keys, ((F.col("_s") + k * overall) / (F.col("_n") + k)).alias("encoded"))
    return s.select(*keys, (F.col("_s") / F.col("_n")).alias("encoded"))


def apply_encoding(df: DataFrame, encoding: DataFrame, keys: list[str], out: str, unseen: Column) -> DataFrame:
    """Attach a fitted encoding; unseen keys take ``unseen`` (usually the work set's global mean)."""
    e = encoding.select(*keys, F.col("encoded").alias(out))
    return df.join(e, keys, "left").withColumn(out, F.coalesce(F.col(out), unseen))


def global_mean(work: DataFrame, target: Column) -> Column:
    return work.agg(F.avg(target)).scalar()


def oof_encoding(work: DataFrame, fold: str, keys: list[str], target: Column, out: str, k: float = 30.0) -> DataFrame:
    """Encode each row from the other folds only, without a loop over folds.

    Sums per (key, fold) are subtracted from sums per key, and the same for the global mean.
    """
    part = work.groupBy(*keys, fold).agg(F.sum(target).alias("_fs"), F.count(target).alias("_fn"))
    whole = part.groupBy(*keys).agg(F.sum("_fs").alias("_s"), F.sum("_fn").alias("_n"))
    by_fold = part.groupBy(fold).agg(F.sum("_fs").alias("_gfs"), F.sum("_fn").alias("_gfn"))
    total = part.agg(F.struct(F.sum("_fs").alias("s"), F.sum("_fn").alias("n"))).scalar()
    mean = (total["s"] - F.col("_gfs")) / (total["n"] - F.col("_gfn"))
    rest_s, rest_n = F.col("_s") - F.col("_fs"), F.col("_n") - F.col("_fn")
    table = join_groups(join_groups(part, whole, keys), by_fold, [fold])
    coded = F.when(rest_n > 0, (rest_s + k * mean) / (rest_n + k)).otherwise(mean)
    return join_groups(work, table.select(*keys, fold, coded.alias(out)), [*keys, fold])


def region_market(df: DataFrame, work: DataFrame, key: str, psf: str) -> DataFrame:
    """Attach the work set's sale count and median unit price of the region, median-filled for unseen regions."""
    stats = group_agg(work, [key], [F.count(F.lit(1)).alias("region_sales")], {"region_median_psf": (psf, 0.5)})
    return attach(df, stats, [key])


def one_hot(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """0/1 column per name → value; null gives 0 everywhere."""
    return df.withColumns({n: F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for n, v in values.items()})
