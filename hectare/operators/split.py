"""Time hold-outs, group folds and repeatable splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .quantiles import join_groups, value_at_rank
from .ranking import stable_hash


def time_split(df: DataFrame, ts: str, ids: str, fraction: float) -> DataFrame:
    """Flag ``holdout`` on the last ``fraction`` of rows by (ts, id), exactly ``floor(n × fraction)`` of them.

    Rows are counted once per instant and the counts stored; the cut instant and the first held id inside it are found from counts of
    equal stretches, so nothing is sorted or joined. ``ids`` is one unique numeric column.
    """
    instant = F.unix_micros(F.col(ts).cast("timestamp"))
    path = scratch_path(df.sparkSession, "instants")
    df.groupBy(instant.alias("instant")).agg(F.count(F.lit(1)).alias("n")).filter("instant IS NOT NULL").write.parquet(path)
    counts = df.sparkSession.read.schema("instant bigint, n bigint").parquet(path)
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = value_at_rank(counts, "instant", size - int(math.floor(size * fraction)), weight="n")
    if found is None:  # nothing is held out, or there are no rows
        return df.withColumn("holdout", F.lit(0))
    cut, before = found
    first_id, _ = value_at_rank(df.filter(instant == cut), ids, size - int(math.floor(size * fraction)) - before)
    hold = (instant > cut) | ((instant == cut) & (F.col(ids) >= first_id))
    return df.withColumn("holdout", F.coalesce(hold.cast("int"), F.lit(0)))


def cutoff_split(df: DataFrame, period: str, cutoff: int) -> DataFrame:
    return df.withColumn("holdout", F.coalesce((F.col(period) >= cutoff).cast("int"), F.lit(0)))


def position_cutoff(df: DataFrame, period: str, fraction: float) -> DataFrame:
    """One row: the period standing at ``fraction`` of the sorted distinct periods."""
    p = df.select(period).filter(F.col(period).isNotNull()).distinct()
    n = p.agg(F.count(F.lit(1))).scalar()
    ranked = p.withColumn("_k", F.row_number().over(Window.orderBy(period)) - 1)
    return ranked.filter(F.col("_k") == F.floor(n * F.lit(fraction))).select(F.col(period).alias("cutoff"))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n_rows, fold): whole groups, largest first, dealt to the folds back and forth; null groups are one group UNK.

    Groups of one size are ordered by a digest of their name. Ranks come from counts per size, then per cell of the digest, so one rule
    serves any number of groups and none of them reaches the driver.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit("UNK"))
    sizes = df.groupBy(name.alias(group)).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.withColumn("_d", F.md5(F.encode(group, "UTF-8"))).withColumn("_cell", F.substring("_d", 1, 3))
    cells = sizes.groupBy("n_rows", "_cell").agg(F.count(F.lit(1)).alias("_g"))
    # one row per distinct size
    larger = cells.groupBy("n_rows").agg(F.sum("_g").alias("_g")).select("n_rows", (F.sum("_g").over(Window.orderBy(F.desc("n_rows"))) - F.col("_g")).alias("_larger"))
    upto = F.sum("_g").over(Window.partitionBy("n_rows").orderBy("_cell")) - F.col("_g")
    starts = cells.select("n_rows", "_cell", upto.alias("_upto")).join(larger, "n_rows").select("n_rows", "_cell", (F.col("_larger") + F.col("_upto")).alias("_start"))
    within = Window.partitionBy("n_rows", "_cell").orderBy("_d", group)
    ranked = sizes.join(starts, ["n_rows", "_cell"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    at = F.pmod(F.col("_rank"), F.lit(k))
    forth = F.floor(F.col("_rank") / k) % 2 == 0
    return ranked.select(group, "n_rows", F.when(forth, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def attach_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    name = F.coalesce(F.col(group).cast("string"), F.lit("UNK"))
    f = folds.select(F.col(group).alias("_g"), "fold")
    return df.withColumn("_g", name).join(f, "_g", "left").drop("_g")


def hash_split(df: DataFrame, ids: list[str], fraction: float, seed: int = 42, bucket: Column | None = None) -> DataFrame:
    """Flag a repeatable share of rows, whatever the partitioning; ``bucket`` replaces the hash (0 … 9999)."""
    b = F.pmod(stable_hash(ids, seed), F.lit(10_000)) if bucket is None else bucket
    return df.withColumn("picked", (b < int(round(fraction * 10_000))).cast("int"))


def stratified_split(df: DataFrame, strata: list[str], ids: list[str], fraction: float, seed: int = 42,
                     bucket: Column | None = None) -> DataFrame:
    """Per stratum, flag close to ``fraction`` of the rows by hash bucket.

    Buckets are counted per stratum and taken in order while they stay within the share; no stratum is sorted by row.
    """
    b = F.pmod(stable_hash(ids, seed), F.lit(10_000)) if bucket is None else bucket
    tagged = df.withColumn("_b", b)
    n = tagged.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*strata).orderBy("_b"))
    total = F.sum("_c").over(Window.partitionBy(*strata))
    taken = n.withColumn("picked", (upto <= total * F.lit(fraction)).cast("int")).drop("_c")
    return join_groups(tagged, taken, [*strata, "_b"]).drop("_b")
