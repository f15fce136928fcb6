"""First, latest and top rows per key, samples and top lists.

``row_number() <= n`` lets Spark drop rows above n inside each map task before the shuffle (window group limit), so a
hot key never sends more than n rows per task to its reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import col
from .quantiles import group_agg


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row of each key."""
    return top_per_key(df, keys, order, 1)


def latest_record(df: DataFrame, key: str, order: list) -> DataFrame:
    return top_per_key(df, [key], [F.desc(c) if isinstance(c, str) else c for c in order], 1)


def latest_n(df: DataFrame, key: str, order: str, value: str, n: int = 2, require_all: bool = False) -> DataFrame:
    """The ``n`` latest values per key as columns lag1 … lagn, optionally only for keys that have all of them."""
    top = top_per_key(df, [key], [F.desc(order)], n, rank="_k")
    out = top.groupBy(key).agg(*[F.max(F.when(F.col("_k") == i, F.col(value))).alias(f"lag{i}") for i in range(1, n + 1)])
    return out.filter(F.col(f"lag{n}").isNotNull()) if require_all else out


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the ``n`` latest distinct periods; only the list of periods is ordered."""
    recent = df.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return df.join(recent, period, "left_semi")


def top_groups(df: DataFrame, key: str, value: str, n: int, min_n: int) -> DataFrame:
    """Groups with enough rows, highest median first."""
    stats = group_agg(df, [key], [F.count(F.lit(1)).alias("n_rows")], {"median_value": (value, 0.5)})
    return stats.filter(F.col("n_rows") >= min_n).orderBy(F.desc("median_value"), key).limit(n)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), F.asc(column)).limit(n)


def best_segments(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.asc(metric), *tie).limit(n)


def stable_hash(id_cols: list[str], seed: int) -> Column:
    """Repeatable pseudo-random order of rows that does not depend on partitioning: 60 bits of a digest other engines know too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]).cast("binary")), 1, 15), 16, 10).cast("bigint")


def stratified_sample(df: DataFrame, stratum: list[str], ids: list[str], n: int, order: Column | None = None,
                      seed: int = 42) -> DataFrame:
    """At most ``n`` rows per stratum in a repeatable pseudo-random order."""
    by = stable_hash(ids, seed) if order is None else order
    return top_per_key(df, stratum, [by, *ids], n)


def top_k_per_row(df: DataFrame, array_col: str, k: int, magnitude: str, name: str = "feature") -> DataFrame:
    """Keep the k structs with the largest absolute ``magnitude`` in each row's array, largest first; ties by ``name``."""
    def bigger_first(a, b):
        x, y = F.abs(a[magnitude]), F.abs(b[magnitude])
        return F.when(x > y, -1).when(x < y, 1).when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)

    return df.withColumn(array_col, F.slice(F.array_sort(F.col(array_col), bigger_first), 1, k))


def tile_top_n(df: DataFrame, lat: str, lon: str, lat0: float, lon0: float, step: float, order: list,
               n: int = 30) -> DataFrame:
    """Most recent ``n`` rows of each map tile."""
    tiled = df.withColumns({
        "tile_y": F.floor((F.col(lat) - lat0) / step).cast("int"),
        "tile_x": F.floor((F.col(lon) - lon0) / step).cast("int"),
    })
    return top_per_key(tiled, ["tile_x", "tile_y"], order, n)


def bbox_sample(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], limit: int,
                order: list, ids: list[str]) -> DataFrame:
    """Rows inside a box; when there are more than ``limit``, the first row of each cell of an even grid."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    grid = max(1, int(limit ** 0.5))
    inside = df.filter(F.col(lat).between(lat_lo, lat_hi) & F.col(lon).between(lon_lo, lon_hi))

    def cell(value, lo, hi):
        raw = ((F.col(value) - lo) / ((hi - lo) / grid)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), raw))

    total = inside.agg(F.count(F.lit(1)).alias("n")).scalar()
    celled = inside.withColumns({"_cy": cell(lat, lat_lo, lat_hi), "_cx": cell(lon, lon_lo, lon_hi)})
    # Few enough rows: every row is its own cell, so nothing is dropped and the plan stays the same.
    own = F.when(total <= limit, F.struct(*ids))
    return top_per_key(celled.withColumn("_own", own), ["_cy", "_cx", "_own"], order, 1).drop("_cy", "_cx", "_own")
