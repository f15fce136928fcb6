"""Attribute look-ups: attach, fall-back chains, nearest key, shift joins, overrides, as-of values.

No side is forced to broadcast: dimension sides are aggregates or tables whose size Spark checks against
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits hot keys of the fact side otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import group_agg
from ..functions.numbers import one_row


def attach_attributes(df: DataFrame, dim: DataFrame, key: str, coalesce_cols: list[str] = (),
                      flags: dict[str, str] | None = None, zero: list[str] = ()) -> DataFrame:
    """Left join a unique-key dimension; overlapping columns keep the fact value where it is present.

    ``flags`` adds 0/1 columns from presence of a dimension column; ``zero`` columns are 0 when unmatched.
    """
    d = dim.select(key, *[F.col(c).alias(f"_d_{c}") for c in dim.columns if c != key])
    out = df.join(d, key, "left")
    for c in (c for c in dim.columns if c != key):
        value = F.coalesce(F.col(c), F.col(f"_d_{c}")) if c in coalesce_cols and c in df.columns else F.col(f"_d_{c}")
        out = out.withColumn(c, F.coalesce(value, F.lit(0)) if c in zero else value)
    for name, source in (flags or {}).items():
        out = out.withColumn(name, F.col(f"_d_{source}").isNotNull().cast("int"))
    return out.drop(*[f"_d_{c}" for c in dim.columns if c != key])


def geocode_by_key(df: DataFrame, parcels: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Coordinates from the parcel table; rows without coordinates are dropped."""
    located = parcels.select(key, lat, lon).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return df.join(located, key)


def attach(df: DataFrame, dim: DataFrame, keys: list[str], fill: str | float | None = "median") -> DataFrame:
    """Left join a dimension; its numeric columns fall back to the dimension's median (or a constant)."""
    values = [c for c, t in dim.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    out = df.join(dim, keys, "left")
    if fill is None:
        return out
    if fill == "median":
        mid = one_row(group_agg(dim, [], [], {c: (c, 0.5) for c in values}))
        return out.withColumns({c: F.coalesce(F.col(c), mid[c]) for c in values})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in values})


def join_monthly(df: DataFrame, series: DataFrame, ts: str, series_ts: str, value: str) -> DataFrame:
    """Attach the mean of a finer time series over the row's calendar month."""
    monthly = series.groupBy(F.trunc(series_ts, "MM").alias("_month")).agg(F.avg(value).alias(value))
    return df.withColumn("_month", F.trunc(ts, "MM")).join(monthly, "_month", "left").drop("_month")


def asof_last(df: DataFrame, series: DataFrame, ts: str, series_ts: str, value: str, bucket: str = "DD") -> DataFrame:
    """Latest series value at or before the row's time.

    Facts and series are ordered together by time in slices of the axis (``bucket``: a date part), and inside a slice the
    last value is carried on; the value that enters a slice comes from the short table of the slices' last values. A fact
    row never holds more than one value. ``series`` must have one value per instant.
    """
    s = series.filter(F.col(value).isNotNull()).select(
        F.col(series_ts).cast("timestamp").alias("_t"), F.col(value).alias("_v")).withColumn("_b", F.date_trunc(bucket, "_t"))
    ends = s.groupBy("_b").agg(F.max_by("_v", "_t").alias("_end"))
    fact = df.drop(value).withColumn("_t", F.col(ts).cast("timestamp")).withColumn("_b", F.date_trunc(bucket, "_t"))
    # one row per slice in use
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    entry = fact.select("_b").distinct().join(ends, "_b", "full").withColumn("_entry", F.last("_end", True).over(before)).select("_b", "_entry")
    both = fact.withColumn("_v", F.lit(None).cast(s.schema["_v"].dataType)).withColumn("_fact", F.lit(1)).unionByName(
        s.withColumn("_fact", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("_b").orderBy("_t", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_c", F.last("_v", True).over(upto)).filter("_fact = 1")
    return carried.join(entry, "_b", "left").withColumn(value, F.coalesce("_c", "_entry")).drop("_b", "_t", "_v", "_fact", "_c", "_entry")


def latest_value(series: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: the value of the latest instant."""
    return series.filter(F.col(value).isNotNull()).agg(F.max_by(value, ts).alias(value))


def nearest_key(df: DataFrame, dim: DataFrame, key: str, values: list[str], slices: int = 1024) -> DataFrame:
    """Values of the closest available key (earlier key on a tie).

    Both sides are reduced to their distinct keys. The keys are ordered in slices of equal width (``slices`` of them over the
    dimension's range); the nearest keys beyond a slice come from the slices' ends. Rows join back by key.
    """
    have = dim.select(F.col(key).alias("_k"), F.struct(*values).alias("_v")).filter(F.col("_k").isNotNull())
    asked = df.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    ends = have.agg(F.struct(F.min("_k").cast("double").alias("low"), F.max("_k").cast("double").alias("high"))).scalar()
    at = F.floor((F.col("_k") - ends["low"]) / F.greatest(ends["high"] - ends["low"], F.lit(1e-300)) * slices)
    line = asked.join(have, "_k", "full").withColumns({
        "_own": F.when(F.col("_v").isNotNull(), F.struct("_k", "_v")), "_s": F.coalesce(F.greatest(F.lit(-1), F.least(F.lit(slices + 1), at)), F.lit(0)).cast("int")})
    up = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_s").orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    line = line.withColumns({"_lo": F.last("_own", True).over(up), "_hi": F.first("_own", True).over(down)})
    # at most slices + 3 rows
    edge = line.groupBy("_s").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_k"))).alias("_last"), F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("_k"))).alias("_first"))
    before, after = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_s").rowsBetween(1, Window.unboundedFollowing)
    edge = edge.select("_s", F.last("_last", True).over(before).alias("_below"), F.first("_first", True).over(after).alias("_above"))
    line = line.join(edge, "_s").withColumns({"_lo": F.coalesce("_lo", "_below"), "_hi": F.coalesce("_hi", "_above")})
    below, above = F.col("_k") - F.col("_lo._k"), F.col("_hi._k") - F.col("_k")
    pick = F.when(below.isNull(), F.col("_hi")).when(above.isNull() | (below <= above), F.col("_lo")).otherwise(F.col("_hi"))
    found = line.withColumn("_p", pick).select(F.col("_k").alias(key), *[F.col(f"_p._v.{v}").alias(v) for v in values])
    return df.join(found, key, "left")


def lookup_chain(df: DataFrame, steps: list[tuple[DataFrame, list[str], str]], out: str, default=None) -> DataFrame:
    """First value found along a chain of look-ups (table, keys, value column), else the default."""
    found = []
    for i, (dim, keys, value) in enumerate(steps):
        name = f"_step{i}"
        if keys:
            df = df.join(dim.select(*keys, F.col(value).alias(name)), keys, "left")
        else:
            df = df.withColumn(name, dim.select(value).scalar())
        found.append(F.col(name))
    end = [F.lit(default)] if default is not None else []
    return df.withColumn(out, F.coalesce(*found, *end)).drop(*[f"_step{i}" for i in range(len(steps))])


def shift_join(df: DataFrame, agg: DataFrame, keys: list[str], time_key: str, k: int, rename: dict[str, str]) -> DataFrame:
    """Attach the aggregate of ``k`` periods earlier; periods must be consecutive numbers."""
    moved = agg.select(*keys, (F.col(time_key) + k).alias(time_key), *[F.col(a).alias(b) for a, b in rename.items()])
    return df.join(moved, [*keys, time_key], "left")


def extend_panel(panel: DataFrame, new_rows: DataFrame, key: str, order: str, template: list[str]) -> DataFrame:
    """Append new periods that inherit each key's last non-null template values; unknown keys drop."""
    last = panel.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in template])
    grown = new_rows.drop(*[c for c in template if c in new_rows.columns]).join(last, key)
    return panel.unionByName(grown, allowMissingColumns=True)


def override(df: DataFrame, fresh: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """A fresh snapshot's values win; others keep the old value."""
    f = fresh.select(key, *[F.col(c).alias(f"_f_{c}") for c in cols])
    out = df.join(f, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(c)) for c in cols}).drop(*[f"_f_{c}" for c in cols])


def coalesce_key(df: DataFrame, names: list[str], out: str) -> DataFrame:
    """One key column from alternative key columns, in order; names that are absent are skipped."""
    return df.withColumn(out, F.coalesce(*[F.col(n) for n in names if n in df.columns]))


def keep_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def drop_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def deed_history(master: DataFrame, parcels: DataFrame, doc_id: str) -> DataFrame:
    """Deeds with the parcel key of each legal lot they name."""
    return master.join(parcels, doc_id)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either set with flags for membership in each."""
    left = a.select(key).distinct().withColumn("in_first", F.lit(1))
    right = b.select(key).distinct().withColumn("in_second", F.lit(1))
    return left.join(right, key, "full").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("in_first", "in_second")})


def unseen_periods(df: DataFrame, panel: DataFrame, period: str) -> DataFrame:
    """Rows whose period the panel does not hold yet."""
    return df.join(panel.select(period).distinct(), period, "left_anti")
