"""Lags, momentum, look-back means, index changes and sale histories.

Lags are taken on aggregated (key, period) tables by shifting the period and joining. Histories of single rows are dealt
by ranges of the order, so that a key with very many rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import clip, years_between
from ..functions.numbers import one_row
from ..session import stored
from .joins import shift_join
from .ordered import previous_row
from .quantiles import group_agg, join_groups, quantile_sets
from .ranking import top_per_key


def lag_by_calendar(df: DataFrame, work: DataFrame, keys: list[str], period: str, means: dict[str, str],
                    medians: dict[str, str], ks: list[int], counts: bool = True) -> DataFrame:
    """Attach statistics of the calendar period k earlier, fitted on ``work`` only.

    A period without data falls back to the median of the statistic over all (key, period) cells. Output columns are
    ``<name>_lag<k>``; ``means``/``medians`` map a name to its column.
    """
    aggs = [F.avg(c).alias(n) for n, c in means.items()] + ([F.count(F.lit(1)).alias("n")] if counts else [])
    # every lag and the fall-back read the fitted table: it is stored
    stats, _ = stored(group_agg(work, [*keys, period], aggs, {n: (c, 0.5) for n, c in medians.items()}), "period-stats")
    names = [*means, *medians, *(["n"] if counts else [])]
    usual = one_row(group_agg(stats, [], [], {n: (n, 0.5) for n in names}))
    for k in ks:
        df = shift_join(df, stats, keys, period, k, {n: f"{n}_lag{k}" for n in names})
    # one subquery for all columns; its fields are read from a column so that the plan holds it once
    out = df.withColumn("_usual", usual)
    return out.withColumns({f"{n}_lag{k}": F.coalesce(F.col(f"{n}_lag{k}").cast("double"), F.col(f"_usual.{n}")) for k in ks for n in names}).drop("_usual")


def sequence_numbers(df: DataFrame, period: str) -> DataFrame:
    """(period, seq): position of each distinct period; only the list of periods is ordered in one task."""
    return df.select(period).filter(F.col(period).isNotNull()).distinct().withColumn(
        "seq", F.row_number().over(Window.orderBy(period)))


def lag_by_sequence(df: DataFrame, keys: list[str], period: str, value: str, ks: list[int], stat: str = "median",
                    work: DataFrame | None = None) -> DataFrame:
    """Attach a statistic of the k-th previous period of the period list; null where the key had none.

    Periods and statistics come from ``work`` (all rows, if it is not given); rows of other periods get nulls.
    """
    fit = df if work is None else work
    seq = sequence_numbers(fit, period)
    if stat == "median":
        stats = group_agg(fit.select(*keys, period, value), [*keys, period], [], {"_s": (value, 0.5)})
    else:
        fn = {"std": F.stddev_samp, "mean": F.avg, "count": F.count}[stat]
        stats = fit.groupBy(*keys, period).agg(fn(value).alias("_s"))
    numbered = stats.join(seq, period).select(*keys, "seq", "_s")
    out = df.join(seq, period, "left")
    for k in ks:
        out = shift_join(out, numbered, keys, "seq", k, {"_s": f"{value}_lag{k}_{stat}"})
    return out.drop("seq")


def momentum(later: str, earlier: str) -> Column:
    return F.col(later) - F.col(earlier)


def expanding_past_mean(df: DataFrame, key: str, period: str, value: str, out: str, where: Column | None = None,
                        work: DataFrame | None = None) -> DataFrame:
    """Mean over the key's earlier periods of the period means; no past gives the overall mean of ``work``.

    The window runs over one row per (key, period), not over the rows.
    """
    base = df if where is None else df.filter(where)
    cells = base.groupBy(key, period).agg(F.avg(value).alias("_m"))
    past = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(out, F.avg("_m").over(past)).drop("_m")
    fit = df if work is None else work
    usual = (fit if where is None else fit.filter(where)).agg(F.avg(value)).scalar()
    return df.join(cells, [key, period], "left").withColumn(out, F.coalesce(F.col(out), usual))


def period_mean(df: DataFrame, period: str, value: str, out: str) -> DataFrame:
    return df.join(df.groupBy(period).agg(F.avg(value).alias(out)), period, "left")


def index_change(index: DataFrame, order: str, value: str, offsets: dict[str, int]) -> DataFrame:
    """Relative change of an index (one row per period) against the row ``offset`` earlier; the first rows get 0."""
    w = Window.orderBy(order)
    return index.withColumns({
        n: F.coalesce(F.col(value) / F.lag(value, k).over(w) - 1, F.lit(0.0)) for n, k in offsets.items()})


def index_change_calendar(index: DataFrame, period: str, value: str, offsets: dict[str, int]) -> DataFrame:
    """The same against the calendar period ``offset`` earlier (dense period numbers); a missing period gives null."""
    out = index
    for n, k in offsets.items():
        out = shift_join(out, index, [], period, k, {value: "_old"}).withColumn(n, F.col(value) / F.col("_old") - 1).drop("_old")
    return out


def previous_in_key(df: DataFrame, key: str, ts: str, ids: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """The previous row's columns within a key, ordered by (ts, ids).

    A plain ``lag`` orders a whole key in one task. Here rows are dealt by ranges of (key, ts, ids), so neither a hot key nor a hot
    instant lands in one task.
    """
    row = F.struct(F.col(ts).alias("_pt"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    out = previous_row(df, key, [ts, *ids], row, "_best")
    return out.withColumns({f"{prefix}{c}": F.col(f"_best._p_{c}") for c in cols} | {f"{prefix}ts": F.col("_best._pt")}).drop("_best")


def prior_sale(df: DataFrame, parcel: str, ts: str, price: str, ids: list[str]) -> DataFrame:
    """Prior sale of the same parcel: price, years since, clipped appreciation, flip (< 2 years) and presence flags.

    Rows without a parcel key have no history.
    """
    out = previous_in_key(df, parcel, ts, ids, [price], "prior_")
    years = years_between(ts, "prior_ts", lo=0.0)
    old = F.when(F.col(f"prior_{price}") > 0, F.col(f"prior_{price}"))
    return out.withColumns({
        "years_since_prior": years,
        "appreciation": clip(F.col(price) / old - 1, -0.9, 10.0),
        "has_prior": F.col("prior_ts").isNotNull().cast("int"),
        "is_flip": F.coalesce((years < 2).cast("int"), F.lit(0)),
    })


def second_latest_deed(df: DataFrame, parcel: str, ts: str, ids: list[str], cols: list[str]) -> DataFrame:
    """The second most recent deed of each parcel that has one."""
    ranked = top_per_key(df.select(parcel, ts, *ids, *cols), [parcel], [F.desc(ts), *ids], 2, rank="_k")
    return ranked.filter(F.col("_k") == 2).drop("_k")


def loo_mean(work: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mean of the key's other rows; a key with one row, or no key, gives null."""
    s = work.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    other = (F.col("_s") - F.col(value)) / (F.col("_n") - 1)
    return work.join(s, key, "left").withColumn(out, F.when(F.col("_n") >= 2, other)).drop("_s", "_n")


def apply_history(df: DataFrame, work: DataFrame, key: str, value: str, out: str, region: str) -> DataFrame:
    """Median of the work set's rows with the same key, else of the same region, else of all."""
    found = quantile_sets(work, {"own": [key], "near": [region], "all": []}, value, {"_m": 0.5})
    own, near = (found[name].withColumnRenamed("_m", f"_{name}") for name in ("own", "near"))
    joined = join_groups(df.join(own, key, "left"), near, [region])
    return joined.withColumn(out, F.coalesce("_own", "_near", found["all"].scalar())).drop("_own", "_near")


def lagged_density(df: DataFrame, deals: DataFrame, keys: list[str], period: str, out: str) -> DataFrame:
    """log1p of the number of deals in the previous period of the table's period list."""
    seq = sequence_numbers(df, period)
    n = deals.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("_n")).join(seq, period).select(*keys, "seq", "_n")
    moved = shift_join(df.join(seq, period, "left"), n, keys, "seq", 1, {"_n": "_prev"})
    return moved.withColumn(out, F.log1p(F.coalesce(F.col("_prev"), F.lit(0)))).drop("_prev", "seq")
