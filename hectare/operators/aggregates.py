"""Grouped statistics: panels, listing and market statistics, pivots, slopes, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import quarter_id
from ..functions.geo import col
from ..functions.numbers import one_row
from .quantiles import group_agg, join_groups



def n_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def quarterly_panel(df: DataFrame, keys: list[str], ts: str, value: str, amount: str, min_n: int = 3,
                    lo: float | None = 100, hi: float | None = 100_000, digits: int = 2) -> DataFrame:
    """Group × quarter panel of a unit price: counts, total amount, median, mean and quartiles.

    Unit prices outside ``(lo, hi]`` and groups with fewer than ``min_n`` rows are left out.
    """
    kept = df
    if lo is not None:
        kept = kept.filter(F.col(value) > lo)
    if hi is not None:
        kept = kept.filter(F.col(value) <= hi)
    rows = kept.select(*keys, quarter_id(ts).alias("quarter_id"), F.col(value).alias("_v"), F.col(amount).alias("_a"))
    panel = group_agg(rows.filter(F.col("quarter_id").isNotNull()), [*keys, "quarter_id"],
                      [n_rows("deed_count"), F.sum("_a").alias("total_value"), F.avg("_v").alias("mean_psqm")],
                      {"median_psqm": ("_v", 0.5), "p25_psqm": ("_v", 0.25), "p75_psqm": ("_v", 0.75)})
    return panel.filter(F.col("deed_count") >= min_n).select(
        *keys, "quarter_id", F.floor(F.col("quarter_id") / 10).cast("int").alias("sale_year"),
        (F.col("quarter_id") % 10).alias("sale_quarter"), "deed_count",
        *[F.round(c, digits).alias(c) for c in ("total_value", "median_psqm", "mean_psqm", "p25_psqm", "p75_psqm")])


def panel_rollup(panel: DataFrame, key: str) -> DataFrame:
    """Per quarter: how many groups and deeds the panel holds."""
    return panel.groupBy("quarter_id").agg(F.countDistinct(key).alias("n_groups"), F.sum("deed_count").alias("n_deeds"))


def listing_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Asking-price statistics per district: count, median, quartiles, interquartile range, mean."""
    s = group_agg(df, [key], [F.count(value).alias("n_listings"), F.avg(value).alias("mean_psqm")],
                  {"median_psqm": (value, 0.5), "p25_psqm": (value, 0.25), "p75_psqm": (value, 0.75)})
    return s.withColumn("iqr_psqm", F.col("p75_psqm") - F.col("p25_psqm"))


def typed_stats_wide(df: DataFrame, key: str, type_col: str, medians: dict[str, tuple[str, str]],
                     counts: dict[str, str] | None = None, min_n: int = 2) -> DataFrame:
    """Per key: medians of a column for one type each, given only with ``min_n`` values; and row counts per type."""
    aggs = [F.count_if(F.col(type_col) == t).alias(name) for name, t in (counts or {}).items()]
    q = {}
    for name, (t, value) in medians.items():
        only = F.when(F.col(type_col) == t, F.col(value))
        aggs.append(F.count(only).alias(f"_n_{name}"))
        q[name] = (only, 0.5)
    wide = group_agg(df, [key], aggs, q)
    return wide.withColumns({n: F.when(F.col(f"_n_{n}") >= min_n, F.col(n)) for n in medians}).drop(*[f"_n_{n}" for n in medians])


def severity_by_key(df: DataFrame, key: str, class_col: str, weights: dict[str, int], count_col: str | None = None) -> DataFrame:
    """Counts per class as columns, their weighted sum, and log1p of each count and of the score."""
    one = F.col(count_col) if count_col else F.lit(1)
    wide = df.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col(class_col) == c, one)), F.lit(0)).alias(f"n_{c}") for c in weights])
    score = sum((F.col(f"n_{c}") * w for c, w in weights.items()), F.lit(0))
    return wide.withColumn("severity", score).withColumns(
        {f"log_{c}": F.log1p(F.col(c)) for c in [*(f"n_{k}" for k in weights), "severity"]})


def count_where(df: DataFrame, keys: list[str], predicate: Column, out: str = "n_rows") -> DataFrame:
    return df.filter(predicate).groupBy(*keys).agg(n_rows(out))


def pivot_mean(df: DataFrame, key: str, comp: str, values: list[str], value: str) -> DataFrame:
    """Mean per component as columns; a component a key never reports is 0."""
    return df.groupBy(key).agg(*[
        F.coalesce(F.avg(F.when(F.col(comp) == v, F.col(value))), F.lit(0.0)).alias(f"{v}_mean") for v in values])


def median_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median of many columns per key in one pass."""
    return group_agg(df, keys, [n_rows("n_rows")], {f"{c}_median": (c, 0.5) for c in columns})


def stat_lookup(df: DataFrame, key: str, columns: list[str], stat: str = "mean") -> DataFrame:
    """Mean or median per key and the same over all rows under ``global_*``, as one keyed table."""
    if stat == "mean":
        per = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
        top = one_row(df.agg(*[F.avg(c).alias(c) for c in columns]))
    else:
        per = group_agg(df, [key], [], {c: (c, 0.5) for c in columns})
        top = one_row(group_agg(df, [], [], {c: (c, 0.5) for c in columns}))
    return per.withColumns({f"global_{c}": top[c] for c in columns})


def group_stat_back(df: DataFrame, keys: list[str], value: str, out: str, stat: str = "median") -> DataFrame:
    """A group's statistic on each of its rows, by aggregate and join (a window would buffer the whole group)."""
    rows = df.select(*keys, value)
    s = group_agg(rows, keys, [], {out: (value, 0.5)}) if stat == "median" else rows.groupBy(*keys).agg(F.avg(value).alias(out))
    return join_groups(df, s, keys)


def distinct_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact distinct counts per key.

    Values are de-duplicated before they are counted, so a hot key is spread over tasks by value.
    """
    out = None
    for c in columns:
        d = df.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(f"n_{c}"))
        out = d if out is None else join_groups(out, d, keys)
    return out


def trend_slope(df: DataFrame, key: str, x: str, y: str, min_n: int = 3, eps: float = 0.0, out: str = "slope") -> DataFrame:
    """Least-squares slope per key; fewer than ``min_n`` points give 0; ``eps`` is added to the variance of x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    slope = F.regr_sxy(yy, xx) / (F.regr_sxx(yy, xx) + F.lit(float(eps)))
    degenerate = F.regr_sxx(yy, xx) + F.lit(float(eps)) == 0
    return df.groupBy(key).agg(F.when((F.count(xx) < min_n) | degenerate, F.lit(0.0)).otherwise(slope).alias(out))


def yearly_trend_slope(df: DataFrame, key: str, year: str, value: str, out: str = "slope") -> DataFrame:
    """Slope over a key's yearly means; a single year gives 0."""
    yearly = df.groupBy(key, year).agg(F.avg(value).alias("_mean"))
    return trend_slope(yearly, key, year, "_mean", min_n=2, eps=1e-10, out=out)


def stats_by_year(df: DataFrame, year, value: str) -> DataFrame:
    return group_agg(df.withColumn("sale_year", col(year)), ["sale_year"], [n_rows("n_rows")],
                     {"median_price": (value, 0.5), "q1_price": (value, 0.25), "q3_price": (value, 0.75)})


def stats_by_type(df: DataFrame, type_col: str, value: str, more_than: int = 5) -> DataFrame:
    s = group_agg(df, [type_col], [n_rows("n_rows")], {"median_price": (value, 0.5)})
    return s.filter(F.col("n_rows") > more_than)


def overview(df: DataFrame, district: str, year: str, value: str) -> DataFrame:
    """One row of headline figures."""
    totals = group_agg(df, [], [n_rows("total_rows"), F.min(year).alias("year_from"), F.max(year).alias("year_to")],
                       {"median_price": (value, 0.5)})
    return totals.withColumn("districts", df.select(district).distinct().agg(F.count(district)).scalar())


def activity_layer(panel: DataFrame, key: str, n_quarters: int = 4, min_n: int = 3) -> DataFrame:
    """Activity of the latest quarters per group: deeds, median of quarterly medians, total, active quarters, share of
    the busiest group."""
    quarters = panel.select("quarter_id").distinct().orderBy(F.desc("quarter_id")).limit(n_quarters)
    recent = panel.join(quarters, "quarter_id", "left_semi")
    # one row per (group, quarter) in a panel, so active quarters = rows
    layer = group_agg(recent, [key], [F.sum("deed_count").alias("deeds"), F.sum("total_value").alias("total"),
                                      F.countDistinct("quarter_id").alias("quarters_active")],
                      {"median_psqm": ("median_psqm", 0.5)}).filter(F.col("deeds") >= min_n)
    busiest = layer.agg(F.max("deeds")).scalar()
    return layer.withColumn("activity_norm", F.round(F.col("deeds") / busiest, 4))


def monthly_trend(df: DataFrame, keys: list[str], ts: str, value: str, min_n: int = 2) -> DataFrame:
    rows = df.select(*keys, F.date_format(ts, "yyyy-MM").alias("month"), value)
    s = group_agg(rows, [*keys, "month"], [n_rows("n_sales")], {"median_price": (value, 0.5)})
    return s.filter(F.col("n_sales") >= min_n)


def normalise_count(df: DataFrame, key: str, out: str = "count_norm") -> DataFrame:
    """Rows per key over the count of the fullest key."""
    n = df.groupBy(key).agg(n_rows("n_rows"))
    return n.withColumn(out, F.col("n_rows") / n.agg(F.max("n_rows")).scalar())


def merge_complex(df: DataFrame, key: str, order: str, first: list[str], flags: list[str]) -> DataFrame:
    """One row per complex: attributes of its first stop, maximum of the flags."""
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max(c).alias(c) for c in flags])


def yearly_mean(df: DataFrame, year: str, value: str, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.filter(where)).groupBy(year).agg(F.avg(value).alias(f"avg_{value}"))


def group_summary(df: DataFrame, key: str, type_col: str, value: str) -> DataFrame:
    """Per group: rows, median, mean and the sorted list of its types."""
    return group_agg(df, [key], [n_rows("n_rows"), F.avg(value).alias("mean_price"),
                              F.concat_ws(", ", F.sort_array(F.collect_set(type_col))).alias("types")],
                     {"median_price": (value, 0.5)})


def spread_table(asking: DataFrame, deals: DataFrame, keys: list[str], ask_value: str, deal_value: str,
                 cap_lo: float = -50, cap_hi: float = 300) -> DataFrame:
    """Asking versus paid medians per key of either side and their capped spread in percent.

    A key with one side only takes the median of the keys' spreads, and ``fallback`` is 1; the missing side stays null and
    its count is 0.
    """
    a = group_agg(asking, keys, [F.count(ask_value).alias("asking_n")], {"asking_median": (ask_value, 0.5)})
    t = group_agg(deals, keys, [F.count(deal_value).alias("deal_n")], {"deal_median": (deal_value, 0.5)})
    spread = F.round((F.col("asking_median") / F.col("deal_median") - 1) * 100, 1)
    both = a.join(t, keys, "full").withColumn("_own", F.when(spread.isNotNull(), F.greatest(F.lit(float(cap_lo)), F.least(F.lit(float(cap_hi)), spread))))
    typical = group_agg(both.select("_own"), [], [], {"m": ("_own", 0.5)}).scalar()
    return both.withColumns({
        "asking_n": F.coalesce("asking_n", F.lit(0)), "deal_n": F.coalesce("deal_n", F.lit(0)),
        "fallback": spread.isNull().cast("int"), "spread_pct": F.when(spread.isNull(), typical).otherwise(F.col("_own"))}).drop("_own")


def corr_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "correlation")


def skew_of(df: DataFrame, value: str) -> DataFrame:
    """Skewness of a value and of its log1p."""
    return df.agg(F.skewness(value).alias("skew_raw"), F.skewness(F.log1p(value)).alias("skew_log"))


def fit_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's minimum and maximum."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def minmax(value: Column, params: Column, name: str) -> Column:
    """Scale to [0, 1] with fitted ends and clip; a constant column gives 0."""
    lo, hi = params[f"{name}_min"], params[f"{name}_max"]
    t = F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def apply_minmax(df: DataFrame, params: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    p = one_row(params)
    return df.withColumns({f"{c}{suffix}": minmax(F.col(c), p, c) for c in columns})
