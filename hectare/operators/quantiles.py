"""Exact grouped quantiles that stay bounded when one group holds much of the table.

Values fall into cells of a fixed, order-preserving scale. Counts per cell tell in which cell a wanted rank lies, and only the values of
those cells are ranked. One plan serves every size; no task holds or orders the values of a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.numbers import one_row
from ..session import stored

# Cells per factor of e, and the size from which the scale is logarithmic.
CELLS, FINEST = 4096, 2.0**-20


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match, keeping one copy of the keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def cell_of(value: Column) -> Column:
    """A cell number that never falls as the value grows; neighbouring cells differ by a fortieth of a percent or by 2^-32."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) / F.lit(FINEST)) * F.lit(CELLS))).cast("bigint")


def group_agg(df: DataFrame, keys: list[str], aggs: list[Column] = (), quantiles: dict | None = None) -> DataFrame:
    """``groupBy(keys).agg(*aggs)`` plus exact linear-interpolated quantiles ``{out: (value, p)}``, all of them from one ranking.

    ``keys`` may be empty (one row). Null and NaN values are ignored by the quantiles; groups without values get null.
    """
    by_value: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (v, p) in (quantiles or {}).items():
        by_value.setdefault(str(col(v)), (col(v), {}))[1][name] = p
    if not by_value:
        return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    if keys:
        # the keys travel as one struct: nulls in it are equal, so a plain join on it reuses the partitioning of both sides
        df = df.withColumn("_g", F.struct(*keys))
        out = df.groupBy("_g").agg(*aggs) if aggs else df.select("_g").distinct()
        found = _ranked(df, ["_g"], list(by_value.values()))
        names = [c for c in out.columns if c != "_g"]
        return out.join(found, "_g", "left").select("_g.*", *names, *quantiles)
    found = _ranked(df, [], list(by_value.values()))
    if not aggs:
        return found.select(*quantiles)
    # one row beside one row
    out = df.agg(*aggs)
    return out.withColumn("_q", one_row(found)).select(*out.columns, *[F.col(f"_q.{name}").alias(name) for name in quantiles])


def quantiles_by_rank(df: DataFrame, keys: list[str], values: list[tuple[Column, dict[str, float]]], weight: str | None = None) -> DataFrame:
    """Exact quantiles ``(value, {out: p})`` of several values, per group that has a value; one row (of nulls, if need be) without keys.

    ``weight``: a column that says how many rows (one at least) each row stands for.
    """
    if not keys:
        return _ranked(df, [], values, weight)
    return _ranked(df.withColumn("_g", F.struct(*keys)), ["_g"], values, weight).select("_g.*", *[name for _, ps in values for name in ps])


def quantile_sets(df: DataFrame, sets: dict[str, list[str]], value: Column | str, quantiles: dict[str, float]) -> dict[str, DataFrame]:
    """Exact quantiles of one value for several groupings from one ranking: per name a table (its keys, the quantiles).

    The result of all sets is stored once; groups without a value are absent, and no keys give one row (none without values).
    """
    keys = list(dict.fromkeys(k for own in sets.values() for k in own))
    kinds = {f.name: f.dataType for f in df.select(*keys).schema} if keys else {}
    variants = F.array(*[F.struct(F.lit(i).alias("_set"), *[(F.col(k) if k in own else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for i, own in enumerate(sets.values())])
    rows = df.select(col(value).alias("_x"), F.explode(variants).alias("_g"))
    found, _ = stored(_ranked(rows, ["_g"], [(F.col("_x"), quantiles)]).select("_g.*", *quantiles), "quantile-sets")
    return {name: found.filter(F.col("_set") == i).select(*own, *quantiles) for i, (name, own) in enumerate(sets.items())}


def _ranked(df: DataFrame, group: list[str], values: list[tuple[Column, dict[str, float]]], weight: str | None = None) -> DataFrame:
    """The values are stacked as rows (number of the value, group, cell), so one count and one ranking serve them all.

    Distinct values are dealt by (group, cell) once; cell counts, ranks and the values of the needed cells all start from there.
    """
    doubles = [v.cast("double") for v, _ in values]
    stacked = F.posexplode(F.array(*doubles)).alias("_k", "_v")
    kept = [*group, F.col(weight).alias("_w")] if weight else group
    rows = df.select(*kept, stacked) if len(values) > 1 else df.select(*kept, F.lit(0).alias("_k"), doubles[0].alias("_v"))
    many = F.sum("_w") if weight else F.count(F.lit(1))
    whole, cell = [*group, "_k"], [*group, "_k", "_cell"]
    counted = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*whole, cell_of(F.col("_v")).alias("_cell"), "_v").agg(many.alias("_c"))
    counted = counted.repartition(*cell)
    in_order = Window.partitionBy(*whole).orderBy("_cell")
    cells = counted.groupBy(*cell).agg(F.sum("_c").alias("_in"))
    cells = cells.withColumns({"_before": F.sum("_in").over(in_order) - F.col("_in"), "_n": F.sum("_in").over(Window.partitionBy(*whole))})
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    wanted = [F.array(*[side(at(p)).cast("bigint") for p in ps.values() for side in (F.floor, F.ceil)]) for _, ps in values]
    ranks = F.array_distinct(F.array(*wanted)[F.col("_k")])
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    needed = cells.withColumn("_ranks", here).filter(F.size("_ranks") > 0).select(*cell, "_before", "_n", "_ranks")
    by_value = Window.partitionBy(*cell).orderBy("_v")
    picked = (
        counted.join(needed, cell)
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(by_value))
        .withColumn("_rank", F.explode("_ranks"))
        .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    )
    out = []
    for k, (_, ps) in enumerate(values):
        own = F.col("_k") == k
        for name, p in ps.items():
            low, high = (F.max(F.when(own & (F.col("_rank") == side(at(p)).cast("bigint")), F.col("_v"))) for side in (F.floor, F.ceil))
            out.append((low + (high - low) * F.max(F.when(own, at(p) - F.floor(at(p))))).alias(name))
    return picked.groupBy(*group).agg(*out)


def value_at_rank(rows: DataFrame, value: str, rank: int, weight: str | None = None) -> tuple[int, int] | None:
    """The integer that stands at a 0-based rank of the whole column, and how many rows are below it; None beyond the last row.

    ``weight``: a column that says how many rows each row stands for.

    Each pass counts at most 65,536 equal stretches of what is left of the range; a 64-bit range takes four.
    """
    v = F.col(value).cast("bigint")
    ends = rows.agg(F.min(v), F.max(v), F.sum(F.when(v.isNotNull(), F.col(weight) if weight else F.lit(1)))).first()
    if rank < 0 or rank >= (ends[2] or 0):
        return None
    low, high, below = ends[0], ends[1], 0
    while low < high:
        width = (high - low) // 65536 + 1
        stretch = F.floor((v.cast("decimal(20,0)") - F.lit(low)) / F.lit(width))
        counts = rows.filter(v.between(low, high)).groupBy(stretch.cast("bigint").alias("s")).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("n")).toPandas().sort_values("s")
        upto = counts["n"].cumsum() + below
        i = int((upto <= rank).sum())
        below = int(upto.iloc[i - 1]) if i else below
        low = low + int(counts["s"].iloc[i]) * width
        high = min(high, low + width - 1)
    return low, below
