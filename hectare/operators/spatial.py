"""Nearest points and counts within a radius, as equi-joins on a pyramid of grid cells.

``index_points`` stores a point set once: copies of a location are merged, locations are grouped into cells of a grid that gets four
times finer per level and side, and each coarser level is summed up from the finest one. A cell row carries its counts and the tight box
around its points; the finest level also carries the points. The tables lie in the shared folder, so a walk's plan stays short and a
lost executor does not rebuild them; one index serves any number of look-ups, with any metric, radius and stratum.

A query point walks down the levels by equi-joins on the cell: cells that cannot matter are dropped, cells that lie wholly inside the
radius are counted from their totals, only the rest is opened. So a cell that holds a third of all points costs no more than its
border, and no task ever sees all pairs of a crowded area.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, METRICS
from ..session import discard, stored

FAN = 4  # cells per side and level
LEAF_SIZE = 24  # distinct locations a finest cell should hold at most
MAX_LEVEL = 13  # about 1 mm for a city: below it, more levels cannot separate locations
DISTANCE_ONLY = "_one"  # id column of callers that want no attributes
SLACK = 4e-9  # relative safety margin of cell bounds; exact tests are always made on points


@dataclass
class Grid:
    """Extent and depth of a pyramid; measured once per point set (three numbers come to the driver)."""

    lat0: float
    lon0: float
    span: float
    depth: int
    lat_abs: float

    def cells(self, level: int) -> int:
        return FAN ** level

    def size_deg(self, level: int) -> float:
        return self.span / self.cells(level)

    def row(self, value, origin: float, level: int) -> Column:
        """Cell number along one axis, held inside the grid."""
        n = self.cells(level)
        raw = F.floor((value - F.lit(origin)) * F.lit(n / self.span)).cast("bigint")
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), raw))


def located(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with usable coordinates."""
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return df.filter(ok)


def query_places(subjects: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct query locations, spread over all shuffle partitions. Several look-ups for one table can share them (``places``); then
    each look-up's plan holds the table's own plan once, not all look-ups before it.

    The table is small beside the rows the walk makes of it, so adaptive coalescing would put it into a few tasks; a
    repartition by number is left alone.
    """
    n = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return located(subjects, lat, lon).select(F.col(lat).alias("_sy"), F.col(lon).alias("_sx")).distinct().repartition(n, "_sy", "_sx")


def _first_depth(n: int, leaf_size: int) -> int:
    return min(MAX_LEVEL, max(1, math.ceil(math.log(max(n / leaf_size, 1), FAN ** 2))))


@dataclass
class PointIndex:
    """A stored point set: its pyramid, the names it counts, the id and columns of its points and how many it keeps per location."""

    grid: Grid | None
    levels: dict[int, DataFrame]
    names: list[str]
    p_id: str
    cols: list[str]
    keep: int
    empty: DataFrame


def index_points(points: DataFrame, counts: dict[str, Column] | None = None, lat: str = "lat", lon: str = "lon", p_id: str | None = None,
                 cols: list[str] = (), keep: int = 1, leaf_size: int = LEAF_SIZE) -> PointIndex:
    """Store a point set for ``nearest_k``, ``nearest_strata`` and ``count_within``; three jobs, one more where points crowd.

    ``counts``: conditions to count, or to look for the nearest of, by name. With ``p_id`` the points with the ``keep`` smallest ids of
    each location are kept with their ``cols``. Points without coordinates are left out.
    """
    counts, p_id = counts or {}, p_id or DISTANCE_ONLY
    pts = located(points if p_id != DISTANCE_ONLY else points.withColumn(DISTANCE_ONLY, F.lit(0)), lat, lon).select(
        F.col(lat).alias("_y"), F.col(lon).alias("_x"), F.struct(F.col(p_id).alias("_id"), F.struct(*cols or [p_id]).alias("_row")).alias("_r"), *[c.alias(n) for n, c in counts.items()])
    totals = [F.count_if(F.col(n)).alias(n) for n in counts]
    if keep == 1:  # one partial aggregate
        spots = pts.groupBy("_y", "_x").agg(F.array(F.min("_r")).alias("rows"), *totals)
    else:
        first = pts.withColumn("_rn", F.row_number().over(Window.partitionBy("_y", "_x").orderBy("_r._id"))).filter(F.col("_rn") <= keep)
        spots = first.groupBy("_y", "_x").agg(F.array_sort(F.collect_list("_r")).alias("rows"))
        if totals:
            spots = spots.join(pts.groupBy("_y", "_x").agg(*totals), ["_y", "_x"])
    spots, e = stored(spots.withColumn("_n", F.size("rows").cast("bigint")), "spots", seen={
        "n": F.count(F.lit(1)), "y0": F.min("_y"), "y1": F.max("_y"), "x0": F.min("_x"), "x1": F.max("_x")})
    about = dict(names=list(counts), p_id=p_id, cols=list(cols), keep=keep, empty=spots)
    if not e["n"]:
        return PointIndex(None, {}, **about)
    span = max(e["y1"] - e["y0"], e["x1"] - e["x0"], 1e-6) * (1 + 1e-9)
    box = [F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.min("_x").alias("x0"), F.max("_x").alias("x1")]
    sums = ["_n", *counts]
    depth = _first_depth(e["n"], leaf_size)
    while True:
        grid = Grid(e["y0"], e["x0"], span, depth, max(abs(e["y0"]), abs(e["y1"])))
        cell = [grid.row(F.col("_y"), grid.lat0, depth).alias("iy"), grid.row(F.col("_x"), grid.lon0, depth).alias("ix")]
        finest = spots.groupBy(*cell).agg(*box, *[F.sum(c).alias(c) for c in sums], F.collect_list(F.struct("_y", "_x", "rows", *counts)).alias("pts"))
        table, most = stored(finest.withColumns(_cosines()), "cells", seen={"fullest": F.max(F.size("pts"))})
        if most["fullest"] <= leaf_size or depth == MAX_LEVEL:
            break
        discard(table)
        depth = min(MAX_LEVEL, depth + max(1, math.ceil(math.log(most["fullest"] / leaf_size, FAN ** 2) - 0.5)))
    discard(spots)
    levels = {depth: table}
    if depth > 1:
        up = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(FAN)), F.lit(depth) - F.col("level"))).cast("bigint").alias(c)
        spread = table.drop("pts").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth - 1))))
        ends = [F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")]
        coarse = spread.groupBy("level", up("iy"), up("ix")).agg(*ends, *[F.sum(c).alias(c) for c in sums])
        above, _ = stored(coarse.withColumns(_cosines()), "levels", by="level")
        levels |= {n: above.filter(F.col("level") == n).drop("level") for n in range(1, depth)}
    return PointIndex(grid, levels, **about)


def _cosines() -> dict[str, Column]:
    """Smallest and largest cosine of the latitudes of a box."""
    a, b = F.cos(F.radians("y0")), F.cos(F.radians("y1"))
    return {"c0": F.least(a, b), "c1": F.when((F.col("y0") <= 0) & (F.col("y1") >= 0), F.lit(1.0)).otherwise(F.greatest(a, b))}


def _bounds(metric: str) -> tuple[Column, Column]:
    """Smallest and largest possible distance from (_sy, _sx) to the box of a cell, on the scale of ``_on_scale``."""
    y, x = F.col("_sy"), F.col("_sx")
    zero = F.lit(0.0)
    near_y = F.greatest(zero, F.col("y0") - y, y - F.col("y1"))
    near_x = F.greatest(zero, F.col("x0") - x, x - F.col("x1"))
    far_y = F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1")))
    far_x = F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1")))
    if metric == "flat":
        lo, hi = (F.pow(dy, F.lit(2.0)) + F.pow(dx, F.lit(2.0)) for dy, dx in ((near_y, near_x), (far_y, far_x)))
    else:
        half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
        arc = lambda dy, dx, c: half(dy) + F.cos(F.radians(y)) * F.col(c) * half(dx)
        # only a box that can be reached across the border at 180 degrees needs the shorter way; the sine is taken once for both
        way = lambda dx: F.least(dx, 360 - dx)
        shortest = F.when(far_x <= 180, near_x).otherwise(F.greatest(zero, F.least(way(near_x), 360 - far_x)))
        longest = F.when(far_x <= 180, far_x).otherwise(F.when(near_x <= 180, F.lit(180.0)).otherwise(way(near_x)))
        lo, hi = arc(near_y, shortest, "c0"), arc(far_y, longest, "c1")
    return lo * (1 - SLACK), hi * (1 + SLACK)


def _on_scale(metric: str, radius_m: float) -> float:
    """A distance as cell bounds are compared: squared degrees, or the squared sine of half the angle; both grow with the distance."""
    if metric == "flat":
        return (radius_m / METRES_PER_DEGREE) ** 2
    return math.sin(min(math.pi / 2, radius_m / (2 * EARTH_RADIUS_M))) ** 2


def _children(iy: Column, ix: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(FAN * FAN - 1)),
        lambda i: F.struct((iy * FAN + F.floor(i / FAN)).alias("iy"), (ix * FAN + i % FAN).alias("ix")),
    )


def _walk_nearest(places: DataFrame, index: PointIndex, metric: str, needs: dict[str, int]) -> DataFrame:
    """(_sy, _sx, pts) of the cells that can hold, for each name in ``needs``, the so many nearest points that it counts."""
    lo, hi = _bounds(metric)
    mine = Window.partitionBy("_sy", "_sx")
    cand = places.withColumn("_c", F.explode(_children(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))).select("_sy", "_sx", "_c.*")
    points = index.levels[index.grid.depth].select("iy", "ix", "pts")
    for level in range(1, index.grid.depth + 1):
        # the cells of a place are sorted without their points; what is kept takes them up
        cells = cand.join(index.levels[level].drop("pts"), ["iy", "ix"]).withColumns({"_lo": lo, "_hi": hi})
        limits = {}
        for i, (name, k) in enumerate(needs.items()):
            if k == 1:
                limits[name] = F.min(F.when(F.col(name) > 0, F.col("_hi"))).over(mine)
            else:
                # the smallest upper bound under which the cells seen so far hold k points (or all of them)
                upto = F.sum(name).over(mine.orderBy("_hi").rangeBetween(Window.unboundedPreceding, 0))
                cells = cells.withColumn(f"_upto{i}", upto).withColumn(f"_all{i}", F.sum(name).over(mine))
                limits[name] = F.min(F.when(F.col(f"_upto{i}") >= F.least(F.lit(k), F.col(f"_all{i}")), F.col("_hi"))).over(mine)
        cells = cells.withColumns({f"_limit{i}": limit for i, limit in enumerate(limits.values())})
        matters = [(F.col(name) > 0) & (F.col("_lo") <= F.col(f"_limit{i}")) for i, name in enumerate(needs)]
        kept = cells.filter(_any(matters))
        if level < index.grid.depth:
            cand = kept.withColumn("_c", F.explode(_children(F.col("iy"), F.col("ix")))).select("_sy", "_sx", "_c.*")
    return kept.select("_sy", "_sx", "iy", "ix").join(points, ["iy", "ix"]).select("_sy", "_sx", F.explode("pts").alias("p"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def nearest_k(subjects: DataFrame, points: DataFrame | PointIndex, k: int = 1, metric: str = "flat",
              lat: str = "lat", lon: str = "lon", p_lat: str = "lat", p_lon: str = "lon",
              p_id: str = "id", cols: list[str] = (), leaf_size: int = LEAF_SIZE, places: DataFrame | None = None) -> DataFrame:
    """The k nearest points of each distinct subject location, ties by point id.

    Returns rows (lat, lon, rank, distance_m, <p_id>, *cols); join them back to the subjects by location. ``points`` may be a stored
    index that keeps k or more points per location.
    """
    index = points
    if not isinstance(points, PointIndex):
        index = index_points(points, None, p_lat, p_lon, p_id, cols, k, leaf_size)
    elif index.keep < k:
        raise ValueError("the index keeps fewer points per location")
    p_id = index.p_id
    cols = cols or index.cols
    if index.grid is None:
        nobody = index.empty.select(F.explode("rows").alias("r"), F.col("_y").alias("_sy"), F.col("_x").alias("_sx"), F.lit(0).alias("rank"), F.lit(0.0).alias("d"))
        return _nearest_columns(nobody, lat, lon, p_id, cols).limit(0)
    opened = _walk_nearest((query_places(subjects, lat, lon) if places is None else places), index, metric, {"_n": k})
    away = METRICS[metric]("_sy", "_sx", F.col("p._y"), F.col("p._x")).alias("d")
    if k > 1:
        # locations are ranked without their rows, and only the k nearest (with ties) take them up: each has one row at least
        near = opened.select("_sy", "_sx", F.col("p._y").alias("_y"), F.col("p._x").alias("_x"), away)
        near = near.withColumn("_rn", F.rank().over(Window.partitionBy("_sy", "_sx").orderBy("d"))).filter(F.col("_rn") <= k)
        held = index.levels[index.grid.depth].select(F.explode("pts").alias("p")).select("p._y", "p._x", "p.rows")
        measured = near.join(held, ["_y", "_x"]).select("_sy", "_sx", F.explode("rows").alias("r"), "d")
    else:
        measured = opened.select("_sy", "_sx", F.explode("p.rows").alias("r"), away)
    if k == 1 and p_id == DISTANCE_ONLY:
        # no id to break ties with: a plain minimum stays a hash aggregate
        nearest = measured.groupBy("_sy", "_sx").agg(F.min("d").alias("d"))
        any_row = F.struct(F.lit(0).alias("_id"), F.struct(F.lit(0).alias(p_id)).alias("_row"))
        ranked = nearest.select("_sy", "_sx", "d", any_row.alias("r"), F.lit(1).alias("rank"))
    elif k == 1:
        best = measured.groupBy("_sy", "_sx").agg(F.min(F.struct("d", "r")).alias("b"))
        ranked = best.select("_sy", "_sx", "b.d", "b.r", F.lit(1).alias("rank"))
    else:
        order = Window.partitionBy("_sy", "_sx").orderBy("d", "r._id")
        ranked = measured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _nearest_columns(ranked, lat, lon, p_id, cols)


def nearest_strata(subjects: DataFrame, index: PointIndex, out: dict[str, str], metric: str = "flat", log: bool = False, lat: str = "lat", lon: str = "lon",
                   places: DataFrame | None = None) -> DataFrame:
    """Attach, per output column, the distance in metres to the nearest point that a name of the index counts; all in one walk.

    Subjects without coordinates, and names that count no point, get null.
    """
    if index.grid is None:
        found = subjects.withColumns({c: F.lit(None).cast("double") for c in out})
    else:
        names = {name: f"_d{i}" for i, name in enumerate(dict.fromkeys(out.values()))}
        opened = _walk_nearest((query_places(subjects, lat, lon) if places is None else places), index, metric, dict.fromkeys(names, 1))
        measured = opened.select("_sy", "_sx", "p", METRICS[metric]("_sy", "_sx", F.col("p._y"), F.col("p._x")).alias("d"))
        best = measured.groupBy("_sy", "_sx").agg(*[F.min(F.when(F.col(f"p.{name}") > 0, F.col("d"))).alias(c) for name, c in names.items()])
        picked = best.select(F.col("_sy").alias(lat), F.col("_sx").alias(lon), *[F.col(names[name]).alias(c) for c, name in out.items()])
        found = subjects.join(picked, [lat, lon], "left")
    return found.withColumns({f"log_{c}": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in out}) if log else found


def _nearest_columns(ranked: DataFrame, lat: str, lon: str, p_id: str, cols) -> DataFrame:
    return ranked.select(F.col("_sy").alias(lat), F.col("_sx").alias(lon), "rank", F.col("d").alias("distance_m"),
                         F.col("r._id").alias(p_id), *[F.col(f"r._row.{c}").alias(c) for c in cols if c != p_id])


def nearest_attrs(subjects: DataFrame, points: DataFrame | PointIndex, cols: list[str], out: str = "distance_m", prefix: str = "",
                  metric: str = "flat", lat: str = "lat", lon: str = "lon", p_lat: str = "lat", p_lon: str = "lon",
                  p_id: str = "id", places: DataFrame | None = None) -> DataFrame:
    """Attach the distance to, and attributes of, the nearest point; subjects without coordinates keep nulls."""
    near = nearest_k(subjects, points, 1, metric, lat, lon, p_lat, p_lon, p_id, cols, places=places)
    picked = near.select(lat, lon, F.col("distance_m").alias(out), *[F.col(c).alias(prefix + c) for c in cols])
    return subjects.join(picked, [lat, lon], "left")


def nearest_distance(subjects: DataFrame, points: DataFrame, out: str, metric: str = "flat", log: bool = False,
                     lat: str = "lat", lon: str = "lon", p_lat: str = "lat", p_lon: str = "lon",
                     where: Column | None = None) -> DataFrame:
    """Attach the distance in metres to the nearest point (of those that satisfy ``where``)."""
    kept = points if where is None else points.filter(where)
    spots = kept.select(p_lat, p_lon, F.lit(0).alias(DISTANCE_ONLY))
    found = nearest_attrs(subjects, spots, [], out, "", metric, lat, lon, p_lat, p_lon, DISTANCE_ONLY)
    return found.withColumn(f"log_{out}", F.log1p(F.greatest(F.col(out), F.lit(0.0)))) if log else found


def count_within(subjects: DataFrame, points: DataFrame | PointIndex, radius_m: float, counts: dict[str, Column] | dict[str, str] | None = None,
                 metric: str = "haversine", lat: str = "lat", lon: str = "lon", p_lat: str = "lat", p_lon: str = "lon",
                 leaf_size: int = LEAF_SIZE, places: DataFrame | None = None) -> DataFrame:
    """Attach, per name, the number of points within the radius that satisfy the name's condition.

    Several conditions (categories, overlapping buckets) are counted in the same walk. Subjects without coordinates,
    and names without a hit, get 0. With a stored index, ``counts`` maps output columns to names of the index (default: all of them).
    """
    if isinstance(points, PointIndex):
        index, wanted = points, counts or {n: n for n in points.names}
    else:
        counts = counts or {"n_within": F.lit(True)}
        index, wanted = index_points(points, counts, p_lat, p_lon, leaf_size=leaf_size), {n: n for n in counts}
    names = list(dict.fromkeys(wanted.values()))
    places = query_places(subjects, lat, lon) if places is None else places
    grid, levels = index.grid, index.levels
    if grid is None:
        return subjects.withColumns({n: F.lit(0).cast("bigint") for n in wanted})
    lo, hi = _bounds(metric)
    limit = _on_scale(metric, radius_m)
    reach_y = radius_m / METRES_PER_DEGREE * 1.01
    shrink = 1.0 if metric == "flat" else max(0.01, math.cos(math.radians(min(89.0, grid.lat_abs + reach_y))))
    reach_x = reach_y / shrink
    # The finest level whose cells are still as wide as the radius: at most 3 cells per axis are touched there.
    start = 1
    while start < grid.depth and grid.size_deg(start + 1) >= reach_x:
        start += 1

    def span(value: str, origin: float, reach: float, turn: float = 0.0):
        return F.sequence(grid.row(F.col(value) + turn - reach, origin, start), grid.row(F.col(value) + turn + reach, origin, start))

    across = span("_sx", grid.lon0, reach_x)
    if metric != "flat":  # subjects near the border at 180 degrees look on its other side too
        both = F.array_union(across, F.array_union(span("_sx", grid.lon0, reach_x, 360.0), span("_sx", grid.lon0, reach_x, -360.0)))
        across = F.when(F.abs("_sx") + reach_x > 180, both).otherwise(across)
    cand = (
        places.withColumn("iy", F.explode(span("_sy", grid.lat0, reach_y)))
        .withColumn("ix", F.explode(across))
        .select("_sy", "_sx", "iy", "ix", F.lit(None).cast(_counts_type(names)).alias("_done"))
    )
    total = F.struct(*[F.col(n) for n in names])
    for level in range(start, grid.depth + 1):
        cells = cand.join(levels[level], ["iy", "ix"], "left" if level > start else "inner")
        # a child without points finds no cell row (y0 is null): it is dropped here. What is wholly inside is also within reach, so
        # each bound is written, and so compiled, once: one in the filter, one behind it
        cells = cells.filter(F.col("_done").isNotNull() | (F.col("y0").isNotNull() & (lo <= limit)))
        cells = cells.withColumn("_done", F.coalesce(F.col("_done"), F.when(hi <= limit, total)))
        if level < grid.depth:
            # finished rows travel on under keys that match no cell, spread so that they do not pile up in one task
            parked = F.array(F.struct((-1 - F.pmod(F.xxhash64("_sy", "_sx", "iy", "ix"), F.lit(4096))).alias("iy"),
                                      F.lit(-1).cast("bigint").alias("ix")))
            step = F.when(F.col("_done").isNotNull(), parked).otherwise(_children(F.col("iy"), F.col("ix")))
            cand = cells.select("_sy", "_sx", "_done", F.explode(step).alias("_c")).select("_sy", "_sx", "_c.*", "_done")
    distance = METRICS[metric]

    # finished rows keep one row without a point; the others are opened point by point
    points_of = F.explode_outer(F.when(F.col("_done").isNull(), F.col("pts"))).alias("_p")
    opened = cells.select("_sy", "_sx", "_done", points_of)
    inside = distance("_sy", "_sx", F.col("_p._y"), F.col("_p._x")) <= radius_m
    sums = opened.withColumn("_in", inside).groupBy("_sy", "_sx").agg(*[
        F.sum(F.coalesce(F.col(f"_done.{n}"), F.when(F.col("_in"), F.col(f"_p.{n}")), F.lit(0))).alias(n) for n in names])
    back = sums.select(F.col("_sy").alias(lat), F.col("_sx").alias(lon), *[F.col(n).alias(c) for c, n in wanted.items()])
    return subjects.join(back, [lat, lon], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in wanted})


def _counts_type(names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:bigint" for n in names) + ">"


def count_within_by_category(subjects: DataFrame, points: DataFrame, category: str, values: list[str], radius_m: float,
                             **options) -> DataFrame:
    """One count column ``<value>_count`` per category value, all in one walk."""
    return count_within(subjects, points, radius_m,
                        {f"{v}_count": F.col(category) == F.lit(v) for v in values}, **options)


def idw(subjects: DataFrame, stations: DataFrame, values: list[str], k: int = 2, lat: str = "lat", lon: str = "lon",
        p_lat: str = "lat", p_lon: str = "lon", p_id: str = "id") -> DataFrame:
    """Inverse-distance mean of the k nearest stations' values; distances below 1 m count as 1 m."""
    near = nearest_k(subjects, stations, k, "flat", lat, lon, p_lat, p_lon, p_id, values)
    w = 1 / F.greatest(F.col("distance_m"), F.lit(1.0))
    means = near.groupBy(lat, lon).agg(*[
        (F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(f"{v}_idw") for v in values])
    return subjects.join(means, [lat, lon], "left")


def comparables(subjects: DataFrame, sales: DataFrame, radius_m: float, limit: int, cols: list[str],
                lat: str = "lat", lon: str = "lon", p_lat: str = "lat", p_lon: str = "lon", p_id: str = "id",
                keep: list[str] = ()) -> DataFrame:
    """Up to ``limit`` nearest sales within the radius; where there are none, the ``limit`` nearest anyway."""
    near = nearest_k(subjects, sales, limit, "flat", lat, lon, p_lat, p_lon, p_id, cols)
    mine = Window.partitionBy(lat, lon)
    found = F.min("distance_m").over(mine) <= radius_m
    kept = near.withColumn("_any", found).filter(~F.col("_any") | (F.col("distance_m") <= radius_m)).drop("_any")
    return subjects.select(*keep, lat, lon).join(kept.withColumn("distance_m", F.bround("distance_m").cast("bigint")), [lat, lon])
