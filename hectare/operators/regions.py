"""Point in polygon, region rates and centroids.

A region is a row (code, parts): parts hold rings, rings hold struct<lon, lat>; the first ring of a part is its outer
ring, the others are holes (even-odd rule). Regions are cut into grid cells once; each cell row lists the regions that
touch it with the few edges a ray from inside the cell can meet. A point then needs one equi-join on its cell and no
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .spatial import located

PARTS_TYPE = "array<array<array<struct<lon:double,lat:double>>>>"


def edges(regions: DataFrame, code: str = "code", parts: str = "parts") -> DataFrame:
    """Directed edges (code, ring, pos, x1, y1, x2, y2); a ring is closed if it is not already."""
    part = regions.select(F.col(code).alias("code"), F.explode(parts).alias("p"))
    ring = part.select("code", F.posexplode("p").alias("ring", "r")).filter(F.size("r") >= 3)
    following = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    e = ring.select("code", "ring", F.posexplode(F.arrays_zip(F.col("r").alias("a"), following.alias("b"))).alias("pos", "e"))
    e = e.select("code", "ring", "pos", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
                 F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))
    return e.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _cell(value, step: float) -> Column:
    return F.floor(value / F.lit(step)).cast("bigint")


def region_cells(regions: DataFrame, step: float, code: str = "code", parts: str = "parts") -> DataFrame:
    """(iy, ix, regions): per cell the touching regions in code order, each with its ray edges.

    Edges that span the whole latitude band right of the cell are met by every ray, so only their parity is kept.
    """
    e = edges(regions, code, parts).filter(F.col("y1") != F.col("y2")).withColumns({
        "ylo": F.least("y1", "y2"), "yhi": F.greatest("y1", "y2"),
        "xlo": F.least("x1", "x2"), "xhi": F.greatest("x1", "x2"),
    })
    box = e.groupBy("code").agg(F.min("xlo").alias("bx"))
    banded = e.withColumn("iy", F.explode(F.sequence(_cell(F.col("ylo"), step), _cell(F.col("yhi"), step))))
    # An edge matters for the cells of its band from the region's left end up to the edge itself.
    placed = banded.join(box, "code").withColumn(
        "ix", F.explode(F.sequence(_cell(F.col("bx"), step), _cell(F.col("xhi"), step))))
    band_lo, cell_hi = F.col("iy") * F.lit(step), (F.col("ix") + 1) * F.lit(step)
    passed = (F.col("ylo") < band_lo) & (F.col("yhi") > band_lo + step) & (F.col("xlo") > cell_hi)
    per_region = placed.groupBy("iy", "ix", "code").agg(
        (F.count_if(passed) % 2).alias("odd"),
        F.collect_list(F.when(~passed, F.struct("x1", "y1", "x2", "y2"))).alias("near"),
    ).filter((F.col("odd") == 1) | (F.size("near") > 0))
    return per_region.groupBy("iy", "ix").agg(
        F.array_sort(F.collect_list(F.struct("code", "odd", "near"))).alias("regions"))


def assign_region(points: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "code",
                  step: float = 0.02, code: str = "code", parts: str = "parts") -> DataFrame:
    """Attach the code of the region that holds each point (smallest code if several do), null outside all.

    Borders are half-open: a point on a shared border belongs to exactly one side.
    """
    px, py = F.col(lon), F.col(lat)

    def crossings(near: Column) -> Column:
        def crossed(e):
            above = (e["y1"] > py) != (e["y2"] > py)
            at = e["x1"] + (py - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
            return above & (px < at)
        return F.size(F.filter(near, crossed))

    inside = F.filter("regions", lambda r: (r["odd"] + crossings(r["near"])) % 2 == 1)
    keyed = points.withColumns({"iy": _cell(py, step), "ix": _cell(px, step)})
    cells = region_cells(regions, step, code, parts)
    return keyed.join(cells, ["iy", "ix"], "left").withColumn(out, F.get(inside, F.lit(0))["code"]).drop("iy", "ix", "regions")


def region_rate(events: DataFrame, regions: DataFrame, population: str, per: float = 1000.0, out: str = "rate",
                lat: str = "lat", lon: str = "lon", step: float = 0.02) -> DataFrame:
    """Events inside each region per ``per`` residents (at least one resident); regions without events are absent."""
    hits = assign_region(located(events, lat, lon), regions, lat, lon, "code", step).filter(F.col("code").isNotNull())
    n = hits.groupBy("code").agg(F.count(F.lit(1)).alias("n_events"))
    pop = regions.select("code", F.col(population).alias("_pop"))
    return n.join(pop, "code").select(
        "code", "n_events", (F.col("n_events") / F.greatest(F.col("_pop"), F.lit(1.0)) * per).alias(out))


def region_log_density(events: DataFrame, region: str, kind: str, types: dict[str, list[str]], population: DataFrame,
                       pop_col: str) -> DataFrame:
    """log1p of events per 1000 residents for several event-type sets in one pass.

    ``population`` has one row per region; a missing population takes the median over regions.
    """
    n = events.groupBy(region).agg(*[F.count_if(F.col(kind).isin(v)).alias(f"_{k}") for k, v in types.items()])
    typical = population.agg(F.median(pop_col)).scalar()
    pop = F.coalesce(F.col(pop_col), typical)
    return n.join(population.select(region, pop_col), region, "left").select(region, *[
        F.log1p(F.col(f"_{k}") / (pop / 1000 + 1e-6)).alias(f"{k}_log_density") for k in types])


def vertex_centroid(regions: DataFrame, code: str = "code", parts: str = "parts") -> DataFrame:
    """Mean of all ring vertices of each part, then mean over the parts."""
    part = regions.select(F.col(code).alias("code"), F.posexplode(parts).alias("part", "p"))
    v = part.select("code", "part", F.explode(F.flatten("p")).alias("v"))
    per_part = v.groupBy("code", "part").agg(F.avg("v.lat").alias("lat"), F.avg("v.lon").alias("lon"))
    return per_part.groupBy("code").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def boundary_vertices(regions: DataFrame, code: str = "code", parts: str = "parts", stride: int = 3) -> DataFrame:
    """Every ``stride``-th vertex (lon, lat) of the outer outlines of a coverage, counted along each outline from its lowest vertex.

    Edges that two regions share cancel; what is left is chained into rings. Rings round a gap between regions run the other way and are
    no outline. The chain is followed by doubling the step, so a long outline takes a few rounds and no task holds a whole one.
    """
    e = _oriented_edges(regions, code, parts)
    a, b = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    once = e.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct("x1", "y1", "x2", "y2", "owner")).alias("e")).filter("uses = 1").select("e.*")
    # where outlines touch, an edge goes on with the edge of the same region
    turn = lambda x, y: F.row_number().over(Window.partitionBy(x, y).orderBy("owner", "x1", "y1", "x2", "y2"))
    start = once.select(F.struct("x1", "y1", "x2", "y2").alias("edge"), F.col("x1").alias("x"), F.col("y1").alias("y"), turn("x1", "y1").alias("k"))
    chain = once.select(F.struct("x1", "y1", "x2", "y2").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y"), turn("x2", "y2").alias("k"))
    chain = _stored(chain.join(start, ["x", "y", "k"]).select("id", F.col("edge").alias("to")))

    # lowest edge of each ring: look twice as far ahead in every round, until nothing changes
    ring = chain.select("id", "to", F.least("id", "to").alias("low"))
    while True:
        ahead = ring.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        further = _stored(ring.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        changed, ring = further.filter("moved").limit(1).count() > 0, further.drop("moved")
        if not changed:
            break
    # steps from each edge to its ring's lowest edge
    steps = chain.join(ring.select("id", "low"), "id").select(
        "id", "low", F.when(F.col("id") == F.col("low"), F.col("id")).otherwise(F.col("to")).alias("to"), (F.col("id") != F.col("low")).cast("bigint").alias("n"))
    while steps.filter("to <> low").limit(1).count() > 0:
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        steps = _stored(steps.join(ahead, "to").select("id", "low", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n")))
    size = steps.groupBy("low").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.expr("id.x1 * id.y2 - id.x2 * id.y1")).alias("area")).filter("area > 0")
    placed = steps.join(size, "low").filter((F.col("size") - F.col("n")) % F.col("size") % stride == 0)
    return placed.select(F.col("id.x1").alias("lon"), F.col("id.y1").alias("lat")).distinct()


def _oriented_edges(regions: DataFrame, code: str, parts: str) -> DataFrame:
    """Edges (owner, x1, y1, x2, y2) that keep their region on the left: outer rings run against the clock, holes with it."""
    part = regions.select(F.col(code).alias("code"), F.posexplode(parts).alias("part", "p"))
    ring = part.select("code", "part", F.posexplode("p").alias("ring", "r")).filter(F.size("r") >= 3)
    following = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    sides = F.arrays_zip(F.col("r").alias("a"), following.alias("b"))
    area = F.aggregate(sides, F.lit(0.0), lambda total, s: total + s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])
    turned = (area > 0) != (F.col("ring") == 0)
    side = ring.withColumn("turned", turned).select(F.struct("code", "part", "ring").alias("owner"), "turned", F.explode(sides).alias("s"))
    a, b = (F.when(F.col("turned"), F.col(f"s.{x}")).otherwise(F.col(f"s.{y}")) for x, y in (("b", "a"), ("a", "b")))
    e = side.select("owner", a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2"))
    return e.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "outline")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def district_centroids(places: DataFrame, district: str, lat: str, lon: str, fallback: DataFrame,
                       overrides: DataFrame | None = None) -> DataFrame:
    """Mean coordinates of a district's places; districts without places take the fall-back row.

    ``fallback``/``overrides`` have (district, lat, lon); an override wins over everything.
    """
    mean = located(places, lat, lon).groupBy(F.col(district).alias("district")).agg(
        F.avg(lat).alias("m_lat"), F.avg(lon).alias("m_lon"))
    fb = fallback.select("district", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    out = mean.join(fb, "district", "full")
    best = {"lat": F.coalesce("m_lat", "f_lat"), "lon": F.coalesce("m_lon", "f_lon")}
    if overrides is not None:
        out = out.join(overrides.select("district", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")), "district", "left")
        best = {k: F.coalesce(F.col(f"o_{k}"), v) for k, v in best.items()}
    return out.select("district", *[v.alias(k) for k, v in best.items()])


def attach_centroid(df: DataFrame, district: str, centroids: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """District coordinates with the city centre for unknown districts."""
    c = centroids.select(F.col("district").alias(district), F.col("lat").alias("district_lat"), F.col("lon").alias("district_lon"))
    return df.join(c, district, "left").withColumns({
        "district_lat": F.coalesce("district_lat", F.lit(centre[0])),
        "district_lon": F.coalesce("district_lon", F.lit(centre[1])),
    })
