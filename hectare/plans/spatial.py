"""Spatial queries: nearest, counts, regions; the SQL is a plain cross join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import near_flag
from ..operators import aggregates, regions, spatial
from ..operators.joins import attach
from .registry import Tables, query, rounded

FLAT = "sqrt(pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2)) * 111000"
ARC = """2 * 6371000 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2)
    + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2)))"""


@query("nearest_flat", "G1, G16, G20", f"""
    SELECT c.id, round(min({FLAT}), 3) AS dist_m, round(ln(1 + min({FLAT})), 6) AS log_dist_m, round(min({FLAT}) FILTER (WHERE p.size >= 40), 3) AS dist_large_m,
           round(ln(1 + min({FLAT}) FILTER (WHERE p.size >= 40)), 6) AS log_dist_large_m FROM cust c, poi p GROUP BY c.id""")
def nearest_flat(t: Tables):
    index = spatial.index_points(t.poi, {"any": F.lit(True), "large": F.col("size") >= 40})
    out = spatial.nearest_strata(t.cust.select("id", "lat", "lon"), index, {"dist_m": "any", "dist_large_m": "large"}, log=True)
    return rounded(rounded(out.drop("lat", "lon"), 3, "dist_m", "dist_large_m"), 6, "log_dist_m", "log_dist_large_m")


@query("nearest_arc", "G2, G17", f"""
    SELECT c.id, round(min({ARC}), 3) AS dist_m, (min({ARC}) < 500)::int AS near_500, (min({ARC}) <= 1000)::int AS near_1000 FROM cust c, stations p GROUP BY c.id""")
def nearest_arc(t: Tables):
    out = spatial.nearest_distance(t.cust.select("id", "lat", "lon"), t.stations, "dist_m", metric="haversine")
    out = out.select("id", "dist_m", near_flag("dist_m", 500).alias("near_500"), near_flag("dist_m", 1000, inclusive=True).alias("near_1000"))
    return rounded(out, 3, "dist_m")


@query("nearest_attributes", "G3", f"""
    SELECT id, station, line, round(d, 3) AS dist_m FROM (SELECT c.id, p.name AS station, p.line, {FLAT} AS d,
      row_number() OVER (PARTITION BY c.id ORDER BY {FLAT}, p.id) AS k FROM cust c, stations p) WHERE k = 1""")
def nearest_attributes(t: Tables):
    out = spatial.nearest_attrs(t.cust.select("id", "lat", "lon"), t.stations, ["name", "line"], "dist_m")
    return rounded(out.select("id", F.col("name").alias("station"), "line", "dist_m"), 3, "dist_m")


@query("nearest_express", "G16, G17", f"""
    WITH d AS (SELECT c.id, min({FLAT}) AS a, min({FLAT}) FILTER (WHERE p.line % 3 = 0) AS e FROM cust c, stations p GROUP BY c.id)
    SELECT id, round(e, 3) AS dist_express_m, (e <= a + 50)::int AS nearest_is_express FROM d""")
def nearest_express(t: Tables):
    index = spatial.index_points(t.stations, {"any": F.lit(True), "express": F.col("line") % 3 == 0})
    out = spatial.nearest_strata(t.cust.select("id", "lat", "lon"), index, {"any_m": "any", "dist_express_m": "express"})
    flag = (F.col("dist_express_m") <= F.col("any_m") + 50).cast("int").alias("nearest_is_express")
    return rounded(out.select("id", "dist_express_m", flag), 3, "dist_express_m")


@query("count_arc", "G4", f"""
    SELECT c.id, count(*) FILTER (WHERE {ARC} <= 1000) AS n_1km, count(*) FILTER (WHERE {ARC} <= 5000) AS n_5km FROM cust c, poi p GROUP BY c.id""")
def count_arc(t: Tables):
    index = spatial.index_points(t.poi, {"all": F.lit(True)})
    subjects = t.cust.select("id", "lat", "lon")
    at = spatial.query_places(subjects)
    out = spatial.count_within(subjects, index, 1000, {"n_1km": "all"}, places=at)
    return spatial.count_within(out, index, 5000, {"n_5km": "all"}, places=at).drop("lat", "lon")


@query("count_by_category", "G5", f"""
    SELECT c.id, count(*) FILTER (WHERE {ARC} <= 3000 AND p.kind = 'ECONOMY') AS "ECONOMY_count", count(*) FILTER (WHERE {ARC} <= 3000 AND p.kind = 'PROMO') AS "PROMO_count"
    FROM cust c, poi p GROUP BY c.id""")
def count_by_category(t: Tables):
    return spatial.count_within_by_category(t.cust.select("id", "lat", "lon"), t.poi, "kind", ["ECONOMY", "PROMO"], 3000).drop("lat", "lon")


@query("count_flat", "G6", f"""
    SELECT c.id, count(*) FILTER (WHERE {FLAT} <= 800) AS n_comps FROM cust c, (SELECT * FROM sales) p GROUP BY c.id""")
def count_flat(t: Tables):
    return spatial.count_within(t.cust.select("id", "lat", "lon"), t.sales, 800, {"n_comps": F.lit(True)}, metric="flat").drop("lat", "lon")


@query("commercial_buckets", "S10, C4, G4, A11", f"""
    WITH n AS (SELECT c.id, count(*) FILTER (WHERE {ARC} <= 4000 AND p.brand IN ('Brand#1')) AS hyper, count(*) FILTER (WHERE {ARC} <= 4000 AND p.brand IN ('Brand#2', 'Brand#3')) AS super,
      count(*) FILTER (WHERE {ARC} <= 4000 AND p.brand IN ('Brand#3', 'Brand#4')) AS bank FROM cust c, poi p GROUP BY c.id)
    SELECT id, hyper, super, bank, hyper * 3 + super * 2 + bank AS score FROM n""")
def commercial_buckets(t: Tables):
    from ..operators.features import commercial_density

    sets = {"hyper": ["Brand#1"], "super": ["Brand#2", "Brand#3"], "bank": ["Brand#3", "Brand#4"]}
    out = spatial.count_within(t.cust.select("id", "lat", "lon"), t.poi, 4000, {n: F.col("brand").isin(v) for n, v in sets.items()})
    score = commercial_density(out, {n: n for n in sets}, {"hyper": 3, "super": 2, "bank": 1}, "score")
    return score.drop("lat", "lon")


@query("bucket_mix", "S10, A11", """
    SELECT bucket, count(*) AS n_places, count(DISTINCT kind) AS n_kind FROM (
      SELECT 'hyper' AS bucket, * FROM poi WHERE brand = 'Brand#1' UNION ALL SELECT 'super', * FROM poi WHERE brand IN ('Brand#1', 'Brand#2')) GROUP BY bucket""")
def bucket_mix(t: Tables):
    from ..sources.places import bucket_poi

    b = bucket_poi(t.poi, "brand", {"hyper": ["Brand#1"], "super": ["Brand#1", "Brand#2"]})
    n = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_places"))
    return n.join(aggregates.distinct_by(b, ["bucket"], ["kind"]), "bucket")


COMPS = f"""WITH d AS (SELECT c.id, p.id AS sale, p.price, {FLAT} AS m, row_number() OVER (PARTITION BY c.id ORDER BY {FLAT}, p.id) AS k, min({FLAT}) OVER (PARTITION BY c.id) AS best
      FROM stations c, sales p), f AS (SELECT * FROM d WHERE k <= 8 AND (m <= 800 OR best > 800))"""


@query("comparables", "G7, V4", f"""{COMPS} SELECT id, sale, k AS rank, price, round_even(m, 0)::bigint AS distance_m FROM f""")
def comparables(t: Tables):
    sales = t.sales.select(F.col("id").alias("sale"), "price", "lat", "lon")
    out = spatial.comparables(t.stations, sales, 800, 8, ["price"], p_id="sale", keep=["id"])
    return out.select("id", "sale", F.col("rank").cast("bigint").alias("rank"), "price", "distance_m")


@query("comparables_report", "V4", f"""{COMPS}
    SELECT id, count(*) AS n_comps, round(median(price), 4) AS comp_median, min(price) AS comp_min, max(price) AS comp_max,
           round((50000 / median(price) - 1) * 100, 4) AS delta_pct, round(CASE WHEN max(price) = min(price) THEN 0.5 ELSE greatest(0, least(1, (50000 - min(price)) / (max(price) - min(price)))) END, 6) AS position
    FROM f GROUP BY id""")
def comparables_report(t: Tables):
    from ..products.valuation import comparables_report as report

    sales = t.sales.select(F.col("id").alias("sale"), "price", "lat", "lon")
    subjects = t.stations.select("id", "lat", "lon", F.lit(50000.0).alias("value"))
    out = report(subjects, sales, "id", "value", "price", sale_id="sale", radius_m=800, limit=8)
    return rounded(rounded(out, 4, "comp_median", "delta_pct"), 6, "position")


@query("inverse_distance", "G8", f"""
    WITH d AS (SELECT c.id, p.bal, greatest({FLAT}, 1) AS m, row_number() OVER (PARTITION BY c.id ORDER BY {FLAT}, p.id) AS k FROM cust c, stations p)
    SELECT id, round(sum(bal / m) / sum(1 / m), 6) AS bal_idw FROM d WHERE k <= 2 GROUP BY id""")
def inverse_distance(t: Tables):
    return rounded(spatial.idw(t.cust.select("id", "lat", "lon"), t.stations, ["bal"]).select("id", "bal_idw"), 6, "bal_idw")


# One polygon per nation: a grid of rectangles with shared borders, every third one notched, every fifth one holed.
CELL_W, CELL_H = 0.12, 0.1


def nation_regions(t: Tables):
    k = F.col("n_nationkey")
    x0, y0 = F.lit(-74.30033) + (k % 5) * F.lit(CELL_W), F.lit(40.45037) + F.floor(k / 5).cast("double") * F.lit(CELL_H)
    p = lambda fx, fy: F.struct((x0 + fx * CELL_W).alias("lon"), (y0 + fy * CELL_H).alias("lat"))
    square = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1), p(0, 0))
    notched = F.array(p(0, 0), p(1, 0), p(1, 1), p(0.5, 0.5), p(0, 1))
    hole = F.array(p(0.25, 0.125), p(0.75, 0.125), p(0.75, 0.375), p(0.25, 0.375))
    rings = F.when(k % 5 == 0, F.array(square, hole)).when(k % 3 == 0, F.array(notched)).otherwise(F.array(square))
    return t.nation.select(F.format_string("N%02d", k).alias("code"), F.array(rings).alias("parts"), F.col("n_nationkey").alias("nation"),
                           ((k + 1) * 100).cast("double").alias("population"))


REGIONS = """g AS (SELECT 'N' || lpad(n_nationkey::varchar, 2, '0') AS code, n_nationkey AS k, -74.30033 + (n_nationkey % 5) * 0.12 AS x0, 40.45037 + (n_nationkey // 5) * 0.1 AS y0, (n_nationkey + 1) * 100.0 AS population FROM nation)"""
# closed form of the same shapes: inside the rectangle, above no notch line, outside the hole
INSIDE = """p.lon > x0 AND p.lon < x0 + 0.12 AND p.lat > y0 AND p.lat < y0 + 0.1
    AND NOT (k % 5 = 0 AND p.lon > x0 + 0.03 AND p.lon < x0 + 0.09 AND p.lat > y0 + 0.0125 AND p.lat < y0 + 0.0375)
    AND NOT (k % 5 <> 0 AND k % 3 = 0 AND (p.lat - y0) / 0.1 > greatest((p.lon - x0) / 0.12, 1 - (p.lon - x0) / 0.12))"""


@query("assign_region", "G9, G10", f"""WITH {REGIONS} SELECT p.id, g.code FROM poi p LEFT JOIN g ON {INSIDE}""")
def assign_region(t: Tables):
    return regions.assign_region(t.poi.select("id", "lat", "lon"), nation_regions(t)).select("id", "code")


@query("region_rates", "G11", f"""
    WITH {REGIONS} SELECT g.code, count(*) AS n_events, round(count(*) / greatest(any_value(population), 1) * 1000, 6) AS rate FROM ev p JOIN g ON {INSIDE} GROUP BY g.code""")
def region_rates(t: Tables):
    return rounded(regions.region_rate(t.ev, nation_regions(t), "population"), 6, "rate")


@query("region_log_density", "G12", f"""
    WITH {REGIONS}, h AS (SELECT g.code, p.kind FROM ev p JOIN g ON {INSIDE}), pop AS (SELECT code, CASE WHEN k % 4 <> 0 THEN population END AS population FROM g), m AS (SELECT median(population) AS mid FROM pop)
    SELECT h.code, round(ln(1 + count(*) FILTER (WHERE kind IN ('click', 'view')) / (any_value(coalesce(population, mid)) / 1000 + 1e-6)), 6) AS seen_log_density,
           round(ln(1 + count(*) FILTER (WHERE kind = 'error') / (any_value(coalesce(population, mid)) / 1000 + 1e-6)), 6) AS bad_log_density
    FROM h JOIN pop USING (code), m GROUP BY h.code""")
def region_log_density(t: Tables):
    shapes = nation_regions(t)
    placed = regions.assign_region(t.ev, shapes).filter(F.col("code").isNotNull())
    pop = shapes.select("code", F.when(F.col("nation") % 4 != 0, F.col("population")).alias("population"))
    out = regions.region_log_density(placed, "code", "kind", {"seen": ["click", "view"], "bad": ["error"]}, pop, "population")
    return rounded(out, 6, "seen_log_density", "bad_log_density")


@query("district_centroids", "G14, S20", """
    WITH m AS (SELECT region::varchar AS district, avg(lat) AS lat, avg(lon) AS lon FROM cust WHERE region % 4 <> 1 GROUP BY region),
    f AS (SELECT line::varchar AS district, avg(lat) AS lat, avg(lon) AS lon FROM stations WHERE line % 2 = 1 GROUP BY line)
    SELECT n_nationkey::varchar AS district, round(coalesce(CASE WHEN n_nationkey = 7 THEN 40.7 END, m.lat, f.lat, 40.71), 8) AS district_lat,
           round(coalesce(CASE WHEN n_nationkey = 7 THEN -74.0 END, m.lon, f.lon, -73.99), 8) AS district_lon
    FROM nation LEFT JOIN m ON m.district = n_nationkey::varchar LEFT JOIN f ON f.district = n_nationkey::varchar""")
def district_centroids(t: Tables):
    places = t.cust.filter("region % 4 <> 1").withColumn("d", F.col("region").cast("string"))
    fallback = t.stations.filter("line % 2 = 1").groupBy(F.col("line").cast("string").alias("district")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    fixed = t.nation.filter("n_nationkey = 7").select(F.col("n_nationkey").cast("string").alias("district"), F.lit(40.7).alias("lat"), F.lit(-74.0).alias("lon"))
    c = regions.district_centroids(places, "d", "lat", "lon", fallback, fixed)
    out = regions.attach_centroid(t.nation.select(F.col("n_nationkey").cast("string").alias("district")), "district", c, (40.71, -73.99))
    return rounded(out, 8, "district_lat", "district_lon")


@query("vertex_centroids", "G15", f"""
    WITH {REGIONS} SELECT code, round(y0 + 0.1 * CASE WHEN k % 5 = 0 THEN 3.0 / 9 WHEN k % 3 = 0 THEN 0.5 ELSE 0.4 END, 6) AS lat,
       round(x0 + 0.12 * CASE WHEN k % 5 = 0 THEN 4.0 / 9 WHEN k % 3 = 0 THEN 0.5 ELSE 0.4 END, 6) AS lon FROM g""")
def vertex_centroids(t: Tables):
    return rounded(regions.vertex_centroid(nation_regions(t)), 6, "lat", "lon")


@query("boundary_vertices", "S8", """
    SELECT (CASE WHEN i < 5 THEN i WHEN i < 10 THEN 5 WHEN i < 15 THEN 15 - i ELSE 0 END)::double AS lon,
           (CASE WHEN i < 5 THEN 0 WHEN i < 10 THEN i - 5 WHEN i < 15 THEN 5 ELSE 20 - i END)::double AS lat
    FROM (SELECT unnest(range(20)) AS i) WHERE i % 3 = 0""")
def boundary_vertices(t: Tables):
    # a block of unit squares without the one in the middle, half of them drawn clockwise: the gap is no part of the outline
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    p = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))
    cells = t.nation.filter(k != 12).select(k.alias("code"), F.array(F.array(F.when(k % 2 == 0, ring).otherwise(F.reverse(ring)))).alias("parts"))
    return regions.boundary_vertices(cells)


@query("proximity_profile", "G3, J3, C1", f"""
    WITH n AS (SELECT id, line FROM (SELECT c.id, p.line, row_number() OVER (PARTITION BY c.id ORDER BY {FLAT}, p.id) AS k FROM cust c, stations p) WHERE k = 1),
    d AS (SELECT line, avg(bal) AS line_bal FROM stations GROUP BY line) SELECT n.id, round(line_bal, 4) AS line_bal FROM n JOIN d USING (line)""")
def proximity_profile(t: Tables):
    near = spatial.nearest_attrs(t.cust.select("id", "lat", "lon"), t.stations, ["line"])
    dim = t.stations.groupBy("line").agg(F.avg("bal").alias("line_bal"))
    return rounded(attach(near, dim, ["line"]).select("id", "line_bal"), 4, "line_bal")
