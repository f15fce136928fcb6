"""Reader, writer and parser queries. Inputs are derived from the standard tables; file formats make a round trip through
the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions, spatial
from ..session import scratch_path
from ..sources import deals as D
from ..sources import collections, dims, places
from ..sources import tables as S
from .registry import Tables, query, rounded


@query("typed_csv", "S1, S17", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 5 <> 0""")
def typed_csv(t: Tables):
    path = scratch_path(t.spark, "csv")
    k = F.col("o_orderkey")
    S.write_csv(t.orders.select(k.alias("id"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"),
                                F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")), path)
    return S.read_table(t.spark, path, "id bigint, price double, day string", require=["id", "day"])


@query("lenient_csv", "S2, S3, S4, S17", """
    SELECT s_name AS station, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_nationkey END::int AS quarter, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS value FROM supplier""")
def lenient_csv(t: Tables):
    path = scratch_path(t.spark, "lenient")
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.col("s_name").alias("Station name"), F.when(k % 4 == 1, "NULL").otherwise("third").alias("quarter text"),
        F.when(k % 4 == 1, "null").otherwise(F.col("s_nationkey").cast("string")).alias("quarter number"),
        F.when(k % 3 == 0, "null").otherwise(F.col("s_acctbal").cast("string")).alias("mean value (h)"))
    S.write_csv(raw, path, mark=True, sep=";")
    df = S.read_lenient_csv(t.spark, path, sep=";")
    quarter = S.pick_numeric_column(df, [c for c in df.columns if "quarter" in c])
    out = S.resolve_columns(df, {"station": ["Station"], "quarter": [quarter], "value": [("value", "(h)")]}, required=["station", "value"])
    return S.cast_columns(out, {"quarter": "int", "value": "double"})


@query("glob_and_versions", "S14, S15, U2", """
    SELECT count(*) AS n_all, count(*) FILTER (WHERE c_custkey % 3 = 2) AS n_latest, count(*) FILTER (WHERE c_custkey % 3 = 1) AS n_version FROM customer""")
def glob_and_versions(t: Tables):
    base = scratch_path(t.spark, "listings")
    rows = t.customer.select("c_custkey", "c_name")
    for part in range(3):
        S.write_csv(rows.filter(F.col("c_custkey") % 3 == part), f"{base}/listings_{part}")
    everything = S.read_glob(t.spark, f"{base}/listings_*", with_file="source_file")
    newest = S.read_glob(t.spark, f"{base}/listings_*", latest=True)
    version = S.read_first_existing(t.spark, [f"{base}/v9", f"{base}/listings_1", f"{base}/listings_0"], "csv", header=True)
    one = F.count(F.lit(1))
    return everything.agg(one.alias("n_all"), newest.agg(one).scalar().alias("n_latest"), version.agg(one).scalar().alias("n_version"))


def feature_rows(t: Tables):
    """Customers as GeoJSON feature texts: every fourth without a geometry but with a point property, every ninth with neither."""
    k = F.col("id")
    geometry = F.when(k % 4 != 0, F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    spot = F.when((k % 4 == 0) & (k % 9 != 0), F.struct("lat", "lon"))
    props = F.struct(F.col("id").cast("string").alias("id"), F.col("kind"), spot.alias("geo_point_2d"))
    return t.cust.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


@query("geojson_points", "S6", """SELECT id, kind, lat, lon FROM cust WHERE id % 4 <> 0 OR id % 9 <> 0""")
def geojson_points(t: Tables):
    path = scratch_path(t.spark, "geojson")
    feature_rows(t).write.text(path)
    out = places.geojson_points(places.read_features(t.spark, path), {"id": "id", "kind": "kind"})
    return out.withColumn("id", F.col("id").cast("bigint"))


@query("collection_points", "S6, S7, S18", """SELECT id, kind, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cust""")
def collection_points(t: Tables):
    path = scratch_path(t.spark, "collections")
    collections.write_collections(t.cust, places.point_geometry("lat", "lon"), {"id": F.col("id"), "kind": F.col("kind")}, path, by=["id"])
    out = places.geojson_points(collections.collection_features(t.spark, path), {"id": "id", "kind": "kind"})
    return out.withColumn("id", F.col("id").cast("bigint"))


@query("geojson_vertices", "S7", """
    SELECT id, count(*) AS n, round(sum(lat), 6) AS lat, round(sum(lon), 6) AS lon FROM (
      SELECT id, lat + 0.001 * i AS lat, lon + 0.002 * i AS lon FROM cust, (SELECT unnest(range(12)) AS i) WHERE CASE id % 3 WHEN 0 THEN i = 0 WHEN 1 THEN i % 3 = 0 ELSE i % 5 = 0 END) GROUP BY id""")
def geojson_vertices(t: Tables):
    k = F.col("id")
    step = lambda i: F.array(F.col("lon") + F.lit(0.002) * i, F.col("lat") + F.lit(0.001) * i)
    line = F.transform(F.sequence(F.lit(0), F.lit(11)), step)
    coords = F.when(k % 3 == 0, F.to_json(F.array("lon", "lat"))).when(k % 3 == 1, F.to_json(line)).otherwise(F.to_json(F.array(F.array(line))))
    kind = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "LineString").otherwise("MultiPolygon")
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":{}}'))
    v = places.geojson_vertices(places.features_from_text(t.cust.select("id", text.alias("value")), "value", ["id"]), keep=["id"])
    return rounded(v.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon")), 6, "lat", "lon")


@query("poi_classes", "S9", """
    WITH r AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'gym' WHEN 'PROMO' THEN 'pub' WHEN 'STANDARD' THEN 'drug_store' ELSE 'depot' END AS raw FROM part),
    l AS (SELECT raw, CASE raw WHEN 'gym' THEN 'gyms' WHEN 'pub' THEN 'bars' WHEN 'drug_store' THEN 'pharmacies' END AS label FROM r)
    SELECT coalesce(label, 'unmapped ' || raw) AS label, count(*) AS n_rows FROM l GROUP BY 1""")
def poi_classes(t: Tables):
    kind = F.col("p_type")
    raw = F.when(kind == "ECONOMY", "gym").when(kind == "PROMO", "pub").when(kind == "STANDARD", "drug_store").otherwise("depot")
    rows = t.part.select(F.when(F.col("p_partkey") % 2 == 0, raw).otherwise("").alias("basic"), raw.alias("primary"))
    labelled, unmapped = places.classify_poi(rows, "basic", "primary")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).unionByName(
        unmapped.select(F.concat(F.lit("unmapped "), F.col("raw_category")).alias("label"), "n_rows"))


@query("osm_points", "S11", """
    SELECT lat, lon, CASE WHEN s_suppkey % 2 = 0 THEN 'ع' || s_suppkey ELSE '' END AS name_ar, s_name AS name_en, s_suppkey::varchar AS osm_id, CASE WHEN s_suppkey % 3 = 0 THEN 'way' ELSE 'node' END AS osm_type
    FROM supplier JOIN stations ON s_suppkey = id WHERE s_suppkey % 6 <> 3""")
def osm_points(t: Tables):
    k = F.col("id")
    way = k % 3 == 0
    tags = F.map_filter(F.create_map(F.lit("name:ar"), F.when(k % 2 == 0, F.concat(F.lit("ع"), k.cast("string"))),
                                     F.when(k % 4 == 0, "name:en").otherwise("name"), F.col("name")), lambda _, v: v.isNotNull())
    rows = t.stations.select(F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(~way, F.col("lat")).alias("lat"), F.when(~way, F.col("lon")).alias("lon"),
                             F.when(way & (k % 6 != 3), F.struct("lat", "lon")).alias("center"), tags.alias("tags"))
    return places.osm_points(rows)


@query("landed_deals", "S12, P5, F8", """
    SELECT l_suppkey::varchar AS nh_id, l_extendedprice AS price_sar, 'فيلا' AS std_type, strftime(l_shipdate, '%Y-%m-%d') AS date, year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter_id, l_quantity AS area_sqm
    FROM lineitem WHERE l_returnflag <> 'N'""")
def landed_deals(t: Tables):
    rec = F.struct(F.col("l_suppkey").cast("string").alias("neighborhoodId"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("transactionDate"),
                   F.col("l_extendedprice").alias("transactionPrice"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / F.col("l_quantity")).otherwise(0.0).alias("priceOfMeter"),
                   F.col("l_quantity").alias("totalArea"), F.lit("فيلا").alias("propertyType"))
    flat = D.parse_transactions(t.lineitem.select(F.to_json(rec).alias("value")), "value")
    from ..functions.dates import quarter_id_from_text
    from ..functions.text import map_type

    return flat.select("nh_id", "price_sar", map_type("property_type", dims.DEED_TYPES, "equals").alias("std_type"), "date",
                       quarter_id_from_text("date").alias("quarter_id"), "area_sqm")


def listing_text(t: Tables):
    """Supplier-part offers as Arabic listing texts with varying units and gaps."""
    k = F.col("p_partkey")
    price = F.when(k % 5 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(" مليون"))).when(k % 5 == 1, F.concat((k % 700 + 200).cast("string"), F.lit(" ألف"))).when(
        k % 5 == 2, (k % 900 + 300).cast("string")).when(k % 5 == 3, F.format_number(k * 1000 + 400000, 0)).otherwise("على السوم")
    kind = F.when(k % 3 == 0, "فيلا دوبلكس").when(k % 3 == 1, "شقة").otherwise("محل")
    age = F.when(k % 4 == 0, "جديد").otherwise(F.concat((k % 30).cast("string"), F.lit(" سنوات")))
    text = F.concat(F.lit("السعر: "), price, F.lit("\nمساحة العقار: "), (k % 400 + 100).cast("string"), F.lit("\nعدد الغرف: "), (k % 7 + 1).cast("string"),
                    F.lit("\nعدد دورات المياه: "), (k % 5 + 1).cast("string"), F.lit("\nنوع العقار: "), kind, F.lit("\nعمر العقار: "), age, F.lit("\nالمدينة: الرياض\nالحي: "),
                    F.col("p_brand"), F.lit("\nhttps://maps.google.com/?q=24.7"), (k % 10).cast("string"), F.lit(",46.6"))
    # a few bytes of a row become a text of hundreds: rows are dealt out evenly, however few files hold them
    rows = t.part.select("p_partkey", "p_brand").repartition(2 * t.spark.sparkContext.defaultParallelism)
    return rows.select(k.alias("id"), text.alias("text"))


OFFERS = """o AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 9 + 1) * 1e6 WHEN 1 THEN (p_partkey % 700 + 200) * 1e3 WHEN 2 THEN (p_partkey % 900 + 300) * 1e3 WHEN 3 THEN p_partkey * 1e3 + 400000 END::double AS price_sar,
    (p_partkey % 400 + 100)::double AS area_sqm, (p_partkey % 7 + 1)::int AS bedrooms, (p_partkey % 5 + 1)::int AS bathrooms, CASE p_partkey % 3 WHEN 0 THEN 'villa' WHEN 1 THEN 'apartment' ELSE 'other' END AS property_type_en,
    CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 30 END::int AS age_years, p_brand AS district, ('24.7' || (p_partkey % 10))::double AS lat, 46.6::double AS lon FROM part)"""


@query("listing_texts", "F13", f"""WITH {OFFERS} SELECT *, CASE id % 3 WHEN 0 THEN 'فيلا دوبلكس' WHEN 1 THEN 'شقة' ELSE 'محل' END AS property_type_ar, 'الرياض' AS city FROM o""")
def listing_texts(t: Tables):
    from ..functions.text import parse_listing_text

    return parse_listing_text(listing_text(t), "text").drop("text")


@query("listing_pages", "S13, F13, F14, P7", f"""
    WITH {OFFERS} SELECT id::varchar AS listing_id, district, price_sar, area_sqm, round_even(price_sar / area_sqm, 2) AS price_per_sqm, 'villa' AS property_type_en, bedrooms, age_years, '2025-06-0' || (id % 9 + 1) AS listing_date
    FROM o WHERE id % 6 <> 5 AND property_type_en = 'villa' AND price_sar BETWEEN 100000 AND 50000000 AND price_sar / area_sqm BETWEEN 300 AND 40000
    UNION ALL SELECT id::varchar, district, price_sar, area_sqm, round_even(price_sar / area_sqm, 2), 'apartment', bedrooms, age_years, '2025-06-0' || (id % 9 + 1)
    FROM o WHERE id % 6 <> 5 AND property_type_en = 'apartment' AND price_sar BETWEEN 100000 AND 50000000 AND price_sar / area_sqm BETWEEN 300 AND 40000 AND area_sqm <= 1000""")
def listing_pages(t: Tables):
    k = F.col("id")
    # ten listings per page; every sixth part lies in another city
    item = F.struct(F.lit("RealEstateListing").alias("@type"), F.struct(F.when(k % 6 == 5, "جدة").otherwise("الرياض").alias("addressLocality")).alias("address"),
                    F.concat(F.lit("https://site.example/"), k.cast("string"), F.lit("/offer/")).alias("url"), F.col("text").alias("description"),
                    F.concat(F.lit("2025-06-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00")).alias("datePosted"))
    doc = F.struct(F.struct(F.collect_list(F.struct(item.alias("item"))).alias("itemListElement")).alias("mainEntity"))
    pages = listing_text(t).groupBy(F.floor(k / 10).alias("page")).agg(F.concat(
        F.lit('<html><head><script type="application/ld+json" id="json-ld-posts-list">'), F.to_json(doc), F.lit("</script></head><body>…</body></html>")).alias("html"))
    out = D.listings_from_pages(pages, "html", source="site")
    return out.select("listing_id", "district", "price_sar", "area_sqm", "price_per_sqm", "property_type_en", "bedrooms", "age_years", "listing_date")


@query("embedded_scripts", "S13, F13, P7", """
    SELECT page_id, page_id::varchar AS listing_id, (page_id % 700 + 200) * 1000.0::double AS price_sar, (page_id % 400 + 100)::double AS area_sqm, 'apartment' AS property_type_en
    FROM pages WHERE page_id % 3 <> 0""")
def embedded_scripts(t: Tables):
    # two of three standard pages carry a listing behind their own markup, one a list of another kind: it must give no rows
    k = F.col("page_id")
    words = F.concat(F.lit("السعر: "), (k % 700 + 200).cast("string"), F.lit(" ألف\nمساحة العقار: "), (k % 400 + 100).cast("string"), F.lit("\nنوع العقار: شقة\nالمدينة: الرياض"))
    item = F.struct(F.when(k % 3 == 0, "NewsArticle").otherwise("RealEstateListing").alias("@type"), F.struct(F.lit("الرياض").alias("addressLocality")).alias("address"),
                    F.concat(F.lit("https://site.example/"), k.cast("string"), F.lit("/offer/")).alias("url"), words.alias("description"), F.lit("2025-06-01T10:00:00").alias("datePosted"))
    doc = F.struct(F.struct(F.array(F.struct(item.alias("item"))).alias("itemListElement")).alias("mainEntity"))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json" id="json-ld-posts-list">'), F.to_json(doc), F.lit("</script>"))
    found = D.listings_from_pages(t.pages.select("page_id", html.alias("html")), "html", keep=["page_id"])
    return found.select("page_id", "listing_id", "price_sar", "area_sqm", "property_type_en")


@query("keyed_documents", "S16, V3", """
    SELECT n_regionkey AS region, n_name AS key, (n_nationkey * 10 + 5)::double AS price, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS tier FROM nation""")
def keyed_documents(t: Tables):
    entry = F.struct((F.col("n_nationkey") * 10 + 5).alias("price"), F.when(F.col("n_nationkey") % 2 == 0, "high").otherwise("low").alias("tier"))
    doc = F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", entry))).alias("districts")).alias("market")))
    docs = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(doc.alias("body"))
    return S.keyed_json(docs, "body", "struct<price:double,tier:string>", "market.districts", keep=["region"])


@query("event_properties", "S16", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def event_properties(t: Tables):
    return S.json_paths(t.events, "props", {"k": ("k", "int")}, keep=["event_id"])


@query("geojson_layer", "S18, V6, V7", """
    SELECT region, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (region * 0.5)::double::varchar || ',' || (region + 10)::double::varchar || ']},"properties":{"region":' || region::varchar
      || CASE WHEN count(*) > 560 THEN ',"n":' || count(*)::varchar ELSE '' END || '}}' AS value FROM sales GROUP BY region""")
def geojson_layer(t: Tables):
    n = t.sales.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumns({"lat": (F.col("region") + 10).cast("double"), "lon": F.col("region") * 0.5})
    value = places.feature_json(places.point_geometry("lat", "lon"), {"region": F.col("region"), "n": F.when(F.col("n") > 560, F.col("n"))})
    return n.select("region", value.alias("value"))


@query("layer_round_trip", "S18, S7, G10", """SELECT n_nationkey AS nation, 1 AS n_parts, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS n_rings FROM nation""")
def layer_round_trip(t: Tables):
    from .spatial import nation_regions

    path = scratch_path(t.spark, "layer")
    places.write_geojson(nation_regions(t), places.polygon_geometry("parts"), {"code": F.col("code"), "nation": F.col("nation")}, path)
    back = places.geojson_regions(places.read_features(t.spark, path), "code", {"nation": "nation"})
    return back.select(F.col("nation").cast("int").alias("nation"), F.size("parts").alias("n_parts"), F.size(F.col("parts")[0]).alias("n_rings"))


@query("json_report", "S17, S19", """SELECT region, count(*) AS n, round(avg(price), 4) AS mean_price FROM sales GROUP BY region""")
def json_report(t: Tables):
    path = scratch_path(t.spark, "report")
    S.write_json(rounded(t.sales.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")), 4, "mean_price"), path)
    return t.spark.read.schema("region int, n bigint, mean_price double").json(path)


def point_rows(points: dict) -> str:
    """The rows of a fixed table for SQL."""
    return "VALUES " + ", ".join(f"('{k}', {lat}::double, {lon}::double)" for k, (lat, lon) in points.items())


DISTRICTS = sorted({*dims.FALLBACK_CENTROIDS, *dims.OVERRIDE_CENTROIDS})


@query("known_districts", "S20, G14", f"""
    WITH names AS (SELECT unnest({DISTRICTS!r}) AS district, unnest(range({len(DISTRICTS)})) AS i),
    m AS (SELECT district, avg(lat) AS lat, avg(lon) AS lon FROM cust JOIN names ON i = id % 40 GROUP BY district),
    f(district, lat, lon) AS ({point_rows(dims.FALLBACK_CENTROIDS)}), o(district, lat, lon) AS ({point_rows(dims.OVERRIDE_CENTROIDS)})
    SELECT district, round(coalesce(o.lat, m.lat, f.lat), 8) AS lat, round(coalesce(o.lon, m.lon, f.lon), 8) AS lon
    FROM m FULL JOIN f USING (district) LEFT JOIN o USING (district)""")
def known_districts(t: Tables):
    name = F.element_at(F.array(*[F.lit(d) for d in DISTRICTS]), (F.col("id") % 40 + 1).cast("int"))
    places = t.cust.filter(F.col("id") % 40 < len(DISTRICTS)).withColumn("district", name)
    out = regions.district_centroids(places, "district", "lat", "lon", dims.dim_points(t.spark, dims.FALLBACK_CENTROIDS), dims.dim_points(t.spark, dims.OVERRIDE_CENTROIDS))
    return rounded(out, 8, "lat", "lon")


@query("nearest_fixed_points", "S20, G3", f"""
    WITH p(name, lat, lon) AS ({point_rows({f"h{k}": v for k, v in dims.HEALTH_AREAS.items()} | {f"a{i}": v for i, v in enumerate(dims.AIR_STATIONS.values())})})
    SELECT id, name FROM (SELECT c.id, p.name, row_number() OVER (PARTITION BY c.id ORDER BY sqrt(pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2)) * 111000, p.name) AS k FROM cust c, p) WHERE k = 1""")
def nearest_fixed_points(t: Tables):
    points = dims.dim_points(t.spark, {f"h{k}": v for k, v in dims.HEALTH_AREAS.items()} | {f"a{i}": v for i, v in enumerate(dims.AIR_STATIONS.values())}, "id")
    points = points.withColumn("name", F.col("id"))
    return spatial.nearest_attrs(t.cust.select("id", "lat", "lon"), points, ["name"]).select("id", "name")


@query("fixed_dimensions", "S20", """
    SELECT id, (borough + 1)::int AS borough, CASE borough WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens' ELSE 'Staten Island' END AS borough_name FROM sales""")
def fixed_dimensions(t: Tables):
    names = dims.dim_map(t.spark, dims.BOROUGHS, "borough", "borough_name")
    rows = t.sales.select("id", (F.col("borough") + 1).cast("string").alias("borough"))
    return rows.join(names, "borough").withColumn("borough", F.col("borough").cast("int"))
