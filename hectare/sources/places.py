"""GeoJSON, OSM elements and POI categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regions import PARTS_TYPE

# ---- fixed values: vertex strides and POI vocabulary ----
LINE_STRIDE = 3
RING_STRIDE = 5
POI_CATEGORIES = {
    "gym": "gyms", "fitness_center": "gyms", "yoga_studio": "gyms", "martial_arts_school": "gyms", "sports_club": "gyms",
    "pharmacy": "pharmacies", "drug_store": "pharmacies",
    "coffee_shop": "coffee_shops", "tea_room": "coffee_shops",
    "grocery_store": "grocery_stores", "supermarket": "grocery_stores", "convenience_store": "grocery_stores",
    "wholesale_store": "grocery_stores",
    "atm": "atms",
    "movie_theater": "cinemas", "cinema": "cinemas",
    "library": "libraries", "public_library": "libraries",
    "childcare": "childcare", "child_care_facility": "childcare", "preschool": "childcare",
    "urgent_care": "urgent_care", "medical_clinic": "urgent_care", "healthcare_location": "urgent_care",
    "bar": "bars", "cocktail_bar": "bars", "pub": "bars", "wine_bar": "bars",
    "bicycle_shop": "bike_shops", "bicycle_store": "bike_shops",
    "beauty_salon": "beauty_salons", "hair_salon": "beauty_salons", "nail_salon": "beauty_salons",
    "hotel": "hotels", "hostel": "hotels", "motel": "hotels",
}
COMMERCIAL_BUCKETS = {
    "hypermarket": ["HypMkt"],
    "supermarket": ["SupMkt", "MktS", "GroS"],
    "bank": ["Bank"],
    "restaurant": ["Res"],
    "hotel": ["Hot", "HotAp"],
    "gas_station": ["GasStation", "PetStation"],
    "commercial_complex": ["ComC", "ComX"],
}
# ---- end of fixed values ----

FEATURE = "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def read_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """GeoJSON features as column ``feature``: one feature per line, or whole FeatureCollection files (``lines=False``).

    A collection is one JSON document, which one task reads in full here; ``collections.collection_features`` reads it by byte ranges.
    """
    if lines:
        return features_from_text(spark.read.text(path).filter(F.trim("value") != ""), "value")
    return features_from_collection(spark.read.text(path, wholetext=True), "value")


def features_from_text(df: DataFrame, json_col: str, keep: list[str] = ()) -> DataFrame:
    """One feature per row from a column of GeoJSON feature texts."""
    return df.select(*keep, F.from_json(F.regexp_replace(json_col, r",\s*$", ""), FEATURE).alias("feature"))


def features_from_collection(df: DataFrame, json_col: str, keep: list[str] = ()) -> DataFrame:
    """Features of a column of FeatureCollection texts."""
    doc = F.from_json(json_col, f"struct<features:array<{FEATURE}>>")
    return df.select(*keep, F.explode(doc["features"]).alias("feature"))


def geojson_points(features: DataFrame, props: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """Point table (lat, lon, named properties): from the geometry, else from the ``geo_point_2d`` property; features
    with neither are dropped."""
    c = F.from_json("feature.geometry.coordinates", "array<double>")
    is_point = F.col("feature.geometry.type") == "Point"
    alt = F.from_json(F.col("feature.properties")["geo_point_2d"], "struct<lat:double,lon:double>")
    lat = F.coalesce(F.when(is_point, F.get(c, F.lit(1))), alt["lat"])
    lon = F.coalesce(F.when(is_point, F.get(c, F.lit(0))), alt["lon"])
    out = features.select(*keep, lat.alias("lat"), lon.alias("lon"), *[F.col("feature.properties")[p].alias(n) for n, p in props.items()])
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def geojson_vertices(features: DataFrame, line_stride: int = LINE_STRIDE, ring_stride: int = RING_STRIDE,
                     keep: list[str] = ()) -> DataFrame:
    """Sampled vertices (lat, lon) of any geometry: points all, lines and rings every n-th vertex."""
    kind, raw = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    one = F.array(F.array(F.from_json(raw, "array<double>")))
    many = F.from_json(raw, "array<array<double>>")
    nested = F.from_json(raw, "array<array<array<double>>>")
    paths = (F.when(kind == "Point", one).when(kind.isin("MultiPoint", "LineString"), F.array(many))
             .when(kind.isin("MultiLineString", "Polygon"), nested)
             .when(kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>"))))
    stride = F.when(kind.isin("LineString", "MultiLineString"), line_stride).when(kind.isin("Polygon", "MultiPolygon"), ring_stride).otherwise(1)
    path = features.select(*keep, stride.alias("_s"), F.explode(paths).alias("_p"))
    v = path.select(*keep, "_s", F.posexplode("_p").alias("_i", "_v")).filter(F.col("_i") % F.col("_s") == 0)
    return v.select(*keep, F.get("_v", F.lit(1)).alias("lat"), F.get("_v", F.lit(0)).alias("lon"))


def geojson_regions(features: DataFrame, code: str, props: dict[str, str] | None = None) -> DataFrame:
    """Region table (code, parts, named properties) from Polygon and MultiPolygon features."""
    kind, raw = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    multi = F.when(kind == "Polygon", F.array(F.from_json(raw, "array<array<array<double>>>"))).when(
        kind == "MultiPolygon", F.from_json(raw, "array<array<array<array<double>>>>"))
    point = lambda v: F.struct(F.get(v, F.lit(0)).alias("lon"), F.get(v, F.lit(1)).alias("lat"))
    parts = F.transform(multi, lambda p: F.transform(p, lambda r: F.transform(r, point))).cast(PARTS_TYPE)
    return features.select(F.col("feature.properties")[code].alias("code"), parts.alias("parts"),
                           *[F.col("feature.properties")[p].alias(n) for n, p in (props or {}).items()]).filter(F.col("parts").isNotNull())


def osm_points(df: DataFrame, category: str | None = None) -> DataFrame:
    """OSM elements (type, id, lat, lon, center, tags) → points: nodes by their own, others by their centre coordinates."""
    node = F.col("type") == "node"
    lat = F.when(node, F.col("lat")).otherwise(F.col("center.lat"))
    lon = F.when(node, F.col("lon")).otherwise(F.col("center.lon"))
    tag = lambda *names: F.coalesce(*[F.col("tags")[n] for n in names], F.lit(""))
    cols = [lat.alias("lat"), lon.alias("lon"), tag("name:ar").alias("name_ar"), tag("name:en", "name").alias("name_en"),
            F.col("id").cast("string").alias("osm_id"), F.col("type").alias("osm_type")]
    out = df.select(*([F.lit(category).alias("category")] if category else []), *cols)
    return out.filter(F.col("lat").isNotNull())


def classify_poi(df: DataFrame, basic: str, primary: str, mapping: dict[str, str] = POI_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(rows with ``label``, counts of unmapped categories): first non-empty of two category columns, many to one label."""
    raw = F.coalesce(F.nullif(F.col(basic), F.lit("")), F.col(primary), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    tagged = df.withColumn("raw_category", raw).withColumn("label", F.try_element_at(table, F.col("raw_category")))
    unmapped = tagged.filter(F.col("label").isNull()).groupBy("raw_category").agg(F.count(F.lit(1)).alias("n_rows"))
    return tagged.filter(F.col("label").isNotNull()), unmapped


def bucket_poi(df: DataFrame, code: str, buckets: dict[str, list[str]] = COMMERCIAL_BUCKETS) -> DataFrame:
    """One row per (place, bucket) the place's code belongs to; buckets may overlap."""
    hits = F.array_compact(F.array(*[F.when(F.col(code).isin(v), F.lit(b)) for b, v in buckets.items()]))
    return df.withColumn("bucket", F.explode(hits))


def feature_json(geometry: Column, props: dict[str, Column]) -> Column:
    """GeoJSON feature text; null properties are left out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              F.struct(*[c.alias(n) for n, c in props.items()]).alias("properties")))


def point_geometry(lat: str, lon: str, digits: int = 6) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col(lon), digits), F.round(F.col(lat), digits)).alias("coordinates"))


def polygon_geometry(parts: str) -> Column:
    coords = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["lon"], v["lat"]))))
    return F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))


def geojson_lines(df: DataFrame, geometry: Column, props: dict[str, Column]) -> DataFrame:
    """One feature text per row (``value``)."""
    return df.select(feature_json(geometry, props).alias("value"))


def write_geojson(df: DataFrame, geometry: Column, props: dict[str, Column], path: str) -> None:
    """Layer as text files with one feature per line, written in parallel."""
    geojson_lines(df, geometry, props).write.mode("errorifexists").text(path)
