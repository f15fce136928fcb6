"""Cleaning, scalar-function and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, numbers, text
from ..operators import clean, ranking
from ..operators.features import CLASS_RULES
from ..sources.dims import EXPRESS_ROUTES
from .registry import Tables, query, rounded


@query("valid_sales", "P1, P10", """
    SELECT id, lat, lon, price FROM sales WHERE price > 10000 AND id % 7 <> 0""")
def valid_sales(t: Tables):
    # coordinates and price arrive as text; every seventh latitude is unreadable
    raw = t.sales.select("id", F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("lat").cast("string")).alias("lat"),
                         F.concat(F.lit(" "), F.col("lon").cast("string")).alias("lon"), F.col("price").cast("string").alias("price"))
    return clean.valid_sales(raw, "price", "lat", "lon")


@query("bbox_filter", "P2", """
    SELECT id, (lat BETWEEN 40.5 AND 40.8 AND lon BETWEEN -74.2 AND -73.9)::int AS closed,
           (lat > 40.5 AND lat < 40.8 AND lon > -74.2 AND lon < -73.9)::int AS opened
    FROM cust WHERE lat BETWEEN 40.45 AND 40.95 AND lon BETWEEN -74.30 AND -73.70""")
def bbox_filter(t: Tables):
    box = (40.5, 40.8, -74.2, -73.9)
    return t.cust.filter(clean.in_bbox("lat", "lon", clean.NYC_BOX)).select(
        "id", clean.in_bbox("lat", "lon", box).cast("int").alias("closed"),
        clean.in_bbox("lat", "lon", box, inclusive=False).cast("int").alias("opened"))


@query("panel_filter", "P3", """
    WITH p AS (SELECT district, borough, kind, qid, count(*) AS deed_counts, avg(psqm) AS price FROM deals GROUP BY ALL)
    SELECT district, kind, qid, deed_counts, round(price, 4) AS price FROM p
    WHERE borough = 2 AND kind IN ('A', 'R') AND deed_counts >= 3 AND price > 0""")
def panel_filter(t: Tables):
    panel = t.deals.groupBy("district", "borough", "kind", "qid").agg(F.count(F.lit(1)).alias("deed_counts"), F.avg("psqm").alias("price"))
    kept = clean.clean_panel(panel, "borough", 2, "kind", ["A", "R"], "deed_counts", "price", "district")
    return rounded(kept.select("district", "kind", "qid", "deed_counts", "price"), 4, "price")


@query("standard_types", "P4", """
    WITH s AS (SELECT id, CASE WHEN kind IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' WHEN kind = 'MACHINERY' THEN 'works'
                               WHEN kind = 'BUILDING' AND borough = 1 THEN 'land' END AS std_type FROM sales)
    SELECT std_type, count(*) AS n_rows FROM s WHERE std_type IS NOT NULL GROUP BY std_type""")
def standard_types(t: Tables):
    rules = {"home": ["HOUSEHOLD", "FURNITURE"], "works": ["MACHINERY"]}
    use = t.sales.withColumn("use", F.when(F.col("borough") == 1, "residential").otherwise("other"))
    std = clean.standardise_type(use, "kind", "use", rules, "BUILDING", "land", "residential")
    return std.groupBy("std_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("type_mapping", "P5", """
    SELECT p_partkey AS id, CASE WHEN p_type LIKE '%ECON%' THEN 'small' WHEN p_type LIKE '%O%' THEN 'round' ELSE 'other' END AS by_part,
           CASE WHEN p_brand = 'Brand#1' THEN 'first' WHEN p_brand = 'Brand#2' THEN 'second' END AS by_name FROM part""")
def type_mapping(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"),
                         text.map_type("p_type", [("ECON", "small"), ("O", "round")], default="other").alias("by_part"),
                         text.map_type("p_brand", [("Brand#1", "first"), ("Brand#2", "second")], mode="equals").alias("by_name"))


@query("unit_price_range", "P6", """
    SELECT count(*) FILTER (WHERE psqm > 1000 AND psqm <= 2000) AS half_open, count(*) FILTER (WHERE psqm >= 1500 AND psqm <= 2500) AS closed FROM deals""")
def unit_price_range(t: Tables):
    a = clean.sane_range(t.deals, "psqm", 1000, 2000, "(]").agg(F.count(F.lit(1))).scalar()
    b = clean.sane_range(t.deals, "psqm", 1500, 2500, "[]").agg(F.count(F.lit(1)))
    return b.select(a.alias("half_open"), F.col("count(1)").alias("closed"))


@query("plausible_listings", "P7", """
    WITH l AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice * 400 AS price, p_size * 12.0::double AS area FROM part)
    SELECT id, kind, round(price, 2) AS price, area FROM l
    WHERE price BETWEEN 100000 AND 50000000 AND round(price / area, 2) BETWEEN 300 AND 40000
      AND ((kind = 'ECONOMY' AND area BETWEEN 20 AND 300) OR (kind = 'PROMO' AND area BETWEEN 50 AND 5000))""")
def plausible_listings(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), (F.col("p_retailprice") * 400).alias("price"),
                         (F.col("p_size") * F.lit(12.0)).alias("area"))
    kept = clean.plausible_listings(rows, "price", "area", "kind", {"ECONOMY": (20, 300), "PROMO": (50, 5000)})
    return rounded(kept.select("id", "kind", "price", "area"), 2, "price")


@query("trim_percentiles", "P8", """
    WITH q AS (SELECT quantile_cont(psqm, 0.01) AS lo, quantile_cont(psqm, 0.99) AS hi FROM deals)
    SELECT district, count(*) AS n_rows, round(min(psqm), 4) AS lo, round(max(psqm), 4) AS hi FROM deals, q
    WHERE psqm BETWEEN q.lo AND q.hi GROUP BY district""")
def trim_percentiles(t: Tables):
    kept = clean.trim_percentiles(t.deals, ["psqm"])
    out = kept.groupBy("district").agg(F.count(F.lit(1)).alias("n_rows"), F.min("psqm").alias("lo"), F.max("psqm").alias("hi"))
    return rounded(out, 4, "lo", "hi")


@query("winsorise", "P9", """
    WITH c AS (SELECT quantile_cont(price, 0.99) AS cap FROM sales WHERE qid < 20001)
    SELECT region, count(*) AS n_rows, round(sum(least(price, cap)), 4) AS total, round(max(least(price, cap)), 4) AS highest
    FROM sales, c GROUP BY region""")
def winsorise(t: Tables):
    caps = clean.fit_winsor(t.sales.filter("qid < 20001"), ["price"])
    out = clean.apply_winsor(t.sales, caps, ["price"]).groupBy("region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("total"), F.max("price").alias("highest"))
    return rounded(out, 4, "total", "highest")


@query("keep_first", "P11", """
    SELECT user_id, kind, id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, id) AS k FROM ev) WHERE k = 1""")
def keep_first(t: Tables):
    return ranking.dedup(t.ev.select("user_id", "kind", "id", "value", "ts"), ["user_id", "kind"], ["ts", "id"]).drop("ts")


@query("parcel_key", "P12", """
    SELECT id, (borough + 1)::bigint * 1000000000 + (id % 9999) * 10000 + CASE WHEN id % 5 = 0 THEN NULL ELSE parcel % 100 END AS bbl FROM sales""")
def parcel_key(t: Tables):
    lot = F.when(F.col("id") % 5 == 0, "lot?").otherwise(F.concat((F.col("parcel") % 100).cast("string"), F.lit(".0")))
    return t.sales.select("id", numbers.bbl_key((F.col("borough") + 1).cast("double"), F.col("id") % 9999, lot).alias("bbl"))


@query("repair_quarters", "P13", """
    SELECT (year(l_shipdate) + 25) * 10 + quarter(l_shipdate) AS quarter_id, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def repair_quarters(t: Tables):
    # even line numbers carry the full id where the quarter belongs, as in the damaged source rows
    y, q = F.year("l_shipdate") + 25, F.quarter("l_shipdate")
    rows = t.lineitem.select(y.alias("year"), F.when(F.col("l_linenumber") % 2 == 0, y * 10 + q).otherwise(q).alias("quarter"))
    rows = rows.withColumn("raw", F.col("year") * 10 + F.col("quarter"))
    fixed = rows.select(dates.repair_quarter_id("raw", "year", "quarter").alias("quarter_id"))
    return fixed.groupBy("quarter_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("batch_validation", "P14", """
    WITH r AS (SELECT id, list_filter([CASE WHEN id % 11 = 0 THEN 'kind is missing' END,
        CASE WHEN NOT (lat BETWEEN 40.5 AND 40.9) THEN 'lat is not in 40.5..40.9' END, CASE WHEN bal <= 0 THEN 'bal is not positive' END,
        CASE WHEN id % 11 <> 0 AND kind NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'kind is not known' END], lambda x: x IS NOT NULL) AS e FROM cust)
    SELECT id, len(e) AS n_errors, array_to_string(e, '; ') AS errors FROM r""")
def batch_validation(t: Tables):
    rows = t.cust.withColumn("kind", F.when(F.col("id") % 11 != 0, F.col("kind")))
    rules = clean.subject_rules(["kind"], {"lat": (40.5, 40.9)}, ["bal"], {"kind": ["BUILDING", "HOUSEHOLD", "MACHINERY"]})
    ok, bad = clean.validate_batch(rows, rules)
    return ok.select("id", F.lit(0).alias("n_errors"), F.lit("").alias("errors")).unionByName(
        bad.select("id", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors")))


@query("align_schema", "P15", """
    WITH m AS (SELECT median(price) AS mid FROM sales WHERE qid < 20001)
    SELECT s_suppkey AS id, round(mid, 4) AS price, '' AS kind, s_acctbal AS area FROM supplier, m""")
def align_schema(t: Tables):
    from pyspark.sql import types as T

    from ..operators.quantiles import group_agg

    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()),
                           T.StructField("kind", T.StringType()), T.StructField("area", T.DoubleType())])
    mid = group_agg(t.sales.filter("qid < 20001"), [], [], {"price": ("price", 0.5)})
    rows = t.supplier.select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").alias("area"))
    return rounded(clean.align_to(rows, target, mid), 4, "price")


@query("feature_matrix", "P16", """
    SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN bal END, 0)::double AS bal, lat, region::double AS region FROM cust""")
def feature_matrix(t: Tables):
    rows = t.cust.withColumn("bal", F.when(F.col("id") % 6 == 0, F.lit(float("nan"))).when(F.col("id") % 3 != 0, F.col("bal")))
    return clean.feature_matrix(rows, ["bal", "lat", "absent", "bal", "region"], keep=["id"])


@query("null_audit", "P17", """
    WITH s AS (SELECT CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS price, CASE WHEN id % 10 = 0 THEN NULL ELSE area END AS area FROM sales)
    SELECT 'price' AS "column", round(avg((price IS NULL)::int), 6) AS null_share FROM s""")
def null_audit(t: Tables):
    rows = t.sales.select(F.when(F.col("id") % 4 != 0, F.col("price")).alias("price"),
                          F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("area")).alias("area"))
    return rounded(clean.audit_nulls(rows, 0.2), 6, "null_share")


@query("column_summary", "P17", """
    SELECT 'price' AS "column", count(price) AS n, min(price) AS min, round(median(price), 4) AS median, round(quantile_cont(price, 0.9), 4) AS p90, max(price) AS max FROM sales
    UNION ALL SELECT 'area', count(area), min(area), median(area), round(quantile_cont(area, 0.9), 4), max(area) FROM sales""")
def column_summary(t: Tables):
    return rounded(clean.column_summary(t.sales, ["price", "area"]), 4, "median", "p90")


@query("key_overlap", "P18", """
    SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (WHERE b IS NULL) AS n_only_first,
           count(*) FILTER (WHERE a IS NULL) AS n_only_second
    FROM (SELECT DISTINCT c_custkey AS a FROM customer) x FULL JOIN (SELECT DISTINCT user_id * 3 AS b FROM events) y ON a = b""")
def key_overlap(t: Tables):
    return clean.key_overlap(t.customer.select(F.col("c_custkey").alias("k")), t.events.select((F.col("user_id") * 3).alias("k")), "k")


@query("text_rules", "F1, F2, F3, F4", """
    SELECT n_nationkey AS id, 'محمد' || n_name AS norm, 'العليا ' || n_name AS district, 1 AS arabic, 0 AS latin,
           lpad((n_nationkey * 401)::varchar, greatest(5, length((n_nationkey * 401)::varchar))::int, '0') AS zip FROM nation""")
def text_rules(t: Tables):
    n = F.col("n_name")
    marked = F.concat(F.lit("  مُحَـمَّد"), n, F.lit(" "))
    return t.nation.select(
        F.col("n_nationkey").alias("id"), text.normalize_ar(marked).alias("norm"),
        text.strip_district_prefix(F.concat(F.lit(" حي  العليا   "), n)).alias("district"),
        text.has_arabic(marked).cast("int").alias("arabic"), text.has_arabic(n).cast("int").alias("latin"),
        text.zip5(F.concat((F.col("n_nationkey") * 401).cast("string"), F.lit(".0"))).alias("zip"))


@query("document_text_rules", "F1, F2, F3, F4", r"""
    SELECT doc_id, md5(coalesce(trim(regexp_replace(text, '[\x{0640}\x{064B}-\x{065F}]', '', 'g')), '')) AS norm_md5,
           md5(trim(regexp_replace(trim(text), '[\x09-\x0D ]+', ' ', 'g'))) AS bare_md5, coalesce(regexp_matches(text, '[\x{0600}-\x{06FF}]'), false)::int AS arabic,
           lpad(n_chars::varchar, greatest(5, length(n_chars::varchar))::int, '0') AS zip FROM documents""")
def document_text_rules(t: Tables):
    """The text rules over whole document texts."""
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    return t.documents.select(
        "doc_id", md5(text.normalize_ar("text")).alias("norm_md5"), md5(text.strip_district_prefix("text")).alias("bare_md5"), text.has_arabic("text").cast("int").alias("arabic"), text.zip5("n_chars").alias("zip"))


@query("class_flags", "F5", """
    WITH b AS (SELECT p_partkey AS id, upper(substr('abcdrsRD', (p_partkey % 8 + 1)::int, 1)) || (p_size % 10)::varchar AS bc FROM part)
    SELECT id, regexp_matches(bc, '^R')::int AS is_condo, regexp_matches(bc, '^[CD]')::int AS is_multifamily, regexp_matches(bc, '^A')::int AS is_single_fam,
           regexp_matches(bc, '^S')::int AS is_mixed_use, regexp_matches(bc, '^(D|R[12])')::int AS has_elevator FROM b""")
def class_flags(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.concat(
        F.substring(F.lit("abcdrsRD"), (F.col("p_partkey") % 8 + 1).cast("int"), F.lit(1)), (F.col("p_size") % 10).cast("string")).alias("bc"))
    return text.class_flags(rows, "bc", CLASS_RULES).drop("bc")


@query("station_flags", "F6, F7", """
    WITH r AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'G' WHEN 2 THEN 'A C' ELSE 'S G  H' END AS routes FROM supplier)
    SELECT id, (id % 4 = 2)::int AS express, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS n_routes, (id % 2 = 0)::int AS cbd FROM r""")
def station_flags(t: Tables):
    k = F.col("s_suppkey") % 4
    routes = F.when(k == 0, "").when(k == 1, "G").when(k == 2, "A C").otherwise("S G  H")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), routes.alias("routes"), F.when(F.col("s_suppkey") % 2 == 0, "TRUE").otherwise("no").alias("cbd"))
    return rows.select("id", text.is_express("routes", EXPRESS_ROUTES).alias("express"), text.route_count("routes").alias("n_routes"),
                       text.text_bool("cbd").alias("cbd"))


@query("time_keys", "F8, F9, F10, F11, F15", """
    SELECT id, qid, CASE WHEN id % 9 = 0 THEN NULL ELSE qid END AS from_text, dq, 'Q' || (qid % 10) || ' ' || (qid // 10) AS label,
           strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS m_sin,
           round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS m_cos,
           round(least(greatest(date_diff('day', ts::date, DATE '2000-06-30') / 365.25, 0), 3), 6) AS age FROM sales""")
def time_keys(t: Tables):
    s, c = dates.cyclic(F.month("ts"), 12)
    day = F.date_format("ts", "yyyy-MM-dd")
    out = t.sales.select(
        "id", "qid", dates.quarter_id_from_text(F.when(F.col("id") % 9 == 0, "2025-1").otherwise(day)).alias("from_text"), "dq",
        dates.quarter_label("qid").alias("label"), dates.month_start("ts").cast("string").alias("month"), s.alias("m_sin"), c.alias("m_cos"),
        dates.years_between(F.to_date(F.lit("2000-06-30")), "ts", 0.0, 3.0).alias("age"))
    return rounded(out, 6, "m_sin", "m_cos", "age")


@query("safe_numbers", "F12, F18, F19", """
    WITH s AS (SELECT id, price, CASE WHEN id % 5 = 0 THEN 0 ELSE area END AS area, psf FROM sales)
    SELECT id, round(ln(1 + greatest(price - 200000, 0)), 6) AS log_excess, round(floor(price) / greatest(area, 1000), 9) AS ratio,
           CASE WHEN psf < 50 THEN 'low' WHEN psf < 150 THEN 'mid' ELSE 'high' END AS band,
           CASE WHEN price / 250000 - 1 < -0.05 THEN 'below' WHEN price / 250000 - 1 > 0.05 THEN 'above' ELSE 'near' END AS versus,
           CASE WHEN area > 0 THEN round_even(price / area, 0)::bigint END AS price_per_sqft,
           CASE WHEN area > 0 THEN round_even(price / (area * 0.0929), 0)::bigint END AS price_per_sqm FROM s""")
def safe_numbers(t: Tables):
    rows = t.sales.withColumn("area", F.when(F.col("id") % 5 == 0, F.lit(0.0)).otherwise(F.col("area")))
    out = numbers.unit_rates(rows, "price", "area").select(
        "id", numbers.log1p_clip(F.col("price") - 200000).alias("log_excess"), numbers.ratio(F.floor("price").cast("double"), "area", 1000.0).alias("ratio"),
        numbers.band("psf", [50, 150], ["low", "mid", "high"]).alias("band"), numbers.versus_band("price", F.lit(250000)).alias("versus"),
        "price_per_sqft", "price_per_sqm")
    return rounded(rounded(out, 6, "log_excess"), 9, "ratio")


@query("distances", "F16, G13", """
    SELECT id, round(sqrt(pow(lat - 40.7549, 2) + pow(lon + 73.9840, 2)) * 111000, 3) AS dist_midtown_m,
           round(ln(1 + sqrt(pow(lat - 40.7549, 2) + pow(lon + 73.9840, 2)) * 111000), 6) AS log_dist_midtown_m,
           round(2 * 6371000 * asin(sqrt(pow(sin((radians(40.7549) - radians(lat)) / 2), 2)
             + cos(radians(lat)) * cos(radians(40.7549)) * pow(sin((radians(-73.9840) - radians(lon)) / 2), 2))), 3) AS arc_m FROM cust""")
def distances(t: Tables):
    out = geo.centre_distances(t.cust, {"midtown": (40.7549, -73.9840)}, "lat", "lon", log=True)
    out = out.select("id", "dist_midtown_m", "log_dist_midtown_m", geo.haversine_m("lat", "lon", F.lit(40.7549), F.lit(-73.9840)).alias("arc_m"))
    return rounded(rounded(out, 3, "dist_midtown_m", "arc_m"), 6, "log_dist_midtown_m")


@query("colour_position", "F17", """
    WITH m AS (SELECT region, avg(price) AS v FROM sales GROUP BY region), e AS (SELECT min(v) AS lo, max(v) AS hi FROM m)
    SELECT region, round((v - lo) / (hi - lo), 6) AS t, round(1 - (v - lo) / (hi - lo), 6) AS t_inv, 0.5::double AS flat FROM m, e""")
def colour_position(t: Tables):
    m = t.sales.groupBy("region").agg(F.avg("price").alias("v")).withColumn("same", F.lit(1.0))
    out = numbers.minmax_position(m, "v", "t")
    out = numbers.minmax_position(out, "v", "t_inv", invert=True)
    out = numbers.minmax_position(out, "same", "flat")
    return rounded(out.select("region", "t", "t_inv", "flat"), 6, "t", "t_inv")
