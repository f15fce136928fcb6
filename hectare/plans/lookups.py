"""Join and look-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, quantiles
from .registry import Tables, query, rounded


@query("parcel_attributes", "J1", """
    SELECT s.id, coalesce(CASE WHEN s.id % 3 = 0 THEN NULL ELSE s.kind END, c.kind) AS kind, coalesce(c.bal, 0)::double AS bal,
           (c.bal IS NOT NULL)::int AS has_parcel
    FROM sales s LEFT JOIN (SELECT id, kind, CASE WHEN id % 10 <> 0 THEN bal END AS bal FROM cust WHERE id % 4 <> 0) c ON s.parcel = c.id""")
def parcel_attributes(t: Tables):
    sales = t.sales.select("id", F.col("parcel").alias("key"), F.when(F.col("id") % 3 != 0, F.col("kind")).alias("kind"))
    dim = t.cust.filter("id % 4 <> 0").select(F.col("id").alias("key"), "kind", F.when(F.col("id") % 10 != 0, F.col("bal")).alias("bal"))
    out = joins.attach_attributes(sales, dim, "key", coalesce_cols=["kind"], flags={"has_parcel": "bal"}, zero=["bal"])
    return out.drop("key")


# A sale whose parcel is known but whose own kind is missing takes the parcel's kind; the SQL says the same.


@query("geocode_by_parcel", "J2", """
    SELECT o_orderkey AS id, c.lat, c.lon FROM orders JOIN cust c ON o_custkey = c.id WHERE c.id % 6 <> 0""")
def geocode_by_parcel(t: Tables):
    parcels = t.cust.select(F.col("id").alias("o_custkey"), F.when(F.col("id") % 6 != 0, F.col("lat")).alias("lat"), "lon")
    return joins.geocode_by_key(t.orders, parcels, "o_custkey", "lat", "lon").select(F.col("o_orderkey").alias("id"), "lat", "lon")


@query("attach_with_median", "J3, J12", """
    WITH d AS (SELECT region, avg(bal) AS bal FROM cust WHERE region % 5 <> 0 GROUP BY region), m AS (SELECT median(bal) AS mid FROM d)
    SELECT s.id, round(coalesce(d.bal, mid), 4) AS bal FROM sales s LEFT JOIN d ON s.region = d.region, m""")
def attach_with_median(t: Tables):
    dim = t.cust.filter("region % 5 <> 0").groupBy("region").agg(F.avg("bal").alias("bal"))
    keyed = joins.coalesce_key(t.sales.withColumn("alt_region", F.col("region")).withColumn("region", F.when(F.col("id") % 2 == 0, F.col("region"))),
                               ["region", "alt_region", "region_2010"], "region")
    return rounded(joins.attach(keyed, dim, ["region"]).select("id", "bal"), 4, "bal")


@query("composite_attach", "J4", """
    WITH d AS (SELECT region, substr(kind, 1, 1) AS letter, avg(ln(1 + price)) AS mean_log FROM sales GROUP BY ALL)
    SELECT c.id, round(mean_log, 6) AS mean_log FROM cust c LEFT JOIN d ON c.region = d.region AND substr(c.kind, 1, 1) = d.letter""")
def composite_attach(t: Tables):
    letter = F.substring("kind", 1, 1).alias("letter")
    dim = t.sales.groupBy("region", letter).agg(F.avg(F.log1p("price")).alias("mean_log"))
    out = joins.attach(t.cust.select("id", "region", letter), dim, ["region", "letter"], fill=None)
    return rounded(out.select("id", "mean_log"), 6, "mean_log")


@query("monthly_rate", "J5", """
    WITH r AS (SELECT date_trunc('month', l_shipdate) AS m, avg(l_tax) AS rate FROM lineitem GROUP BY 1)
    SELECT s.id, round(rate, 8) AS rate FROM sales s LEFT JOIN r ON date_trunc('month', s.ts) = r.m""")
def monthly_rate(t: Tables):
    series = t.lineitem.select("l_shipdate", F.col("l_tax").alias("rate"))
    return rounded(joins.join_monthly(t.sales, series, "ts", "l_shipdate", "rate").select("id", "rate"), 8, "rate")


RATE_SQL = """SELECT ts::timestamp AS t, avg(psf) AS rate FROM sales GROUP BY 1"""


@query("rate_asof", "J6", f"""
    WITH r AS ({RATE_SQL}) SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(rate, 6) AS rate
    FROM lineitem l ASOF LEFT JOIN r ON l.l_shipdate >= r.t""")
def rate_asof(t: Tables):
    series = t.sales.groupBy("ts").agg(F.avg("psf").alias("rate"))
    out = joins.asof_last(t.lineitem, series, "l_shipdate", "ts", "rate")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "rate"), 6, "rate")


@query("rate_latest", "J6", f"""WITH r AS ({RATE_SQL}) SELECT round(max_by(rate, t), 6) AS rate FROM r""")
def rate_latest(t: Tables):
    series = t.sales.groupBy("ts").agg(F.avg("psf").alias("rate"))
    return rounded(joins.latest_value(series, "ts", "rate"), 6, "rate")


@query("nearest_quarter", "J7", """
    WITH d AS (SELECT dq, avg(price) AS idx FROM sales WHERE dq % 5 = 0 AND dq < 22 GROUP BY dq),
    p AS (SELECT s.dq, d.idx, row_number() OVER (PARTITION BY s.dq ORDER BY abs(s.dq - d.dq), d.dq) AS k FROM (SELECT DISTINCT dq FROM sales) s, d)
    SELECT s.id, round(p.idx, 4) AS idx FROM sales s JOIN p ON s.dq = p.dq AND k = 1""")
def nearest_quarter(t: Tables):
    dim = t.sales.filter("dq % 5 = 0 AND dq < 22").groupBy("dq").agg(F.avg("price").alias("idx"))
    return rounded(joins.nearest_key(t.sales, dim, "dq", ["idx"]).select("id", "idx"), 4, "idx")


@query("fallback_chain", "J8", """
    WITH a AS (SELECT region, kind, avg(price) AS v FROM sales WHERE dq = 3 GROUP BY ALL), b AS (SELECT kind, avg(price) AS v FROM sales WHERE kind <> 'BUILDING' GROUP BY kind)
    SELECT c.id, round(coalesce(a.v, b.v, 100.0), 4) AS v FROM cust c LEFT JOIN a ON a.region = c.region AND a.kind = c.kind LEFT JOIN b ON b.kind = c.kind""")
def fallback_chain(t: Tables):
    a = t.sales.filter("dq = 3").groupBy("region", "kind").agg(F.avg("price").alias("v"))
    b = t.sales.filter("kind <> 'BUILDING'").groupBy("kind").agg(F.avg("price").alias("v"))
    out = joins.lookup_chain(t.cust, [(a, ["region", "kind"], "v"), (b, ["kind"], "v")], "v", 100.0)
    return rounded(out.select("id", "v"), 4, "v")


@query("shift_by_quarter", "J9", """
    WITH a AS (SELECT region, dq, count(*) AS n FROM sales GROUP BY ALL)
    SELECT s.id, a.n AS n_before FROM sales s LEFT JOIN a ON a.region = s.region AND a.dq = s.dq - 2""")
def shift_by_quarter(t: Tables):
    agg = t.sales.groupBy("region", "dq").agg(F.count(F.lit(1)).alias("n"))
    return joins.shift_join(t.sales, agg, ["region"], "dq", 2, {"n": "n_before"}).select("id", "n_before")


@query("extend_panel", "J10, R2, U4", """
    WITH p AS (SELECT region, qid, kind, count(*) AS deeds, median(psf) AS psf, CASE WHEN qid % 10 <> 4 THEN region * 100000.0 + qid END AS spot FROM sales WHERE qid < 20003 GROUP BY region, kind, qid),
    l AS (SELECT region, max_by(spot, CASE WHEN spot IS NOT NULL THEN qid END) AS spot FROM p GROUP BY region),
    n AS (SELECT region, kind, qid, count(*) AS deeds, median(psf) AS psf FROM sales WHERE qid NOT IN (SELECT qid FROM p) AND psf BETWEEN 20 AND 400 GROUP BY region, kind, qid HAVING count(*) >= 3)
    SELECT region, kind, qid, deeds, psf, round(spot, 4) AS spot FROM p UNION ALL SELECT n.region, kind, qid, deeds, psf, round(l.spot, 4) FROM n JOIN l USING (region)""")
def extend_panel(t: Tables):
    from .. import products

    cell = t.sales.select("region", "kind", "qid", "psf")
    old = quantiles.group_agg(cell.filter("qid < 20003"), ["region", "kind", "qid"], [F.count(F.lit(1)).alias("deeds")], {"psf": ("psf", 0.5)})
    panel = old.withColumn("spot", F.when(F.col("qid") % 10 != 4, F.col("region") * 100000.0 + F.col("qid")))
    out = products.incremental.extend_quarters(panel, cell, ["region", "kind"], "qid", 3, "deeds", "region", ["spot"], "psf", 20, 400)
    return rounded(out, 4, "spot")


@query("fresh_override", "J11", """
    SELECT c.id, coalesce(f.bal, c.bal) AS bal FROM cust c LEFT JOIN (SELECT s_suppkey * 7 AS id, s_acctbal AS bal FROM supplier WHERE s_suppkey % 2 = 0) f USING (id)""")
def fresh_override(t: Tables):
    fresh = t.supplier.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") * 7).alias("id"), F.col("s_acctbal").alias("bal"))
    return joins.override(t.cust.select("id", "bal"), fresh, "id", ["bal"])


@query("member_filters", "J13", """
    SELECT id, 'kept' AS side FROM sales WHERE kind IN (SELECT p FROM (VALUES ('BUILDING'), ('MACHINERY')) v(p)) AND parcel IN (SELECT user_id FROM events)
    UNION ALL SELECT id, 'dropped' FROM sales WHERE parcel NOT IN (SELECT user_id FROM events)""")
def member_filters(t: Tables):
    known = t.events.select(F.col("user_id").alias("parcel")).distinct()
    kept = joins.keep_members(t.sales.filter(F.col("kind").isin("BUILDING", "MACHINERY")), known, ["parcel"])
    gone = joins.drop_members(t.sales, known, ["parcel"])
    return kept.select("id", F.lit("kept").alias("side")).unionByName(gone.select("id", F.lit("dropped").alias("side")))


@query("deed_history", "J14, W14", """
    WITH d AS (SELECT o_orderkey AS doc, o_orderdate AS ts, o_totalprice AS price, l_partkey AS parcel FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY parcel ORDER BY ts DESC, doc) AS k FROM d)
    SELECT parcel, doc, strftime(ts, '%Y-%m-%d') AS day, price FROM r WHERE k = 2""")
def deed_history(t: Tables):
    from ..operators.temporal import second_latest_deed

    master = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    lots = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("parcel")).distinct()
    deeds = joins.deed_history(master, lots, "doc")
    out = second_latest_deed(deeds, "parcel", "ts", ["doc"], ["price"])
    return out.select("parcel", "doc", F.date_format("ts", "yyyy-MM-dd").alias("day"), "price")


@query("key_sets", "U3", """
    SELECT coalesce(a, b) AS qid, (a IS NOT NULL)::int AS in_first, (b IS NOT NULL)::int AS in_second
    FROM (SELECT DISTINCT qid AS a FROM sales) x FULL JOIN (SELECT DISTINCT qid AS b FROM deals) y ON a = b""")
def key_sets(t: Tables):
    return joins.key_sets(t.sales.select("qid"), t.deals.select("qid"), "qid")


@query("union_sources", "U1", """
    SELECT source, count(*) AS n_rows, round(sum(price), 2) AS total, count(area) AS n_area FROM (
      SELECT 'sales' AS source, price, area FROM sales UNION ALL SELECT 'parts', worth, NULL FROM poi UNION ALL SELECT 'sizes', size::double, NULL FROM poi)
    GROUP BY source""")
def union_sources(t: Tables):
    from ..operators.clean import union_relaxed

    a = t.sales.select(F.lit("sales").alias("source"), "price", "area")
    b = t.poi.select(F.lit("parts").alias("source"), F.col("worth").alias("price"))
    c = t.poi.select(F.col("size").alias("price"), F.lit("sizes").alias("source"))
    u = union_relaxed(a, b, c).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("total"), F.count("area").alias("n_area"))
    return rounded(u, 2, "total")


@query("append_rows", "U2, R1", """
    WITH old AS (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < DATE '2000-01-01')
                 OR (o_orderdate < DATE '2000-01-01' AND o_orderkey % 2 = 0))
    SELECT (SELECT count(*) FROM old) AS n_old, count(*) AS n_all, round(sum(o_totalprice), 2) AS total FROM orders""")
def append_rows(t: Tables):
    from .. import products

    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"))
    # of the stored table's latest day only the even keys are stored yet
    last = rows.filter("ts < DATE'2000-01-01'").agg(F.max("ts")).scalar()
    old = rows.filter("ts < DATE'2000-01-01'").filter((F.col("ts") < last) | (F.col("id") % 2 == 0))
    # the landed set overlaps the stored one; only rows after the high-water mark with unseen keys are added
    grown = products.incremental.append_since(old, rows, "ts", ["id"])
    n_old = old.agg(F.count(F.lit(1))).scalar()
    return rounded(grown.agg(n_old.alias("n_old"), F.count(F.lit(1)).alias("n_all"), F.sum("price").alias("total")), 2, "total")
