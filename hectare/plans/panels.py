"""Aggregate, temporal and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ranking, temporal
from ..operators.quantiles import group_agg
from ..products.panel_store import PanelStore
from ..session import scratch_path
from .registry import Tables, query, rounded

PANEL = """SELECT district, qid AS quarter_id, qid // 10 AS sale_year, qid % 10 AS sale_quarter, count(*) AS deed_count, round(sum(amount), 4) AS total_value,
    round(median(psqm), 6) AS median_psqm, round(avg(psqm), 6) AS mean_psqm, round(quantile_cont(psqm, 0.25), 6) AS p25_psqm,
    round(quantile_cont(psqm, 0.75), 6) AS p75_psqm FROM deals WHERE psqm > 100 AND psqm <= 100000 GROUP BY district, qid HAVING count(*) >= 3"""


@query("quarterly_panel", "A1, S5", PANEL)
def quarterly_panel(t: Tables):
    return A.quarterly_panel(t.deals, ["district"], "ts", "psqm", "amount", digits=6)


def delivered(t: Tables):
    """The deals in three deliveries, and the store that took them: the second holds late and corrected deals of old quarters and
    takes some out; the third repeats the first."""
    d = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "l_orderkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("deed"), F.col("n_name").alias("district"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("psqm"),
        F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ts"))
    order = F.col("l_orderkey")
    early = (F.col("ts") < "1997-01-01") & (order % 7 != 3)
    wrong, gone = order % 5 == 0, order % 11 == 4
    first = d.filter(early).withColumns({
        "psqm": F.when(wrong, F.col("psqm") + 7).otherwise(F.col("psqm")), "amount": F.when(wrong, F.col("amount") * 2).otherwise(F.col("amount")),
        "district": F.when(order % 10 == 0, F.lit("UNKNOWN")).otherwise(F.col("district")), "version": F.lit(1), "gone": F.lit(False)})
    second = d.filter(~early | wrong | gone).withColumns({"version": F.lit(2), "gone": gone})
    store = PanelStore(t.spark, scratch_path(t.spark, "panel-store"), ["l_orderkey", "deed"], "version", ["district"], "ts", "psqm", "amount", "gone", digits=6)
    for delivery in (first, second.select(first.columns), first):
        store.take(delivery)
    return store


@query("panel_deliveries", "R1, R2, A1, U2", PANEL.replace("WHERE ", "WHERE l_orderkey % 11 <> 4 AND "))
def panel_deliveries(t: Tables):
    return delivered(t).panel()


@query("panel_rollup", "A2", f"""
    WITH p AS ({PANEL}) SELECT quarter_id, count(DISTINCT district) AS n_groups, sum(deed_count)::bigint AS n_deeds FROM p GROUP BY quarter_id""")
def panel_rollup(t: Tables):
    return A.panel_rollup(A.quarterly_panel(t.deals, ["district"], "ts", "psqm", "amount", digits=6), "district")


@query("hot_group_quantiles", "A1", """
    SELECT kind, count(*) AS n_rows, round(median(psqm), 6) AS mid, round(quantile_cont(psqm, 0.9), 6) AS p90 FROM deals GROUP BY kind""")
def hot_group_quantiles(t: Tables):
    # limits of zero send every group through the range-splitting path that huge groups take
    out = group_agg(t.deals, ["kind"], [F.count(F.lit(1)).alias("n_rows")], {"mid": ("psqm", 0.5), "p90": ("psqm", 0.9)})
    return rounded(out, 6, "mid", "p90")


@query("listing_stats", "A3", """
    SELECT brand, count(worth) AS n_listings, round(avg(worth), 4) AS mean_psqm, round(median(worth), 4) AS median_psqm, round(quantile_cont(worth, 0.25), 4) AS p25_psqm,
           round(quantile_cont(worth, 0.75), 4) AS p75_psqm, round(quantile_cont(worth, 0.75) - quantile_cont(worth, 0.25), 4) AS iqr_psqm FROM poi GROUP BY brand""")
def listing_stats(t: Tables):
    return rounded(A.listing_stats(t.poi, "brand", "worth"), 4, "mean_psqm", "median_psqm", "p25_psqm", "p75_psqm", "iqr_psqm")


@query("typed_stats", "A4", """
    SELECT brand, CASE WHEN count(*) FILTER (WHERE kind = 'ECONOMY') >= 8 THEN round(median(worth) FILTER (WHERE kind = 'ECONOMY'), 4) END AS econ_mid,
           CASE WHEN count(*) FILTER (WHERE kind = 'PROMO') >= 8 THEN median(size) FILTER (WHERE kind = 'PROMO') END AS promo_size,
           count(*) FILTER (WHERE kind = 'ECONOMY') AS n_econ FROM poi GROUP BY brand""")
def typed_stats(t: Tables):
    out = A.typed_stats_wide(t.poi, "brand", "kind", {"econ_mid": ("ECONOMY", "worth"), "promo_size": ("PROMO", "size")}, {"n_econ": "ECONOMY"}, min_n=8)
    return rounded(out, 4, "econ_mid")


@query("severity_scores", "A5, A6", """
    WITH w AS (SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS n_click, count(*) FILTER (WHERE kind = 'error') AS n_error,
               count(*) FILTER (WHERE kind = 'view') AS n_view FROM ev WHERE value > 10 GROUP BY user_id)
    SELECT user_id, n_click, n_error, n_view, 3 * n_click + 2 * n_error + n_view AS severity, round(ln(1 + 3 * n_click + 2 * n_error + n_view), 6) AS log_severity FROM w""")
def severity_scores(t: Tables):
    counted = A.count_where(t.ev, ["user_id", "kind"], F.col("value") > 10, "n")
    out = A.severity_by_key(counted, "user_id", "kind", {"click": 3, "error": 2, "view": 1}, "n")
    return rounded(out.select("user_id", "n_click", "n_error", "n_view", "severity", "log_severity"), 6, "log_severity")


@query("component_means", "A7", """
    SELECT user_id, round(coalesce(avg(value) FILTER (WHERE kind = 'click'), 0), 6) AS click_mean, round(coalesce(avg(value) FILTER (WHERE kind = 'none'), 0), 6) AS none_mean
    FROM ev GROUP BY user_id""")
def component_means(t: Tables):
    return rounded(A.pivot_mean(t.ev, "user_id", "kind", ["click", "none"], "value"), 6, "click_mean", "none_mean")


@query("medians_by_region", "A8", """
    SELECT region, count(*) AS n_rows, round(median(price), 4) AS price_median, round(median(area), 4) AS area_median, round(median(psf), 4) AS psf_median FROM sales GROUP BY region""")
def medians_by_region(t: Tables):
    return rounded(A.median_by(t.sales, ["region"], ["price", "area", "psf"]), 4, "price_median", "area_median", "psf_median")


@query("stat_lookup", "A9", """
    SELECT region, round(avg(price), 4) AS price, round((SELECT avg(price) FROM sales), 4) AS global_price FROM sales GROUP BY region""")
def stat_lookup(t: Tables):
    return rounded(A.stat_lookup(t.sales, "region", ["price"]), 4, "price", "global_price")


@query("group_median_back", "A10, C9", """
    WITH m AS (SELECT borough, median(psf) AS mid FROM sales GROUP BY borough) SELECT id, round(mid, 4) AS mid, round(psf - mid, 4) AS deviation FROM sales JOIN m USING (borough)""")
def group_median_back(t: Tables):
    from ..operators.features import deviation_from_group

    out = A.group_stat_back(t.sales, ["borough"], "psf", "mid")
    return rounded(deviation_from_group(out, ["borough"], "psf", "deviation").select("id", "mid", "deviation"), 4, "mid", "deviation")


@query("distinct_counts", "A11", """
    SELECT user_id, count(DISTINCT kind) AS n_kind, count(DISTINCT CASE WHEN value > 5 THEN hour(ts) END) AS n_hour FROM ev GROUP BY user_id""")
def distinct_counts(t: Tables):
    rows = t.ev.select("user_id", "kind", F.when(F.col("value") > 5, F.hour("ts")).alias("hour"))
    return A.distinct_by(rows, ["user_id"], ["kind", "hour"])


@query("trend_slopes", "A12", """
    WITH y AS (SELECT region, year(ts) AS y, avg(ln(1 + price)) AS m FROM sales GROUP BY ALL),
    b AS (SELECT region, CASE WHEN count(*) < 2 THEN 0 ELSE regr_sxy(m, y) / (regr_sxx(m, y) + 1e-10) END AS by_year FROM y GROUP BY region)
    SELECT parcel, round(CASE WHEN count(*) < 3 OR regr_sxx(price, dq) = 0 THEN 0 ELSE regr_slope(price, dq) END, 0) + 0.0 AS by_row, round(any_value(by_year), 8) + 0.0 AS by_year
    FROM sales JOIN b USING (region) GROUP BY parcel""")
def trend_slopes(t: Tables):
    by_row = A.trend_slope(t.sales, "parcel", "dq", "price", 3, out="by_row")
    logs = t.sales.select("region", F.year("ts").alias("y"), F.log1p("price").alias("v"))
    by_year = A.yearly_trend_slope(logs, "region", "y", "v", "by_year")
    home = t.cust.select(F.col("id").alias("parcel"), "region")
    out = by_row.join(home, "parcel").join(by_year, "region").select("parcel", "by_row", "by_year")
    return rounded(rounded(out, 0, "by_row"), 8, "by_year")


@query("stats_by_year", "A13, V9", """
    SELECT year(ts) AS sale_year, count(*) AS n_rows, round(median(price), 4) AS median_price, round(quantile_cont(price, 0.25), 4) AS q1_price,
           round(quantile_cont(price, 0.75), 4) AS q3_price FROM sales GROUP BY 1""")
def stats_by_year(t: Tables):
    return rounded(A.stats_by_year(t.sales, F.year("ts"), "price"), 4, "median_price", "q1_price", "q3_price")


@query("stats_by_type", "A13, V9", """
    SELECT kind, count(*) AS n_rows, round(median(price), 4) AS median_price FROM sales GROUP BY kind HAVING count(*) > 5""")
def stats_by_type(t: Tables):
    return rounded(A.stats_by_type(t.sales, "kind", "price"), 4, "median_price")


@query("overview", "A13, V9", """
    SELECT count(*) AS total_rows, count(DISTINCT region) AS districts, min(year(ts)) AS year_from, max(year(ts)) AS year_to, round(median(price), 4) AS median_price FROM sales""")
def overview(t: Tables):
    return rounded(A.overview(t.sales.withColumn("y", F.year("ts")), "region", "y", "price"), 4, "median_price")


@query("activity_layer", "A14, V8", f"""
    WITH p AS ({PANEL}), r AS (SELECT * FROM p WHERE quarter_id IN (SELECT DISTINCT quarter_id FROM p ORDER BY 1 DESC LIMIT 4)),
    l AS (SELECT district, sum(deed_count)::bigint AS deeds, round(sum(total_value), 3) AS total, count(DISTINCT quarter_id) AS quarters_active, round(median(median_psqm), 4) AS median_psqm
          FROM r GROUP BY district HAVING sum(deed_count) >= 3)
    SELECT *, round(deeds / (SELECT max(deeds) FROM l), 4) AS activity_norm FROM l""")
def activity_layer(t: Tables):
    panel = A.quarterly_panel(t.deals, ["district"], "ts", "psqm", "amount", digits=6)
    return rounded(rounded(A.activity_layer(panel, "district"), 4, "median_psqm"), 3, "total")


@query("monthly_trend", "A15", """
    SELECT region, strftime(ts, '%Y-%m') AS month, count(*) AS n_sales, round(median(price), 4) AS median_price FROM sales GROUP BY 1, 2 HAVING count(*) >= 2""")
def monthly_trend(t: Tables):
    return rounded(A.monthly_trend(t.sales, ["region"], "ts", "price"), 4, "median_price")


@query("normalised_counts", "A16", """
    WITH n AS (SELECT user_id, count(*) AS n_rows FROM ev GROUP BY user_id) SELECT user_id, n_rows, round(n_rows / (SELECT max(n_rows) FROM n), 6) AS count_norm FROM n""")
def normalised_counts(t: Tables):
    return rounded(A.normalise_count(t.ev, "user_id"), 6, "count_norm")


@query("merge_complexes", "A17", """
    SELECT line, min_by(lat, id) AS lat, min_by(lon, id) AS lon, max((bal > 5000)::int) AS rich FROM stations GROUP BY line""")
def merge_complexes(t: Tables):
    rows = t.stations.withColumn("rich", (F.col("bal") > 5000).cast("int"))
    return A.merge_complex(rows, "line", "id", ["lat", "lon"], ["rich"])


@query("yearly_change", "A18, W7", """
    WITH y AS (SELECT year(ts) AS y, avg(psqm) AS v FROM deals WHERE borough = 1 GROUP BY 1)
    SELECT y, round(v, 4) AS avg_psqm, round(coalesce(v / lag(v) OVER (ORDER BY y) - 1, 0), 8) AS yoy FROM y""")
def yearly_change(t: Tables):
    yearly = A.yearly_mean(t.deals.withColumn("y", F.year("ts")), "y", "psqm", F.col("borough") == 1)
    out = temporal.index_change(yearly, "y", "avg_psqm", {"yoy": 1})
    return rounded(rounded(out, 4, "avg_psqm"), 8, "yoy")


@query("group_summary", "A19", """
    SELECT region, count(*) AS n_rows, round(avg(price), 4) AS mean_price, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS types, round(median(price), 4) AS median_price FROM sales GROUP BY region""")
def group_summary(t: Tables):
    return rounded(A.group_summary(t.sales, "region", "kind", "price"), 4, "mean_price", "median_price")


@query("spread_table", "A20", """
    WITH a AS (SELECT region, count(price) AS asking_n, median(price) AS asking_median FROM sales WHERE id % 2 = 0 AND region <> 3 GROUP BY region),
    d AS (SELECT region, count(price) AS deal_n, median(price) AS deal_median FROM sales WHERE id % 2 = 1 AND region <> 5 GROUP BY region),
    b AS (SELECT region, coalesce(asking_n, 0) AS asking_n, asking_median, coalesce(deal_n, 0) AS deal_n, deal_median,
           CASE WHEN asking_median / deal_median IS NOT NULL THEN greatest(-50, least(300, round((asking_median / deal_median - 1) * 100, 1))) END AS own FROM a FULL JOIN d USING (region))
    SELECT region, asking_n, round(asking_median, 4) AS asking_median, deal_n, round(deal_median, 4) AS deal_median, (own IS NULL)::int AS fallback,
           round(coalesce(own, (SELECT median(own) FROM b)), 4) + 0.0 AS spread_pct FROM b""")
def spread_table(t: Tables):
    s = t.sales
    out = A.spread_table(s.filter("id % 2 = 0 AND region <> 3"), s.filter("id % 2 = 1 AND region <> 5"), ["region"], "price", "price")
    return rounded(out, 4, "asking_median", "deal_median", "spread_pct")


@query("correlations", "A21", """
    SELECT 'area' AS "column", round(corr(area, price), 8) AS correlation FROM sales UNION ALL SELECT 'dq', round(corr(dq, price), 8) FROM sales""")
def correlations(t: Tables):
    return rounded(A.corr_with(t.sales, ["area", "dq"], "price"), 8, "correlation")


@query("target_skew", "A21b", """
    WITH m AS (SELECT avg(price) AS a, avg(ln(1 + price)) AS b FROM sales)
    SELECT round(avg(pow(price - a, 3)) / pow(avg(pow(price - a, 2)), 1.5), 6) AS skew_raw, round(avg(pow(ln(1 + price) - b, 3)) / pow(avg(pow(ln(1 + price) - b, 2)), 1.5), 6) AS skew_log FROM sales, m""")
def target_skew(t: Tables):
    return rounded(A.skew_of(t.sales, "price"), 6, "skew_raw", "skew_log")


@query("minmax_scaling", "A22, P16", """
    WITH e AS (SELECT min(price) AS lo, max(price) AS hi FROM sales WHERE qid < 20001)
    SELECT id, round(greatest(0, least(1, (price - lo) / (hi - lo))), 8) AS price_scaled FROM sales, e""")
def minmax_scaling(t: Tables):
    params = A.fit_minmax(t.sales.filter("qid < 20001"), ["price"])
    return rounded(A.apply_minmax(t.sales, params, ["price"]).select("id", "price_scaled"), 8, "price_scaled")


@query("top_values", "A23", """SELECT brand, count(*) AS n_rows FROM poi GROUP BY brand ORDER BY 2 DESC, 1 LIMIT 7""")
def top_values(t: Tables):
    return ranking.top_values(t.poi, "brand", 7)


LAGS = """WITH w AS (SELECT * FROM sales WHERE qid < 20001),
    c AS (SELECT region, kind, dq, avg(ln(1 + price)) AS logp, median(psf) AS psf, count(*) AS n FROM w GROUP BY ALL),
    g AS (SELECT median(logp) AS logp, median(psf) AS psf, median(n) AS n FROM c)"""


@query("calendar_lags", "W1, W3", f"""{LAGS}
    SELECT s.id, round(coalesce(a.logp, g.logp), 8) AS logp_lag1, round(coalesce(a.psf, g.psf), 6) AS psf_lag1, coalesce(a.n, g.n)::double AS n_lag1,
           round(coalesce(b.logp, g.logp), 8) AS logp_lag2, round(coalesce(a.logp, g.logp) - coalesce(b.logp, g.logp), 8) + 0.0 AS logp_momentum
    FROM sales s LEFT JOIN c a ON a.region = s.region AND a.kind = s.kind AND a.dq = s.dq - 1 LEFT JOIN c b ON b.region = s.region AND b.kind = s.kind AND b.dq = s.dq - 2, g""")
def calendar_lags(t: Tables):
    s = t.sales.withColumn("log_price", F.log1p("price"))
    out = temporal.lag_by_calendar(s, s.filter("qid < 20001"), ["region", "kind"], "dq", {"logp": "log_price"}, {"psf": "psf"}, [1, 2])
    out = out.withColumn("logp_momentum", temporal.momentum("logp_lag1", "logp_lag2"))
    return rounded(rounded(out.select("id", "logp_lag1", "psf_lag1", "n_lag1", "logp_lag2", "logp_momentum"), 8, "logp_lag1", "logp_lag2", "logp_momentum"), 6, "psf_lag1")


@query("sequence_lags", "W2", """
    WITH p AS (SELECT * FROM sales WHERE dq % 3 <> 1), q AS (SELECT dq, row_number() OVER (ORDER BY dq) AS seq FROM (SELECT DISTINCT dq FROM p)),
    c AS (SELECT region, seq, median(price) AS m, stddev_samp(price) AS sd FROM p JOIN q USING (dq) GROUP BY ALL)
    SELECT p.id, round(a.m, 4) AS price_lag1_median, round(b.m, 4) AS price_lag2_median, round(a.sd, 4) AS price_lag1_std
    FROM sales p LEFT JOIN q USING (dq) LEFT JOIN c a ON a.region = p.region AND a.seq = q.seq - 1 LEFT JOIN c b ON b.region = p.region AND b.seq = q.seq - 2""")
def sequence_lags(t: Tables):
    # statistics from two thirds of the periods; every sale is kept
    p = t.sales.select("id", "region", "dq", "price")
    work = p.filter("dq % 3 <> 1")
    out = temporal.lag_by_sequence(p, ["region"], "dq", "price", [1, 2], work=work)
    out = temporal.lag_by_sequence(out, ["region"], "dq", "price", [1], "std", work=work)
    cols = ["price_lag1_median", "price_lag2_median", "price_lag1_std"]
    return rounded(out.select("id", *cols), 4, *cols)


@query("lookback_mean", "W4, W5", """
    WITH l AS (SELECT *, ln(1 + price) AS lp FROM sales), c AS (SELECT region, dq, avg(lp) AS m FROM l WHERE kind = 'BUILDING' GROUP BY ALL),
    e AS (SELECT region, dq, avg(m) OVER (PARTITION BY region ORDER BY dq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM c),
    g AS (SELECT avg(lp) AS g FROM l WHERE kind = 'BUILDING' AND qid < 20001), k AS (SELECT dq, avg(lp) AS city FROM l GROUP BY dq)
    SELECT l.id, round(coalesce(e.past, g), 8) AS lookback, round(city, 8) AS city FROM l LEFT JOIN e ON l.region = e.region AND l.dq = e.dq JOIN k ON l.dq = k.dq, g""")
def lookback_mean(t: Tables):
    s = t.sales.withColumn("lp", F.log1p("price"))
    out = temporal.expanding_past_mean(s, "region", "dq", "lp", "lookback", F.col("kind") == "BUILDING", s.filter("qid < 20001"))
    return rounded(temporal.period_mean(out, "dq", "lp", "city").select("id", "lookback", "city"), 8, "lookback", "city")


@query("index_changes", "W6", """
    WITH i AS (SELECT dq, avg(psf) AS v FROM sales GROUP BY dq HAVING dq <> 9)
    SELECT i.dq, round(coalesce(v / lag(v, 1) OVER (ORDER BY i.dq) - 1, 0), 8) AS qoq, round(coalesce(v / lag(v, 4) OVER (ORDER BY i.dq) - 1, 0), 8) AS yoy,
           round(v / o.ov - 1, 8) AS yoy_calendar FROM i LEFT JOIN (SELECT dq + 4 AS dq, v AS ov FROM i) o ON i.dq = o.dq""")
def index_changes(t: Tables):
    # the series, not the sales, has a gap
    index = t.sales.groupBy("dq").agg(F.avg("psf").alias("v")).filter("dq <> 9")
    out = temporal.index_change(index, "dq", "v", {"qoq": 1, "yoy": 4})
    out = temporal.index_change_calendar(out, "dq", "v", {"yoy_calendar": 4})
    return rounded(out.select("dq", "qoq", "yoy", "yoy_calendar"), 8, "qoq", "yoy", "yoy_calendar")


@query("latest_two", "W8, W13", """
    WITH r AS (SELECT * FROM sales WHERE dq IN (SELECT DISTINCT dq FROM sales ORDER BY 1 DESC LIMIT 6)),
    c AS (SELECT parcel, dq, median(price) AS m, row_number() OVER (PARTITION BY parcel ORDER BY dq DESC) AS k FROM r GROUP BY parcel, dq)
    SELECT parcel, round(max(m) FILTER (WHERE k = 1), 4) AS lag1, round(max(m) FILTER (WHERE k = 2), 4) AS lag2 FROM c GROUP BY parcel HAVING count(*) >= 2""")
def latest_two(t: Tables):
    recent = ranking.last_periods(t.sales, "dq", 6)
    cells = group_agg(recent, ["parcel", "dq"], [], {"m": ("price", 0.5)})
    return rounded(ranking.latest_n(cells, "parcel", "dq", "m", 2, require_all=True), 4, "lag1", "lag2")


@query("latest_record", "W12", """
    SELECT parcel, id, price FROM (SELECT *, row_number() OVER (PARTITION BY parcel ORDER BY ts DESC, id DESC) AS k FROM sales) WHERE k = 1""")
def latest_record(t: Tables):
    return ranking.latest_record(t.sales.select("parcel", "id", "price", "ts"), "parcel", ["ts", "id"]).drop("ts")


@query("prior_sales", "W9, F15", """
    WITH k AS (SELECT *, CASE WHEN parcel % 50 <> 0 THEN parcel END AS bbl FROM sales),
    h AS (SELECT id, price, ts, CASE WHEN bbl IS NOT NULL THEN lag(price) OVER w END AS pp, CASE WHEN bbl IS NOT NULL THEN lag(ts) OVER w END AS pt FROM k WINDOW w AS (PARTITION BY bbl ORDER BY ts, id))
    SELECT id, pp AS prior_price, round(CASE WHEN pt IS NOT NULL THEN greatest(date_diff('day', pt::date, ts::date) / 365.25, 0) END, 6) AS years_since_prior,
           round(CASE WHEN pp > 0 THEN least(greatest(price / pp - 1, -0.9), 10) END, 6) AS appreciation, (pt IS NOT NULL)::int AS has_prior,
           coalesce((date_diff('day', pt::date, ts::date) / 365.25 < 2)::int, 0) AS is_flip FROM h""")
def prior_sales(t: Tables):
    s = t.sales.select("id", "price", "ts", F.when(F.col("parcel") % 50 != 0, F.col("parcel")).alias("bbl"))
    out = temporal.prior_sale(s, "bbl", "ts", "price", ["id"])
    return rounded(out.select("id", "prior_price", "years_since_prior", "appreciation", "has_prior", "is_flip"), 6, "years_since_prior", "appreciation")


@query("leave_one_out", "W10", """
    WITH k AS (SELECT *, CASE WHEN parcel % 50 <> 0 THEN parcel END AS bbl FROM sales), w AS (SELECT * FROM k WHERE qid < 20001),
    b AS (SELECT bbl, sum(psf) AS s, count(*) AS n, median(psf) AS m FROM w WHERE bbl IS NOT NULL GROUP BY bbl), r AS (SELECT region, median(psf) AS m FROM w GROUP BY region)
    SELECT w.id, 'work' AS part, round(CASE WHEN b.n >= 2 THEN (b.s - w.psf) / (b.n - 1) END, 6) AS hist_psf FROM w LEFT JOIN b USING (bbl)
    UNION ALL SELECT k.id, 'hold', round(coalesce(b.m, r.m), 6) FROM k LEFT JOIN b USING (bbl) JOIN r ON k.region = r.region WHERE k.qid >= 20001""")
def leave_one_out(t: Tables):
    s = t.sales.withColumn("bbl", F.when(F.col("parcel") % 50 != 0, F.col("parcel")))
    work, hold = s.filter("qid < 20001"), s.filter("qid >= 20001")
    a = temporal.loo_mean(work, "bbl", "psf", "hist_psf").select("id", F.lit("work").alias("part"), "hist_psf")
    b = temporal.apply_history(hold, work, "bbl", "psf", "hist_psf", "region").select("id", F.lit("hold").alias("part"), "hist_psf")
    return rounded(a.unionByName(b), 6, "hist_psf")


@query("lagged_density", "W11", """
    WITH q AS (SELECT qid, row_number() OVER (ORDER BY qid) AS seq FROM (SELECT DISTINCT qid FROM sales)),
    n AS (SELECT region, seq, count(*) AS n FROM deals JOIN q USING (qid) GROUP BY ALL)
    SELECT s.id, round(ln(1 + coalesce(n.n, 0)), 8) AS log_deals_before FROM sales s JOIN q USING (qid) LEFT JOIN n ON n.region = s.region AND n.seq = q.seq - 1""")
def lagged_density(t: Tables):
    return rounded(temporal.lagged_density(t.sales, t.deals, ["region"], "qid", "log_deals_before").select("id", "log_deals_before"), 8, "log_deals_before")


@query("top_groups", "T1, V9", """
    SELECT parcel, count(*) AS n_rows, round(median(price), 4) AS median_value FROM sales GROUP BY parcel HAVING count(*) >= 10 ORDER BY median(price) DESC, parcel LIMIT 25""")
def top_groups(t: Tables):
    return rounded(ranking.top_groups(t.sales, "parcel", "price", 25, 10), 4, "median_value")


@query("top_factors_per_row", "T2", """
    WITH f AS (SELECT id, unnest(['bal', 'lat', 'region']) AS feature, unnest([bal / 1000, (lat - 40.7) * 20, region - 12.5]) AS impact FROM cust),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC) AS k FROM f)
    SELECT id, string_agg(feature, ',' ORDER BY k) AS features FROM r WHERE k <= 2 GROUP BY id""")
def top_factors_per_row(t: Tables):
    f = lambda n, c: F.struct(F.lit(n).alias("feature"), c.cast("double").alias("impact"))
    rows = t.cust.select("id", F.array(f("bal", F.col("bal") / 1000), f("lat", (F.col("lat") - 40.7) * 20), f("region", F.col("region") - F.lit(12.5))).alias("d"))
    return ranking.top_k_per_row(rows, "d", 2, "impact").select("id", F.array_join("d.feature", ",").alias("features"))


@query("stratified_sample", "T4, V10", """
    SELECT borough, id FROM (SELECT borough, id, row_number() OVER (PARTITION BY borough ORDER BY ('0x' || substr(md5('42:' || id), 1, 15))::bigint, id) AS k FROM sales) WHERE k <= 400""")
def stratified_sample(t: Tables):
    return ranking.stratified_sample(t.sales.select("borough", "id"), ["borough"], ["id"], 400)


@query("hashed_sample_sizes", "T4", """
    SELECT kind, least(count(*), 300) AS n_rows FROM sales GROUP BY kind""")
def hashed_sample_sizes(t: Tables):
    s = ranking.stratified_sample(t.sales.select("kind", "id"), ["kind"], ["id"], 300)
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query("sales_tiles", "G18, V8", """
    WITH s AS (SELECT *, floor((lat - 40.45) / 0.05)::int AS tile_y, floor((lon + 74.30) / 0.05)::int AS tile_x FROM sales)
    SELECT tile_x, tile_y, id, price FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY ts DESC, id) AS k FROM s) WHERE k <= 30""")
def sales_tiles(t: Tables):
    cols = t.sales.select("id", "price", "ts", "lat", "lon")
    return ranking.tile_top_n(cols, "lat", "lon", 40.45, -74.30, 0.05, [F.desc("ts"), "id"]).select("tile_x", "tile_y", "id", "price")


@query("bbox_sample", "G19", """
    WITH s AS (SELECT *, greatest(0, least(13, trunc((lat - 40.5) / (0.4 / 14))::int)) AS cy, greatest(0, least(13, trunc((lon + 74.2) / (0.4 / 14))::int)) AS cx
               FROM sales WHERE lat BETWEEN 40.5 AND 40.9 AND lon BETWEEN -74.2 AND -73.8)
    SELECT id, price FROM (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY ts DESC, id) AS k FROM s) WHERE k = 1""")
def bbox_sample(t: Tables):
    cols = t.sales.select("id", "price", "ts", "lat", "lon")
    return ranking.bbox_sample(cols, "lat", "lon", (40.5, 40.9, -74.2, -73.8), 200, [F.desc("ts"), "id"], ["id"]).select("id", "price")


@query("bbox_all", "G19", """SELECT id, price FROM sales WHERE lat BETWEEN 40.5 AND 40.51 AND lon BETWEEN -74.2 AND -74.1""")
def bbox_all(t: Tables):
    cols = t.sales.select("id", "price", "ts", "lat", "lon")
    return ranking.bbox_sample(cols, "lat", "lon", (40.5, 40.51, -74.2, -74.1), 1_000_000, [F.desc("ts"), "id"], ["id"]).select("id", "price")
