"""Encoding, imputation, feature, split, model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, encode, evaluate, features, impute, model, split
from ..session import scratch_path, stored
from .registry import Tables, query, rounded

WORK, HOLD = "qid < 20001", "qid >= 20001"


def logs(t: Tables):
    return t.sales.withColumn("lp", F.log1p("price"))


@query("target_encoding", "E1, E5", """
    WITH w AS (SELECT *, ln(1 + price) AS lp FROM sales WHERE qid < 20001), g AS (SELECT avg(lp) AS g FROM w), a AS (SELECT region, avg(lp) AS e FROM w GROUP BY region),
    b AS (SELECT borough, substr(kind, 1, 1) AS letter, avg(lp) AS e FROM w GROUP BY ALL), c AS (SELECT region, avg(lp) AS e FROM w WHERE kind = 'BUILDING' AND qid > 19984 AND region <> 4 GROUP BY region)
    SELECT s.id, round(coalesce(a.e, g), 8) AS region_enc, round(coalesce(b.e, g), 8) AS mix_enc, round(coalesce(c.e, g), 8) AS recent_enc, (s.kind = 'BUILDING')::int AS is_building
    FROM sales s LEFT JOIN a ON s.region = a.region LEFT JOIN b ON s.borough = b.borough AND substr(s.kind, 1, 1) = b.letter LEFT JOIN c ON s.region = c.region, g""")
def target_encoding(t: Tables):
    s = logs(t).withColumn("letter", F.substring("kind", 1, 1))
    work = s.filter(WORK)
    mean, lp = encode.global_mean(work, F.col("lp")), F.col("lp")
    out = encode.apply_encoding(s, encode.fit_target_encoding(work, ["region"], lp), ["region"], "region_enc", mean)
    out = encode.apply_encoding(out, encode.fit_target_encoding(work, ["borough", "letter"], lp), ["borough", "letter"], "mix_enc", mean)
    recent = encode.fit_target_encoding(work, ["region"], lp, where=F.expr("kind = 'BUILDING' AND qid > 19984 AND region <> 4"))
    out = encode.apply_encoding(out, recent, ["region"], "recent_enc", mean)
    out = encode.one_hot(out, "kind", {"is_building": "BUILDING"})
    cols = ["region_enc", "mix_enc", "recent_enc"]
    return rounded(out.select("id", *cols, "is_building"), 8, *cols)


@query("smoothed_encoding", "E2", """
    WITH w AS (SELECT parcel, ln(1 + price) AS lp FROM sales WHERE qid < 20001), g AS (SELECT avg(lp) AS g FROM w)
    SELECT parcel, round((sum(lp) + 30 * any_value(g)) / (count(*) + 30), 8) AS encoded FROM w, g GROUP BY parcel""")
def smoothed_encoding(t: Tables):
    return rounded(encode.fit_target_encoding(logs(t).filter(WORK), ["parcel"], F.col("lp"), k=30), 8, "encoded")


@query("out_of_fold_encoding", "E3", """
    WITH w AS (SELECT id, parcel % 5 AS fold, region, ln(1 + price) AS lp FROM sales),
    o AS (SELECT a.id, a.fold, a.region, (SELECT sum(lp) FROM w b WHERE b.fold <> a.fold) AS x FROM w a WHERE false),
    gf AS (SELECT f.fold, avg(w.lp) AS g FROM (SELECT DISTINCT fold FROM w) f JOIN w ON w.fold <> f.fold GROUP BY f.fold),
    kf AS (SELECT f.fold, w.region, sum(w.lp) AS s, count(*) AS n FROM (SELECT DISTINCT fold FROM w) f JOIN w ON w.fold <> f.fold GROUP BY ALL)
    SELECT w.id, round(coalesce((kf.s + 30 * gf.g) / (kf.n + 30), gf.g), 8) AS enc FROM w JOIN gf USING (fold) LEFT JOIN kf ON kf.fold = w.fold AND kf.region = w.region""")
def out_of_fold_encoding(t: Tables):
    s = logs(t).withColumn("fold", F.col("parcel") % 5)
    return rounded(encode.oof_encoding(s, "fold", ["region"], F.col("lp"), "enc", 30).select("id", "enc"), 8, "enc")


@query("region_market", "E4", """
    WITH m AS (SELECT parcel, count(*) AS n, median(psf) AS p FROM sales WHERE qid < 19971 GROUP BY parcel), g AS (SELECT median(n) AS n, median(p) AS p FROM m)
    SELECT s.id, coalesce(m.n, g.n)::double AS region_sales, coalesce(m.p, g.p) AS region_median_psf FROM sales s LEFT JOIN m USING (parcel), g""")
def region_market(t: Tables):
    out = encode.region_market(t.sales, t.sales.filter("qid < 19971"), "parcel", "psf")
    return out.select("id", F.col("region_sales").cast("double").alias("region_sales"), "region_median_psf")


GAPS = """x AS (SELECT id, borough, qid, price, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE price * 0.8 END AS prior, CASE WHEN id % 9 = 0 THEN NULL ELSE area * 10 END AS assessed FROM sales)"""


def gaps(t: Tables):
    k = F.col("id") % 4
    prior = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(0.0)).otherwise(F.col("price") * 0.8)
    return t.sales.select("id", "borough", "qid", "price", prior.alias("prior"), F.when(F.col("id") % 9 != 0, F.col("area") * 10).alias("assessed"))


@query("ratio_imputation", "I1", f"""
    WITH {GAPS}, b AS (SELECT borough, prior / assessed AS r FROM x WHERE qid < 20001 AND prior > 0 AND assessed > 0 AND borough <> 2),
    m AS (SELECT borough, median(r) AS r FROM b GROUP BY borough), g AS (SELECT median(r) AS g FROM b)
    SELECT id, round(CASE WHEN coalesce(prior, 0) = 0 AND assessed > 0 THEN assessed * coalesce(m.r, g) ELSE prior END, 4) AS prior FROM x LEFT JOIN m USING (borough), g""")
def ratio_imputation(t: Tables):
    x = gaps(t)
    ratios = impute.fit_ratio_impute(x.filter(WORK).filter("borough <> 2"), "prior", "assessed", "borough")
    return rounded(impute.apply_ratio_impute(x, ratios, "prior", "assessed", "borough").select("id", "prior"), 4, "prior")


@query("median_fill", "I2", f"""
    WITH {GAPS}, m AS (SELECT median(prior) FILTER (WHERE prior <> 0) AS p, median(assessed) AS a FROM x WHERE qid < 20001)
    SELECT id, round(coalesce(prior, p), 4) AS prior, coalesce(assessed, a) AS assessed FROM x, m""")
def median_fill(t: Tables):
    x = gaps(t)
    fill = impute.nonzero_median(x.filter(WORK), ["prior", "assessed"])
    return rounded(impute.fill_with(x, fill, ["prior", "assessed"]).select("id", "prior", "assessed"), 4, "prior")


@query("fill_chain", "I3, I4", """
    WITH x AS (SELECT id, kind, borough, CASE WHEN id % 3 = 0 OR (kind = 'BUILDING' AND borough = 1) THEN NULL ELSE area END AS area, CASE WHEN id % 5 = 0 THEN NULL ELSE floor(area / 500) END AS floors,
        (id % 260)::int - 10 AS age, CASE WHEN id % 7 = 0 OR borough = 3 THEN NULL ELSE psf END AS score, CASE WHEN id % 2 = 0 THEN 1.5 END AS far FROM sales),
    a AS (SELECT kind, borough, median(area) AS m FROM x GROUP BY ALL), f AS (SELECT kind, borough, median(floors) AS m FROM x GROUP BY ALL), s AS (SELECT borough, median(score) AS m FROM x GROUP BY borough),
    g AS (SELECT median(area) AS a, median(floors) AS f, median(score) AS s FROM x)
    SELECT id, coalesce(area, a.m, g.a) AS area, coalesce(floors, f.m, g.f) AS floors, greatest(0, least(200, age)) AS age, coalesce(score, s.m, g.s) AS score, coalesce(far, 0)::double AS far
    FROM x JOIN a ON a.kind = x.kind AND a.borough = x.borough JOIN f ON f.kind = x.kind AND f.borough = x.borough JOIN s ON s.borough = x.borough, g""")
def fill_chain(t: Tables):
    i = F.col("id")
    x = t.sales.select(
        "id", "kind", "borough", F.when(~((i % 3 == 0) | ((F.col("kind") == "BUILDING") & (F.col("borough") == 1))), F.col("area")).alias("area"),
        F.when(i % 5 != 0, F.floor(F.col("area") / 500).cast("double")).alias("floors"), ((i % 260).cast("int") - 10).alias("age"),
        F.when(~((i % 7 == 0) | (F.col("borough") == 3)), F.col("psf")).alias("score"), F.when(i % 2 == 0, F.lit(1.5)).alias("far"))
    return impute.quality_rules(x, "area", "floors", "age", "score", "far", "kind", "borough").drop("kind", "borough")


@query("fill_from_districts", "I5, C8", """
    WITH d AS (SELECT region, count(*) AS n, median(price) AS m FROM sales WHERE region % 3 <> 0 GROUP BY region), g AS (SELECT median(m) AS g FROM d)
    SELECT c.id, coalesce(d.n, 0) AS n, round(coalesce(d.m, g), 4) AS m, round(coalesce(d.m, g) / nullif(CASE WHEN c.bal < 0 THEN 0 ELSE c.bal END, 0), 6) AS premium FROM cust c LEFT JOIN d USING (region), g""")
def fill_from_districts(t: Tables):
    from ..operators.quantiles import group_agg

    dim = group_agg(t.sales.filter("region % 3 <> 0"), ["region"], [F.count(F.lit(1)).alias("n")], {"m": ("price", 0.5)})
    out = impute.fill_from_dim(t.cust.select("id", "region", "bal"), dim, "region", ["n"], ["m"])
    out = features.asking_premium(out.withColumn("paid", F.greatest(F.col("bal"), F.lit(0.0))), "m", "paid", "premium")
    return rounded(rounded(out.select("id", "n", "m", "premium"), 4, "m"), 6, "premium")


@query("walk_score", "C1", """
    WITH p AS (SELECT id, qid, 1.0 / greatest(area, 1e-6) AS a, 1.0 / greatest(psf, 1e-6) AS b, region::double AS c, 1.0 / greatest(price, 1e-6) AS d, 1.0 / greatest(dq, 1e-6) AS e FROM sales),
    m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(d) AS d0, max(d) AS d1, min(e) AS e0, max(e) AS e1 FROM p WHERE qid < 20001)
    SELECT id, round(100 * (0.35 * greatest(0, least(1, (a - a0) / (a1 - a0))) + 0.15 * greatest(0, least(1, (b - b0) / (b1 - b0))) + 0.30 * greatest(0, least(1, (c - c0) / (c1 - c0)))
      + 0.10 * greatest(0, least(1, (d - d0) / (d1 - d0))) + 0.10 * greatest(0, least(1, (e - e0) / (e1 - e0)))), 6) AS walk_score FROM p, m""")
def walk_score(t: Tables):
    parts = features.walk_parts("area", "psf", "region", "price", "dq")
    params = features.fit_score(t.sales.filter(WORK), parts)
    return rounded(features.apply_score(t.sales, params, parts, features.WALK_WEIGHTS, "walk_score").select("id", "walk_score"), 6, "walk_score")


@query("connectivity_score", "C2, S19", """
    WITH p AS (SELECT id, qid, region::double AS a, dq::double AS b, borough::double AS c, 1.0 / greatest(area, 1) AS d, (id % 17)::double AS e FROM sales),
    m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(d) AS d0, max(d) AS d1, min(e) AS e0, max(e) AS e1 FROM p WHERE qid < 20001)
    SELECT id, round(greatest(0, least(100, 100 * (0.30 * greatest(0, least(1, (a - a0) / (a1 - a0))) + 0.25 * greatest(0, least(1, (b - b0) / (b1 - b0))) + 0.20 * greatest(0, least(1, (c - c0) / (c1 - c0)))
      + 0.15 * greatest(0, least(1, (d - d0) / (d1 - d0))) + 0.10 * greatest(0, least(1, (e - e0) / (e1 - e0)))))), 6) AS score FROM p, m""")
def connectivity_score(t: Tables):
    from ..session import scratch_path
    from ..sources.tables import load_params, save_params

    s = t.sales.withColumn("crossings", F.col("id") % 17)
    parts = features.connectivity_parts("region", "dq", "borough", "area", "crossings")
    folder = scratch_path(t.spark, "params")
    save_params({"connectivity": features.fit_score(s.filter(WORK), parts)}, folder)
    params = load_params(t.spark, folder, ["connectivity"])["connectivity"]
    return rounded(features.apply_score(s, params, parts, features.CONNECTIVITY_WEIGHTS, "score").select("id", "score"), 6, "score")


@query("air_score", "C3", """
    WITH e AS (SELECT min(price) AS p0, max(price) AS p1, min(area) AS a0, max(area) AS a1 FROM sales)
    SELECT id, round(100 - 100 * ((price - p0) / (p1 - p0) + (area - a0) / (a1 - a0)) / 2, 6) AS air FROM sales, e""")
def air_score(t: Tables):
    params = aggregates.fit_minmax(t.sales, ["price", "area"])
    return rounded(features.air_score(t.sales, params, ["price", "area"], "air").select("id", "air"), 6, "air")


@query("interactions", "C5, C6", """
    WITH x AS (SELECT id, borough, psf AS crime, area AS sqft, (id % 6)::int AS floors, floor(price) AS income, (id % 40)::int AS units, area * 0.1 * (id % 3) AS land, floor(price * 0.5) AS prior FROM sales)
    SELECT id, (borough = 1)::int AS is_core, crime * (borough = 1)::int AS crime_x_core, crime * (borough <> 1)::int AS crime_x_rest, round(sqft / greatest(floors, 1), 9) AS sqft_per_floor,
      round(income / (crime + 1), 9) AS income_over_crime, round(units / greatest(sqft, 1) * 1000, 9) AS density_index, round(ln(1 + greatest(sqft, 1)) * ln(1 + greatest(floors, 1)), 9) AS log_sqft_x_floors,
      round(ln(1 + greatest(land, 1)), 9) AS log_land, round(least(10, sqft / greatest(land, 1)), 9) AS lot_coverage, round(ln(1 + sqft * greatest(floors, 1)), 9) AS volume_proxy,
      round(prior / greatest(sqft, 1), 9) AS prior_psf, (borough = 1)::int * crime AS is_core_x_crime FROM x""")
def interactions(t: Tables):
    i = F.col("id")
    x = t.sales.select("id", "borough", F.col("psf").alias("crime"), F.col("area").alias("sqft"), (i % 6).cast("int").alias("floors"), F.floor("price").cast("double").alias("income"),
                       (i % 40).cast("int").alias("units"), (F.col("area") * 0.1 * (i % 3)).alias("land"), F.floor(F.col("price") * 0.5).cast("double").alias("prior"))
    out = features.interactions(x, "borough", "crime", "sqft", "floors", "income", "units", "land", "prior")
    out = features.type_interactions(out, ["is_core"], ["crime"]).drop("borough", "crime", "sqft", "floors", "income", "units", "land", "prior")
    return rounded(out, 9, *[c for c in out.columns if c not in ("id", "is_core")])


@query("structure_features", "C7", """
    WITH x AS (SELECT id, (1900 + id % 130)::int AS built, (id % 50) / 5.0 AS builtfar, CASE WHEN id % 3 = 0 THEN NULL ELSE (id % 4)::double END AS facilfar, 2.0 AS residfar,
      CASE WHEN id % 10 = 0 THEN 1 END AS renovated, CASE WHEN id % 10 = 0 THEN 3 END AS since FROM sales)
    SELECT id, greatest(0, 2024 - built) AS building_age, round(least(5, greatest(0, builtfar / greatest(coalesce(facilfar, residfar), 0.01))), 6) AS far_utilization,
      coalesce(renovated, 0) AS renovated, coalesce(since, greatest(0, 2024 - built)) AS since FROM x""")
def structure_features(t: Tables):
    i = F.col("id")
    x = t.sales.select("id", (F.lit(1900) + i % 130).cast("int").alias("built"), ((i % 50) / 5.0).alias("builtfar"), F.when(i % 3 != 0, (i % 4).cast("double")).alias("facilfar"),
                       F.lit(2.0).alias("residfar"), F.when(i % 10 == 0, 1).alias("renovated"), F.when(i % 10 == 0, 3).alias("since"))
    out = features.structure_features(x, "built", 2024, "builtfar", "facilfar", "residfar", "renovated", "since")
    return rounded(out.select("id", "building_age", "far_utilization", "renovated", "since"), 6, "far_utilization")


@query("typed_index", "C10", """
    WITH i AS (SELECT dq, kind, avg(price) AS v FROM sales WHERE dq % 2 = 0 AND kind <> 'BUILDING' GROUP BY ALL), m AS (SELECT kind, avg(v) AS v FROM i GROUP BY kind)
    SELECT s.id, round(coalesce(i.v, m.v, 100), 4) AS type_index FROM sales s LEFT JOIN i ON i.dq = s.dq AND i.kind = s.kind LEFT JOIN m ON m.kind = s.kind""")
def typed_index(t: Tables):
    index = t.sales.filter("dq % 2 = 0 AND kind <> 'BUILDING'").groupBy("dq", "kind").agg(F.avg("price").alias("v"))
    return rounded(features.typed_index(t.sales, index, "dq", "kind", "v").select("id", "type_index"), 4, "type_index")


@query("vs_city", "C11", """
    SELECT region, count(*) AS volume, round(median(price), 4) AS median_price, round(median(price) / (SELECT median(price) FROM sales WHERE qid < 20001) - 1, 8) AS vs_city FROM sales WHERE qid < 20001 GROUP BY region""")
def vs_city(t: Tables):
    return rounded(rounded(features.vs_city(t.sales.filter(WORK), "region", "price"), 4, "median_price"), 8, "vs_city")


@query("time_holdout", "M1, T5", """
    WITH n AS (SELECT floor(count(*) * 0.15)::bigint AS h FROM sales) SELECT id, (row_number() OVER (ORDER BY ts DESC, id DESC) <= h)::int AS holdout FROM sales, n""")
def time_holdout(t: Tables):
    return split.time_split(t.sales.select("id", "ts"), "ts", "id", 0.15).drop("ts")


@query("period_cutoff", "M1", """
    WITH q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT qid FROM sales)), c AS (SELECT qid AS cutoff FROM q WHERE k = floor(n * 0.8))
    SELECT cutoff, count(*) FILTER (WHERE qid >= cutoff) AS n_hold, count(*) FILTER (WHERE qid >= 20001) AS n_fixed FROM sales, c GROUP BY cutoff""")
def period_cutoff(t: Tables):
    cut = split.position_cutoff(t.sales, "qid", 0.8).scalar()
    s = split.cutoff_split(t.sales, "qid", 20001).withColumn("cutoff", cut)
    return s.groupBy("cutoff").agg(F.count_if(F.col("qid") >= F.col("cutoff")).alias("n_hold"), F.sum("holdout").alias("n_fixed"))


@query("group_folds", "M2", """
    WITH z AS (SELECT CASE WHEN parcel % 7 = 0 THEN 'UNK' ELSE parcel::varchar END AS parcel FROM sales), g AS (SELECT parcel, count(*) AS n FROM z GROUP BY parcel),
    o AS (SELECT parcel, n, row_number() OVER (ORDER BY n DESC, md5(parcel), parcel) - 1 AS i FROM g)
    SELECT parcel, n AS n_rows, (CASE WHEN i // 5 % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::int AS fold FROM o""")
def group_folds(t: Tables):
    rows = t.sales.select(F.when(F.col("parcel") % 7 != 0, F.col("parcel")).alias("parcel"))
    return split.group_folds(rows, "parcel", 5)


@query("hash_split", "M2b", """
    SELECT id, (('0x' || substr(md5('42:' || id), 1, 15))::bigint % 10000 < 1200)::int AS picked FROM sales""")
def hash_split(t: Tables):
    return split.hash_split(t.sales.select("id"), ["id"], 0.12)


@query("stratified_split", "M2b", """
    WITH h AS (SELECT borough, ('0x' || substr(md5('42:' || id), 1, 15))::bigint % 10000 AS b FROM sales), n AS (SELECT borough, b, count(*) AS c FROM h GROUP BY ALL),
    u AS (SELECT borough, b, (sum(c) OVER (PARTITION BY borough ORDER BY b) <= sum(c) OVER (PARTITION BY borough) * 0.2)::int AS picked FROM n)
    SELECT s.borough, count(*) AS n_rows, sum(picked)::bigint AS n_picked FROM h s JOIN u ON s.borough = u.borough AND s.b = u.b GROUP BY s.borough""")
def stratified_split(t: Tables):
    out = split.stratified_split(t.sales.select("borough", "id"), ["borough"], ["id"], 0.2)
    return out.groupBy("borough").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("picked").alias("n_picked"))


@query("ridge_blend", "M4", """
    WITH x AS (SELECT ln(1 + price) AS y, ln(1 + area) AS a, dq / 10.0 AS b FROM sales), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
    s AS (SELECT sum((a - ma) * (a - ma)) + 1.0 AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) + 1.0 AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_ FROM x, m)
    SELECT round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) AS w_a, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS w_b,
      round(my - (ay * bb - by_ * ab) / (aa * bb - ab * ab) * ma - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * mb, 6) AS intercept FROM s, m""")
def ridge_blend(t: Tables):
    x = t.sales.select(F.log1p("price").alias("y"), F.log1p("area").alias("a"), (F.col("dq") / 10).alias("b"))
    fit = model.fit_ridge(x, ["a", "b"], "y", alpha=1.0)
    row = x.agg(F.lit(fit["weights"]["a"]).alias("w_a"), F.lit(fit["weights"]["b"]).alias("w_b"), F.lit(fit["intercept"]).alias("intercept"))
    return rounded(row, 6, "w_a", "w_b", "intercept")


PRED = "x AS (SELECT id, borough, kind, region, price, floor(price * (0.7 + (id * 7919 % 601) / 1000.0)) AS pred FROM sales)"


def predicted(t: Tables):
    return t.sales.select("id", "borough", "kind", "region", "price", F.floor(F.col("price") * (F.lit(0.7) + (F.col("id") * 7919 % 601) / F.lit(1000.0))).cast("double").alias("pred"))


METRICS = """count(*) AS n, round(avg(abs(price - pred)), 4) AS mae, round(1 - sum(pow(ln(1 + price) - ln(1 + pred), 2)) / nullif(regr_sxx(ln(1 + price), ln(1 + price)), 0), 6) AS r2_log,
    round(median(abs(pred - price) / greatest(price, 1) * 100), 6) AS medape"""


@query("metrics", "M7", f"WITH {PRED} SELECT {METRICS} FROM x")
def metrics(t: Tables):
    return rounded(rounded(evaluate.metrics(predicted(t), "price", "pred"), 4, "mae"), 6, "r2_log", "medape")


TIER = "CASE WHEN price < 100000 THEN 'low' WHEN price < 300000 THEN 'mid' ELSE 'high' END"
SEGMENTS = f"""SELECT 'all' AS segment_kind, 'all' AS segment, {METRICS} FROM x UNION ALL SELECT 'borough', borough::varchar, {METRICS} FROM x GROUP BY borough
    UNION ALL SELECT 'tier', {TIER}, {METRICS} FROM x GROUP BY 2"""


def segment_columns():
    from ..functions.numbers import band

    return {"borough": F.col("borough"), "tier": band("price", [100_000, 300_000], ["low", "mid", "high"])}


@query("segment_metrics", "M8, V10", f"WITH {PRED} {SEGMENTS}")
def segment_metrics(t: Tables):
    out = evaluate.segment_metrics(predicted(t), "price", "pred", segment_columns())
    return rounded(rounded(out, 4, "mae"), 6, "r2_log", "medape")


@query("best_segments", "T6, M8", f"WITH {PRED}, y AS (SELECT region, {METRICS} FROM x GROUP BY region) SELECT * FROM y ORDER BY medape, region LIMIT 5")
def best_segments(t: Tables):
    from ..operators.ranking import best_segments as best

    out = best(evaluate.metrics(predicted(t), "price", "pred", ["region"]), "medape", 5, ["region"])
    return rounded(rounded(out, 4, "mae"), 6, "r2_log", "medape")


ERRORS = f"""e AS (SELECT 'all' AS k, 'all' AS s, median(abs(pred - price) / greatest(price, 1) * 100) AS m FROM x UNION ALL SELECT 'borough', borough::varchar, median(abs(pred - price) / greatest(price, 1) * 100) FROM x WHERE borough <> 2 GROUP BY borough
    UNION ALL SELECT 'tier', CASE WHEN price < 500000 THEN '<$500K' END, median(abs(pred - price) / greatest(price, 1) * 100) FROM x GROUP BY 2)"""


@query("confidence", "M9, M11", f"""
    WITH {PRED}, {ERRORS}, f AS (SELECT x.*, CASE WHEN pred < 500000 THEN '<$500K' WHEN pred < 1000000 THEN '$500K–1M' ELSE '$1M–3M' END AS tier FROM x),
    w AS (SELECT f.*, greatest(coalesce(b.m, a.m), coalesce(t.m, a.m)) AS worst FROM f LEFT JOIN e b ON b.k = 'borough' AND b.s = borough::varchar LEFT JOIN e t ON t.k = 'tier' AND t.s = f.tier, (SELECT m FROM e WHERE k = 'all') a)
    SELECT id, tier, round_even(worst, 2) AS segment_medape, greatest(0, least(100, round_even(100 - worst, 0)::int)) AS confidence_score,
      CASE WHEN round_even(100 - worst, 0) >= 85 THEN 'A' WHEN round_even(100 - worst, 0) >= 75 THEN 'B' WHEN round_even(100 - worst, 0) >= 65 THEN 'C' ELSE 'D' END AS confidence_grade,
      round_even(pred * (1 - round_even(worst, 2) / 100), 0)::bigint AS confidence_low, round_even(pred * (1 + round_even(worst, 2) / 100), 0)::bigint AS confidence_high,
      array_to_string(list_filter([CASE WHEN id % 9 < 5 THEN 'SPARSE_MARKET' END, CASE WHEN pred > 3000000 THEN 'LUXURY_SEGMENT' END, CASE WHEN round_even(worst, 2) > 30 THEN 'HIGH_UNCERTAINTY' END,
        CASE WHEN borough = 1 AND pred > 1000000 THEN 'METRO_CORE' END], lambda z: z IS NOT NULL), ',') AS flags FROM w""")
def confidence(t: Tables):
    x = predicted(t)
    kinds = {"borough": F.when(F.col("borough") != 2, F.col("borough")), "tier": F.when(F.col("price") < 500_000, "<$500K")}
    errors = evaluate.segment_metrics(x, "price", "pred", kinds).filter(F.col("segment").isNotNull())
    out = evaluate.confidence(x, "pred", "borough", errors)
    out = evaluate.qc_flags(out.withColumn("comps", F.col("id") % 9), "comps", "pred", "segment_medape", "borough")
    return out.select("id", "tier", "segment_medape", "confidence_score", "confidence_grade", "confidence_low", "confidence_high",
                      F.array_join("qc_flags", ",").alias("flags"))


@query("clamped_interval", "M10", f"""
    WITH {PRED}, d AS (SELECT region, median(abs(pred - price) / price * 100) AS m FROM x WHERE region <> 3 GROUP BY region)
    SELECT id, round(greatest(16, least(17, coalesce(m, 44))), 6) AS conf_pct, trunc(pred * (1 - greatest(16, least(17, coalesce(m, 44))) / 100))::bigint AS conf_low,
      trunc(pred * (1 + greatest(16, least(17, coalesce(m, 44))) / 100))::bigint AS conf_high FROM x LEFT JOIN d USING (region)""")
def clamped_interval(t: Tables):
    x = predicted(t)
    errors = evaluate.district_errors(x.filter("region <> 3"), "price", "pred", "region")
    out = evaluate.attach_error(x, errors, "region", F.lit(44.0))
    out = evaluate.clamp_interval(out, "pred", F.col("district_medape"), 16.0, 17.0)
    return rounded(out.select("id", "conf_pct", "conf_low", "conf_high"), 6, "conf_pct")


@query("segment_blend", "M6", f"""
    WITH {PRED} SELECT id, round((1 - greatest(0, least(1, (price - 150000) / 150000))) * price + greatest(0, least(1, (price - 150000) / 150000)) * pred, 4) AS blended FROM x""")
def segment_blend(t: Tables):
    return rounded(evaluate.blend_segment(predicted(t), "price", "pred", 150_000, "blended").select("id", "blended"), 4, "blended")


@query("market_validation", "M14", f"""
    WITH {PRED}, a AS (SELECT *, abs(pred - price) / price * 100 AS ape FROM x) SELECT region, kind, count(*) AS n, round(avg(price), 2) AS mean_asking, round(avg(pred), 2) AS mean_predicted,
      round(avg(abs(pred - price)), 2) AS mean_abs_error, round(avg((ape <= 20)::int), 6) AS within_20pct, round(median(ape), 6) AS medape FROM a GROUP BY region, kind""")
def market_validation(t: Tables):
    out = evaluate.validate_market(predicted(t), "pred", "price", ["region", "kind"])
    return rounded(rounded(out, 2, "mean_asking", "mean_predicted", "mean_abs_error"), 6, "within_20pct", "medape")


@query("accept_model", "M15", f"""
    WITH {PRED}, r AS (SELECT 1 - sum(pow(ln(1 + price) - ln(1 + pred), 2)) / regr_sxx(ln(1 + price), ln(1 + price)) AS o, 1 - sum(pow(ln(1 + price) - ln(1 + pred * 1.01), 2)) / regr_sxx(ln(1 + price), ln(1 + price)) AS n FROM x)
    SELECT round(o, 6) AS old_score, round(n, 6) AS new_score, (n >= o - 0.002)::int AS accepted FROM r""")
def accept_model(t: Tables):
    x = predicted(t).withColumn("pred2", F.col("pred") * 1.01)
    out = evaluate.accept_model(evaluate.metrics(x, "price", "pred"), evaluate.metrics(x, "price", "pred2"))
    return rounded(out, 6, "old_score", "new_score")


@query("shift_check", "M17", f"""
    WITH {PRED}, q AS (SELECT quantile_cont(pred, 0.25) AS a, median(pred) AS b, quantile_cont(pred, 0.75) AS c, median(price) AS d, min(pred) AS m FROM x)
    SELECT 'median_ratio' AS "check", round(b / d, 6) AS value, (b / d BETWEEN 1 / 3.0 AND 3)::int AS passed FROM q UNION ALL SELECT 'quartile_spread', round(c / a, 6), (c >= 1.5 * a)::int FROM q UNION ALL SELECT 'positive', m, (m > 0)::int FROM q""")
def shift_check(t: Tables):
    return rounded(evaluate.shift_check(predicted(t), "pred", "price"), 6, "value")


@query("pinned_values", "M18", f"""
    WITH {PRED} SELECT x.id, round(abs(pred / price - 1) * 100, 6) AS deviation_pct, (abs(pred / price - 1) * 100 <= 5)::int AS passed FROM x""")
def pinned_values(t: Tables):
    x = predicted(t)
    expected = x.select("id", F.col("price").alias("pinned"), F.lit(5.0).alias("tolerance_pct"))
    out = evaluate.check_pins(x.select("id", "pred"), expected, "id", "pred")
    return rounded(out.select("id", "deviation_pct", "passed"), 6, "deviation_pct")


MODEL_FEATURES = ["area", "dq", "region", "borough", "lat", "lon"]


@query("driver_contract", "M12, M13, T2", """
    WITH m AS (SELECT median(area) AS a, median(dq) AS d, median(region) AS r FROM sales WHERE qid < 20001),
    i AS (SELECT id, unnest(['area', 'dq', 'region']) AS feature, unnest([area, dq, region]) AS value, unnest([round(0.001 * (area - a), 9), round(0.05 * (dq - d), 9), round(-0.02 * (region - r), 9)]) AS impact FROM sales, m),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature) AS rank FROM i)
    SELECT id, rank::int AS rank, round(sum(impact) OVER (PARTITION BY id ORDER BY rank), 6) + 0.0 AS total_after FROM k WHERE rank <= 2""")
def driver_contract(t: Tables):
    # a transparent linear predictor: ablation impacts have a closed form
    cols = ["area", "dq", "region"]
    mid = impute.group_agg(t.sales.filter(WORK), [], [], {c: (c, 0.5) for c in cols})
    predict = lambda df: df.withColumn("log_prediction", 0.001 * F.col("area") + 0.05 * F.col("dq") - 0.02 * F.col("region"))
    impacts = model.ablation_impacts(t.sales, ["id"], cols, mid, predict)
    impacts = impacts.withColumn("impact", F.round("impact", 9))
    out = model.waterfall(model.top_drivers(impacts, ["id"], 2), ["id"])
    return rounded(out.select("id", "rank", "total_after"), 6, "total_after")


# a price that the features explain: what learns nothing cannot pass
def explained(t: Tables):
    noise = F.lit(0.95) + (F.col("id") * 7919 % 101) / F.lit(1000.0)
    return t.sales.select("id", "qid", (F.col("area") * (100 + 5 * F.col("region")) * noise).alias("price"), *MODEL_FEATURES)


@query("stack_model", "M3, M4, M5, M6, M2, S19", """
    SELECT count(*) FILTER (WHERE dq < 22) AS n_work, count(*) FILTER (WHERE dq >= 22) AS n_scored, 4::bigint AS n_learners, 0::bigint AS n_missing, 0::bigint AS split_groups, 3::bigint AS n_folds,
           TRUE AS beats_mean, TRUE AS learners_beat_mean, TRUE AS segment_takes_over, TRUE AS weights_not_negative, TRUE AS same_when_loaded FROM sales""")
def stack_model(t: Tables):
    """Grouped out-of-fold stack with four learners of the default size, stored and loaded: what SQL can state of it."""
    s, cut = explained(t), 400_000
    work, hold = s.filter("dq < 22"), s.filter("dq >= 22")
    folded, _ = stored(split.attach_folds(work, split.group_folds(work, "region", 3), "region"), "stack-rows")
    fitted = model.stack(folded, MODEL_FEATURES, "price", "fold", 3, segment=(F.col("price") > cut, cut))
    folder = scratch_path(t.spark, "stack")
    model.save_stack(t.spark, fitted, folder)
    loaded = model.load_stack(t.spark, folder)
    plain = model.predict_stack(hold, fitted | {"segment": None}, "plain")
    scored, _ = stored(model.predict_stack(model.predict_stack(plain, fitted), loaded, "again"), "stack-scored")
    y, left = F.log1p("price"), lambda c: F.sum(F.pow(F.log1p(c) - F.log1p("price"), F.lit(2.0)))
    weights = fitted["meta"]["weights"].values() if fitted["kind"] == "ridge" else []
    spread = folded.agg(F.var_pop(F.log1p("price"))).scalar()
    groups = folded.groupBy("region").agg(F.count_distinct("fold").alias("n"))
    # below the cut the segment's model has no say, from twice the cut on it speaks alone
    moved = F.bool_and((F.col("plain") > cut) | (F.col("plain") == F.col("predicted"))) & F.bool_or((F.col("plain") > cut) & (F.col("plain") != F.col("predicted")))
    return scored.agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("predicted").isNull()).alias("n_missing"), F.bool_and(F.col("predicted") == F.col("again")).alias("same_when_loaded"),
        (left("predicted") < 0.5 * F.regr_sxx(y, y)).alias("beats_mean"), moved.alias("segment_takes_over"),
    ).select("*", folded.agg(F.count(F.lit(1))).scalar().alias("n_work"), folded.agg(F.count_distinct("fold")).scalar().alias("n_folds"), groups.agg(F.count_if(F.col("n") > 1)).scalar().alias("split_groups"),
             F.lit(len(loaded["models"])).cast("bigint").alias("n_learners"), (F.lit(min(fitted["errors"].values())) < spread).alias("learners_beat_mean"),
             F.lit(all(w >= 0 for w in weights)).alias("weights_not_negative"))


@query("importance", "T3, M16, M6", """SELECT 6::bigint AS n_features, 100.0::double AS top, 'area,region' AS first_two, 'Structural' AS first_kind, TRUE AS falling""")
def importance(t: Tables):
    """Importances of one boosted-tree model of the default size: what made the price comes first, scaled to a maximum of 100."""
    fitted = model.fit_segment_model(explained(t), MODEL_FEATURES, "price", F.col("price") > 100_000)
    kinds = {"lat": "Location", "lon": "Location", "region": "Location", "borough": "Location", "area": "Structural", "dq": "Market"}
    table = model.importance_table(t.spark, fitted, MODEL_FEATURES, kinds, 25)
    order = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("down"), "feature", "category")))
    return table.agg(F.count(F.lit(1)).alias("n_features"), F.max("importance").alias("top"), order.alias("o")).select(
        "n_features", "top", F.concat_ws(",", F.col("o")[0]["feature"], F.col("o")[1]["feature"]).alias("first_two"), F.col("o")[0]["category"].alias("first_kind"),
        (F.col("o")[0]["down"] < F.col("o")[5]["down"]).alias("falling"))
