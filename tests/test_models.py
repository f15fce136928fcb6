"""Stored pipelines, model versions, shared rankings and point indexes."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hectare.operators import quantiles, spatial
from hectare.products import city_model, model_store
from hectare.session import scratch_path, shared_dir


def test_a_broken_write_changes_nothing(spark):
    store = model_store.ModelStore(spark, scratch_path(spark, "store"))
    score = lambda x: spark.createDataFrame([(x,)], "r2_log double")
    step = lambda v: PipelineModel([city_model.Looked.of(spark.createDataFrame([(1, v)], "k int, v double"), ["k"], {"v": -1.0})])
    assert store.current() is None
    with pytest.raises(LookupError):
        model_store.applied(store, spark.range(1))
    assert store.offer(step(1.0), score(0.5))[0] and store.numbers() == [1]
    store.write_aside(step(9.0), score(0.9))
    accepted, now = store.offer(step(2.0), score(0.4))
    assert not accepted and now.number == 1
    accepted, now = store.offer(step(3.0), score(0.4985))
    assert accepted and now.number == 2
    with pytest.raises(RuntimeError):
        store.commit("late", 1)
    rows = model_store.applied(store, spark.createDataFrame([(1,), (2,), (None,)], "k int")).collect()
    assert {(r.k, r.v, r.model_version) for r in rows} == {(1, 3.0, 2), (2, -1.0, 2), (None, -1.0, 2)}


def test_city_features_after_storing(spark):
    r = random.Random(4)
    spot = lambda: (40.5 + r.random() / 10, -74 + r.random() / 10)
    work = spark.createDataFrame([(i, *spot(), i % 3, "ab"[i % 2], i % 20, 12 + i % 8, 50.0 + i, 1000.0 + i) for i in range(90)],
                                 "id int, lat double, lon double, region int, kind string, parcel int, dq int, area double, price double")
    places = spark.createDataFrame([(*spot(), k) for k in "xyz" for _ in range(20)], "lat double, lon double, kind string")
    subjects = spark.createDataFrame([(i, *spot(), "q") for i in range(15)] + [(99, None, None, None)], "id int, lat double, lon double, kind string")
    made = city_model.fit_city_features(work, places, "kind", ["x", "y", "z"], 19, scale_on=subjects)
    loaded = city_model.store_model(made, scratch_path(spark, "city"))
    a, b = (sorted(map(str, m.transform(subjects).select(*made.transform(subjects).columns).collect())) for m in (made, loaded))
    assert a == b and len(a) == 16
    for row in loaded.transform(subjects).filter("id < 15").collect():
        d = {k: min(np.hypot(p.lat - row.lat, p.lon - row.lon) * 111_000 for p in places.collect() if p.kind == k) for k in "xyz"}
        assert all(abs(row[f"dist_{k}_m"] - d[k]) < 1e-6 for k in "xyz")


def test_fitted_tables_are_computed_once(spark):
    """Sums of doubles depend on the order of rows: a fitted model reads stored tables instead of summing again at every use."""
    work = spark.range(60).selectExpr("id", "40.0 + id / 1000 AS lat", "-74.0 AS lon", "int(id % 3) AS region", "'a' AS kind", "id % 20 AS parcel", "int(12 + id % 8) AS dq", "50.0 + id AS area", "1000.0 + id AS price")
    made = city_model.fit_city_features(work, work.select("lat", "lon", "kind"), "kind", ["a", "b", "c"], 19, scale_on=work.select("id", "lat", "lon", "kind"))
    for step in made.stages:
        for name, table in step.tables.items():
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            assert table.inputFiles() and "Aggregate" not in plan and "Range" not in plan, (type(step).__name__, name)


def test_index_serves_every_look_up(spark):
    r = random.Random(9)
    pts = [(i, 10 + r.random(), 20 + r.random(), i % 4) for i in range(300)] + [(900 + i, 10.5, 20.5, i % 3) for i in range(200)]
    p = spark.createDataFrame(pts, "id int, lat double, lon double, kind int")
    s = spark.createDataFrame([(i, 10 + r.random(), 20 + r.random()) for i in range(40)] + [(40, None, 1.0)], "sid int, lat double, lon double")
    index = spatial.index_points(p, {"even": F.col("kind") % 2 == 0, "three": F.col("kind") == 3, "none": F.lit(False)}, p_id="id", cols=["kind"], keep=3, leaf_size=4)
    at = spatial.query_places(s)
    out = spatial.nearest_strata(s, index, {"d_even": "even", "d_three": "three", "d_none": "none"}, places=at)
    out = spatial.count_within(out, index, 9000, {"n_even": "even", "n_none": "none"}, metric="flat", places=at)
    flat = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1]) * 111_000
    for x in out.collect():
        if x.lat is None:
            assert (x.d_even, x.d_three, x.n_even) == (None, None, 0)
            continue
        own = [(flat((x.lat, x.lon), q[1:3]), q[3]) for q in pts]
        assert abs(x.d_even - min(d for d, k in own if k % 2 == 0)) < 1e-6 and abs(x.d_three - min(d for d, k in own if k == 3)) < 1e-6
        assert x.d_none is None and x.n_none == 0 and x.n_even == sum(d <= 9000 and k % 2 == 0 for d, k in own)
    near = {(x.lat, x.lon, x["rank"]): x.id for x in spatial.nearest_k(s, index, 3, places=at).collect()}
    for x in s.filter("lat IS NOT NULL").collect():
        best = sorted((round(flat((x.lat, x.lon), q[1:3]), 9), q[0]) for q in pts)[:3]
        assert [near[(x.lat, x.lon, i + 1)] for i in range(3)] == [i for _, i in best]
    with pytest.raises(ValueError):
        spatial.nearest_k(s, index, 4)


def test_one_ranking_for_several_values_and_groupings(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1, None]), r.choice([None, float("nan"), r.gauss(0, 50), 7.0]), r.random() * 1e6 if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows + [("empty", 2, None, None)], "g string, h int, x double, y double")
    clean = lambda values: [v for v in values if v is not None and v == v]
    got = quantiles.group_agg(df, ["g"], [F.count(F.lit(1)).alias("n")], {"mx": ("x", 0.5), "q": ("x", 0.1), "my": ("y", 0.75)}).collect()
    assert len(got) == 4
    for x in got:
        own = [q for q in rows if q[0] == x.g]
        for name, i, p in (("mx", 2, 0.5), ("q", 2, 0.1), ("my", 3, 0.75)):
            values = clean(q[i] for q in own)
            assert (x[name] is None) == (not values) and (not values or abs(x[name] - np.quantile(values, p)) < 1e-9)
    sets = quantiles.quantile_sets(df, {"g": ["g"], "gh": ["g", "h"], "all": []}, "x", {"m": 0.5})
    assert abs(sets["all"].first().m - np.median(clean(q[2] for q in rows))) < 1e-9
    assert {(x.g, x.h): x.m for x in sets["gh"].collect()} == {k: np.median(v) for k in {q[:2] for q in rows} if (v := clean(q[2] for q in rows if q[:2] == k))}
    assert {x.g for x in sets["g"].collect()} == {"a", "b", None}


def test_shared_folder_of_a_plain_local_session(spark, monkeypatch):
    from hectare import session

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        applicationId, master = "app-1", "local[2]"

    class Plain:
        conf, sparkContext = Conf, Context

    folder = shared_dir(Plain)
    assert folder == shared_dir(Plain) and folder == session._OWN_FOLDERS["app-1"]
    Context.master = "spark://far:7077"
    with pytest.raises(ValueError):
        shared_dir(Plain)


def test_city_stack_fits_learners_of_the_default_size(spark, monkeypatch):
    from hectare.operators import model
    from hectare.plans import all_queries

    class Seen(Exception):
        pass

    def caught(work, features, target, fold, k, learners=None, **_):
        learners = learners or model.default_learners(early_stop=True)
        raise Seen({n: x.getOrDefault(x.numTrees if n == "forest" else x.maxIter) for n, x in learners.items() if n != "linear"})

    monkeypatch.setattr(model, "stack", caught)
    with pytest.raises(Seen) as seen:
        all_queries().QUERIES["city_stack"](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == {"gbt_deep": 20, "gbt_flat": 40, "forest": 40}
