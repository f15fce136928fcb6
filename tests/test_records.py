"""Parsing, cleaning, confidence, modelling and append rules on edge rows."""

import json
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectare.functions import dates, numbers, text
from hectare.operators import aggregates, clean, evaluate, model
from hectare.products import panel_store
from hectare.session import scratch_path
from hectare.sources import collections, places, tables
from hectare.streaming.append import append_stream


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("x")).first().x


@pytest.mark.parametrize("value,want", [("2025-1", None), ("2025-13-01", None), ("2025-04-30", 20252), (None, None), ("", None), ("2025-12", 20254)])
def test_quarter_from_text(spark, value, want):
    assert one(spark, value, dates.quarter_id_from_text) == want


@pytest.mark.parametrize("value,want", [("123.0", "00123"), ("10001", "10001"), ("1234567", "1234567"), ("x", None), (None, None)])
def test_zip(spark, value, want):
    assert one(spark, value, text.zip5) == want


@pytest.mark.parametrize("value,want", [(" 12.5 ", 12.5), ("NaN", None), ("", None), ("1,000", None)])
def test_to_number(spark, value, want):
    assert one(spark, value, numbers.to_number) == want


@pytest.mark.parametrize("value,want", [("ﺷﻘﺔ", "شقة"), ("مُحَمَّـد ", "محمد"), (None, ""), ("abc", "abc")])
def test_normalise_arabic(spark, value, want):
    assert one(spark, value, text.normalize_ar) == want


@pytest.mark.parametrize("body,price", [
    ("السعر: 850 ألف", 850_000.0), ("السعر: 1.2 مليون", 1_200_000.0), ("السعر: 1200", 1_200_000.0), ("السعر: 1,250,000", 1_250_000.0),
    ("سعر الوحدة - 60000", 60_000.0), ("السعر: 0", None), ("بدون", None)])
def test_listing_price_units(spark, body, price):
    df = spark.createDataFrame([(body,)], "d string")
    assert text.parse_listing_text(df, "d").first().price_sar == price


def test_panel_bounds(spark):
    df = spark.createDataFrame([(100.0,), (100.01,), (100_000.0,), (100_000.5,), (None,)], "p double")
    assert [r.p for r in clean.sane_range(df, "p", 100, 100_000, "(]").collect()] == [100.01, 100_000.0]


def test_rejects_carry_all_reasons(spark):
    df = spark.createDataFrame([(1, 40.7, "A1", 100.0), (2, 51.5, None, -100.0), (3, 40.7, "A1", None)], "id int, lat double, cls string, area double")
    ok, bad = clean.validate_batch(df, clean.subject_rules(["cls", "area"], {"lat": (40.4, 40.95)}, ["area"]))
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: len(r.errors) for r in bad.collect()} == {2: 3, 3: 1}


def test_clip_keeps_null_and_winsor_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (50.0,)], "v double")
    assert [r.x for r in df.select(dates.clip("v", 10, 20).alias("x")).collect()] == [None, 10.0, 20.0]
    caps = clean.fit_winsor(df, ["v"], 0.5)
    assert [r.v for r in clean.apply_winsor(df, caps, ["v"]).collect()] == [None, 5.0, 27.5]


def test_confidence_properties(spark):
    errors = spark.createDataFrame([("all", "all", 20.0), ("borough", "1", 35.5), ("borough", "5", 9.0), ("tier", "<$500K", 12.0), ("tier", "$3M–10M", 140.0)], "segment_kind string, segment string, medape double")
    grid = [(b, float(p)) for b in (1, 3, 5) for p in (1, 499_999, 500_000, 4_000_000, 20_000_000)]
    out = evaluate.confidence(spark.createDataFrame(grid, "borough int, price double"), "price", "borough", errors).collect()
    for r in out:
        assert 0 <= r.confidence_score <= 100 and r.confidence_low <= r.price <= r.confidence_high
        assert r.confidence_grade == ("A" if r.confidence_score >= 85 else "B" if r.confidence_score >= 75 else "C" if r.confidence_score >= 65 else "D")
    by = {(r.borough, r.price): r.confidence_score for r in out}
    assert by[(5, 1.0)] == 88 and by[(1, 1.0)] == 64 and by[(3, 500_000.0)] == 80 and by[(5, 4_000_000.0)] == 0


def test_ridge_equals_closed_form_and_nonneg(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) + 5
    y = x @ [0.5, -0.7, 0.9] + 3 + r.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    fit = model.fit_ridge(df, ["a", "b", "c"], "y", alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    assert np.allclose(list(fit["weights"].values()), w) and abs(fit["intercept"] - (y.mean() - x.mean(0) @ w)) < 1e-9
    pos = model.fit_ridge(df, ["a", "b", "c"], "y", alpha=2.0, nonneg=True)["weights"]
    assert pos["b"] == 0.0 and min(pos.values()) >= 0


def test_drivers_are_sorted_and_signed(spark):
    df = spark.createDataFrame([(1, 10.0, 3.0), (2, 0.0, -3.0)], "id int, a double, b double")
    mid = spark.createDataFrame([(5.0, 0.0)], "a double, b double")
    impacts = model.ablation_impacts(df, ["id"], ["a", "b"], mid, lambda d: d.withColumn("log_prediction", F.col("a") - 2 * F.col("b")))
    rows = model.top_drivers(impacts, ["id"]).collect()
    assert {(r.id, r["rank"], r.feature, r.impact, r.direction) for r in rows} == {
        (1, 1, "b", -6.0, "negative"), (1, 2, "a", 5.0, "positive"), (2, 1, "b", 6.0, "positive"), (2, 2, "a", -5.0, "negative")}


def test_geojson_collection_and_lines_are_read_alike(spark):
    folder = scratch_path(spark, "gj")
    f1 = '{"type":"Feature","geometry":{"type":"Point","coordinates":[46.1,24.2]},"properties":{"name":"x"}}'
    f2 = '{"type":"Feature","geometry":null,"properties":{"name":"y","geo_point_2d":{"lat":1.0,"lon":2.0}}}'
    f3 = '{"type":"Feature","geometry":null,"properties":{"name":"z"}}'
    spark.createDataFrame([('{"type":"FeatureCollection","features":[' + ",".join([f1, f2, f3]) + "]}",)], "v string").coalesce(1).write.text(folder + "/doc")
    spark.createDataFrame([(x,) for x in (f1, f2, f3)], "v string").write.text(folder + "/lines")
    for kind in ("doc", "lines"):
        got = places.geojson_points(places.read_features(spark, f"{folder}/{kind}", lines=kind == "lines"), {"name": "name"}).collect()
        assert {(r.name, r.lat, r.lon) for r in got} == {("x", 24.2, 46.1), ("y", 1.0, 2.0)}


def test_append_version_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    once = tables.append_version(old, new, ["id"])
    twice = tables.append_version(once, new, ["id"])
    assert sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c")]


def test_stream_takes_only_new_files(spark):
    base = scratch_path(spark, "st")
    schema = "id int, v int"

    def deliver(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/landing/{name}")
        append_stream(spark, f"{base}/landing/*", spark.createDataFrame([], schema).schema, f"{base}/table", f"{base}/cp", ["id"], ["v"]).awaitTermination()

    deliver([(1, 1), (2, 5), (2, 3)], "a")
    deliver([(2, 9), (3, 1)], "b")
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{base}/table").collect()) == [(1, 1), (2, 3), (3, 1)]


def test_panel_store_equals_a_full_rebuild(spark):
    schema = "id int, version int, district string, ts date, psqm double, amount double, gone boolean"
    day = lambda q: date(2020, 3 * q - 1, 5)
    r = np.random.default_rng(4)
    folder = scratch_path(spark, "panel")
    store = panel_store.PanelStore(spark, folder, ["id"], "version", ["district"], "ts", "psqm", "amount", "gone")
    state, touched = {}, []
    deliveries = [[(i, 1, "ab"[i % 2], day(1 + i % 4), float(r.integers(90, 130)), float(r.integers(1, 99)) / 10, False) for i in range(60)]]
    # corrected price, district and quarter; a late row; a deletion; an older version after a newer one; a null price, day and district
    deliveries.append([(0, 2, "a", day(1), 500.5, 0.1, False), (1, 2, None, day(1), 120.0, 0.2, False), (4, 3, "b", day(1), 110.0, None, True), (99, 1, "a", day(1), 101.0, 3.0, False),
                       (98, 1, "a", None, 101.0, 3.0, False), (97, 1, "a", day(1), None, 3.0, False), (0, 3, "a", day(1), 501.5, 0.1, False), (96, None, "a", day(1), 111.0, 1.0, False)])
    deliveries.append([(4, 2, "b", day(1), 115.0, 1.0, False), (0, 1, "a", day(2), 105.0, 1.0, False), (96, 1, "a", day(1), 112.0, 1.0, False)])
    # one quarter emptied
    deliveries.append([(i, 9, "a", day(4), 100.5, 1.0, True) for i in range(3, 60, 4)])
    for rows in deliveries:
        number = store.take(spark.createDataFrame(rows, schema))
        touched.append(store.commits()[-1]["quarters"])
        for x in rows:
            if x[0] not in state or (x[1] or 0) > (state[x[0]][1] or 0):
                state[x[0]] = x
        assert store.take(spark.createDataFrame(rows, schema)) == number
        want = spark.createDataFrame([x for x in state.values() if not x[6]], schema)
        assert sorted(map(str, store.deals().collect())) == sorted(map(str, want.collect()))
        full = aggregates.quarterly_panel(want, ["district"], "ts", "psqm", "amount")
        assert sorted(map(str, store.panel().select(full.columns).collect())) == sorted(map(str, full.collect()))
    assert touched == [[20201, 20202, 20203, 20204], [20201, 20202], [20201], [20204]]


def test_panel_store_broken_write_and_second_writer_change_nothing(spark, monkeypatch):
    schema = "id int, version int, district string, ts date, psqm double, amount double"
    store = panel_store.PanelStore(spark, scratch_path(spark, "panel"), ["id"], "version", ["district"], "ts", "psqm", "amount", min_n=1)
    assert store.take(spark.createDataFrame([], schema)) == 0
    with pytest.raises(LookupError):
        store.panel()
    assert store.take(spark.createDataFrame([(1, 1, "a", None, 150.0, 1.0)], schema)) == 1 and store.panel().collect() == []
    row = lambda n: spark.createDataFrame([(1, n, "a", date(2020, 1, 1), 150.0 + n, 1.0)], schema)
    assert store.take(row(2)) == 2
    with monkeypatch.context() as m:
        m.setattr(store, "_panel_of", lambda cells: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.take(row(3))
    assert [x.median_psqm for x in store.panel().collect()] == [152.0]
    with pytest.raises(Exception, match="already exists"):
        store._commit("other", [], 1)
    assert store.take(row(3)) == 3 and [x.median_psqm for x in store.panel().collect()] == [153.0]


@pytest.mark.parametrize("few", [0, 200_000])
def test_panel_store_deals_rows_by_id_once_and_logs_them_once(spark, monkeypatch, few):
    monkeypatch.setattr(panel_store, "FEW_ROWS", few, raising=False)
    schema = "id int, version int, district string, ts date, psqm double, amount double"
    make = lambda rows: spark.createDataFrame(rows, schema)
    store = panel_store.PanelStore(spark, scratch_path(spark, "panel"), ["id"], "version", ["district"], "ts", "psqm", "amount", min_n=1)
    day = date(2020, 1, 1)
    first = [(None, 1, "a", day, 150.0, 1.0), *[(i, 1, "a", day, 150.0, 1.0) for i in range(20)]]
    second = [(None, 2, "a", day, 250.0, 1.0), (None, 3, "b", day, 260.0, 1.0), (3, 1, "a", day, 999.0, 1.0), (4, 2, "a", day, 170.0, 2.5), (40, 1, "b", day, 180.0, 1.0)]
    assert store.take(make(first)) == 1
    plan = store._pairs(make(second), store._log(store.commits()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= (1 if few == 0 else 2) and "SortMergeJoin" not in plan
    assert store.take(make(second)) == 2 and store.take(make(first)) == 2
    assert {(r.district, r.deed_count, r.total_value, r.median_psqm) for r in store.panel().collect()} == {("a", 20, 21.5, 150.0), ("b", 2, 2.0, 220.0)}
    assert {(r.id, r.version) for r in store.deals().collect()} == {(None, 3), (4, 2), (40, 1), *[(i, 1) for i in range(20) if i != 4]}
    # every version that was taken up lies in the folder once
    kept = [spark.read.parquet(f"{store.folder}/data/{c['name']}/{kind}") for c in store.commits() for kind in ("pairs", "deals")
            if store._files().exists(store._path(f"data/{c['name']}/{kind}"))]
    assert sum(df.count() for df in kept) == 24


@pytest.mark.parametrize("size", ["64", "300", "1m"])
def test_collections_are_read_by_byte_ranges(spark, size):
    folder = scratch_path(spark, "collections")
    odd = ['a{b', 'c}d"', "\\", "\\\"{", "شقة", "", "{" * 30, "x" * 500]
    features = [{"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [46.0 + i, 24.0]} if i % 5 else None,
                 "properties": {"name": f"{i}{odd[i % 8]}", "nested": {"a": {"b": odd[(i + 3) % 8]}}}} for i in range(40)]
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn}{"}}, "bbox": [1, 2]}
    docs = {"one": json.dumps(head | {"features": features[:30]}), "two": json.dumps(head | {"features": features[30:]}, indent=2, ensure_ascii=False), "none": json.dumps(head | {"features": []})}
    for name, text in docs.items():
        spark.createDataFrame([(text,)], "v string").coalesce(1).write.text(f"{folder}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert size == "1m" or spark.read.text(f"{folder}/one").rdd.getNumPartitions() > 10
        got = {r.name: r.geo for r in collections.collection_features(spark, f"{folder}/*").select(
            F.col("feature.properties")["name"].alias("name"), F.col("feature.geometry.coordinates").alias("geo")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f["properties"]["name"]: f["geometry"] and json.dumps(f["geometry"]["coordinates"], separators=(",", ":")) for f in features}
    assert collections.collection_features(spark, f"{folder}/none").count() == 0


def test_listing_texts_are_searched_once_per_label(spark):
    df = spark.range(4).selectExpr("concat('السعر: ', id + 1, ' مليون\nمساحة العقار: 100') AS d")
    out = text.parse_listing_text(df, "d")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    column = re.escape(df._jdf.queryExecution().optimizedPlan().output().head().toString())
    assert len(re.findall(rf"regexp_extract\({column},", plan)) == len(text.LISTING_LABELS)
    assert [(r.price_sar, r.area_sqm, r.city) for r in out.orderBy("price_sar").collect()] == [((i + 1) * 1e6, 100.0, None) for i in range(4)]


def test_training_rows_are_dealt_to_all_tasks(spark):
    one_file = spark.range(200_000).coalesce(1)
    rows = model.spread(one_file)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes) and sum(sizes) == 200_000
    rows.unpersist()
    assert model.side_by_side([lambda i=i: i * i for i in range(7)]) == [i * i for i in range(7)]
