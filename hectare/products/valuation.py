"""Batch valuation of property tables, comparables and overlays.

A context holds what valuation needs, fitted once on past sales; valuing is then joins and expressions over the subject
table, of any size. The predictor is a function table → table with ``log_prediction`` (a fitted stack, or a formula).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import unit_rates
from ..functions.text import map_type
from ..operators import encode, evaluate, spatial
from ..operators.clean import validate_batch
from ..operators.joins import lookup_chain
from ..operators.quantiles import group_agg, join_groups, quantile_sets
from ..operators.ranking import latest_n
from ..session import stored

Predict = Callable[[DataFrame], DataFrame]


def comparables_report(subjects: DataFrame, sales: DataFrame, subject_id: str, value: str, price: str, sale_id: str = "id",
                       radius_m: float = 800, limit: int = 8) -> DataFrame:
    """Per subject: number, median and range of its comparables, the value's distance from their median in percent and
    its position on their range (0 … 1)."""
    # read by every part of the aggregation
    comps, _ = stored(spatial.comparables(subjects, sales, radius_m, limit, [price], p_id=sale_id, keep=[subject_id, value]), "comparables")
    s = group_agg(comps, [subject_id, value], [
        F.count(F.lit(1)).alias("n_comps"), F.min(price).alias("comp_min"), F.max(price).alias("comp_max")], {"comp_median": (price, 0.5)})
    span = F.col("comp_max") - F.col("comp_min")
    place = F.when(span == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("comp_min")) / span)))
    return s.withColumns({"delta_pct": (F.col(value) / F.col("comp_median") - 1) * 100, "position": place}).drop(value)


def asking_overlay(df: DataFrame, spreads: DataFrame, key: str, unit_price: str, area: Column, overall_pct: Column | float) -> DataFrame:
    """Asking price per m² and in total: the key's asking median, else the unit price lifted by the overall spread."""
    s = spreads.select(key, F.col("asking_median").alias("_ask"), F.col("spread_pct").alias("_pct"))
    lift = overall_pct if isinstance(overall_pct, Column) else F.lit(float(overall_pct))
    out = join_groups(df, s, [key])
    psqm = F.coalesce(F.col("_ask"), F.col(unit_price) * (1 + lift / 100))
    return out.withColumns({
        "asking_psqm": F.bround(psqm).cast("bigint"),
        "asking_total": F.bround(psqm * area).cast("bigint"),
        "asking_spread_pct": F.bround(F.when(F.col("_ask").isNotNull(), F.col("_pct")).otherwise(lift), 1),
    }).drop("_ask", "_pct")


@dataclass
class CityContext:
    """Fitted for city valuation: the stored feature steps, error and asking tables."""

    features: PipelineModel
    errors: DataFrame
    spreads: DataFrame
    spread_pct: Column | float


def value_nyc(subjects: DataFrame, ctx: CityContext, rules: dict[str, Column], predict: Predict | None = None) -> DataFrame:
    """Value a table of subjects (id, lat, lon, borough, kind, area): features, prediction, interval, flags, asking price.

    The prediction is that of the pipeline's own last step (``log_prediction``), or of ``predict`` on the pipeline's features. Invalid
    rows are returned with their errors and no value.
    """
    ok, bad = validate_batch(subjects, rules)
    made = ctx.features.transform(ok)
    priced = (made if predict is None else predict(made)).withColumn("predicted", F.expm1("log_prediction"))
    priced = priced.select(*ok.columns, "region", "comps", "predicted")
    out = evaluate.confidence(priced, "predicted", "borough", ctx.errors)
    out = evaluate.qc_flags(out, "comps", "predicted", "segment_medape", "borough")
    out = unit_rates(out.withColumn("predicted", F.bround("predicted").cast("bigint")), "predicted", "area")
    out = asking_overlay(out, ctx.spreads, "borough", "price_per_sqm", F.col("area") * 0.0929, ctx.spread_pct)
    return out.unionByName(bad, allowMissingColumns=True)


@dataclass
class DistrictContext:
    """Fitted tables for district valuation; centroids are (district, lat, lon)."""

    centroids: DataFrame
    lags: DataFrame
    type_lags: DataFrame
    city_type: DataFrame
    city_lag: Column
    type_index: DataFrame
    latest_index: DataFrame
    errors: DataFrame
    overall_error: Column | float
    spreads: DataFrame
    spread_pct: Column | float
    types: list[tuple[str, str]]
    features: DistrictFeatures | None = None


@dataclass
class DistrictFeatures:
    """What ``district_features`` needs beside the subjects: baseline columns per district and the deals that encodings are taken from."""

    baseline: DataFrame
    columns: list[str]
    work: DataFrame
    kinds: dict[str, str]
    main_kind: str
    recent_from: int


def fit_districts(work: DataFrame, centroids: DataFrame, index: DataFrame, errors: DataFrame, overall_error, spreads: DataFrame,
                  spread_pct, types: list[tuple[str, str]], features: DistrictFeatures | None = None) -> DistrictContext:
    """Fit the look-ups on the work panel rows (district, kind, qid, psqm); ``index`` is (qid, kind, type_index)."""
    sets = {"cells": ["district", "qid"], "typed": ["district", "kind", "qid"], "city": ["kind"], "all": []}
    mid = quantile_sets(work, sets, "psqm", {"m": 0.5})
    typed = mid["typed"].withColumn("_key", F.struct("district", "kind"))
    type_lags = latest_n(typed, "_key", "qid", "m", 2).select("_key.*", F.col("lag1").alias("type_lag1"), F.col("lag2").alias("type_lag2"))
    newest = index.groupBy("kind").agg(F.max_by("type_index", "qid").alias("type_index"))
    return DistrictContext(centroids, latest_n(mid["cells"], "district", "qid", "m", 2, require_all=True), type_lags, mid["city"].withColumnRenamed("m", "city_type"),
                           mid["all"].scalar(), index, newest, errors, overall_error, spreads, spread_pct, types, features)


def district_features(subjects: DataFrame, centroids: DataFrame, baseline: DataFrame, live: DataFrame, columns: list[str], work: DataFrame,
                      kinds: dict[str, str], main_kind: str, recent_from: int) -> DataFrame:
    """The model's columns for a table of subjects (id, lat, lon, kind, quarter).

    A subject takes the columns of the nearest district (``baseline``: district and ``columns``); what was looked up at its own
    point (``live``: id and ``columns``) wins wherever it is not null. Encodings are means of the log unit price by district, by
    district and type, by district since ``recent_from``, and the same two for ``main_kind`` alone; a district without such
    deals takes the mean over all. ``work``: district, kind, qid, psqm.
    """
    out = spatial.nearest_attrs(subjects, centroids, ["district"], "centroid_m", p_id="district")
    base = baseline.select("district", *[F.col(c).alias(f"_b_{c}") for c in columns])
    own = live.select("id", *[F.col(c).alias(f"_l_{c}") for c in columns])
    out = out.join(base, "district", "left").join(own, "id", "left")
    out = out.withColumns({c: F.coalesce(f"_l_{c}", f"_b_{c}") for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "bl"])
    # one pass over the deals; every encoding is a mean over some of the cells
    cells = work.groupBy("district", "kind", (F.col("qid") >= recent_from).alias("_recent")).agg(F.sum(F.log1p("psqm")).alias("_s"), F.count("psqm").alias("_n"))
    cells, _ = stored(cells, "district-cells")
    recent, main, every = F.col("_recent"), F.col("kind") == main_kind, F.lit(True)
    mean = lambda where: F.sum(F.when(where, F.col("_s"))) / F.nullif(F.sum(F.when(where, F.col("_n"))), F.lit(0))
    rules = {"district_encoded": every, "district_recent_encoded": recent, "district_apt_encoded": main, "district_apt_recent_encoded": main & recent}
    out = out.join(cells.groupBy("district").agg(*[mean(where).alias(name) for name, where in rules.items()]), "district", "left")
    out = out.join(cells.groupBy("district", "kind").agg(mean(every).alias("district_type_encoded")), ["district", "kind"], "left")
    out = out.withColumn("_all", cells.agg(mean(every)).scalar())
    out = out.withColumns({name: F.coalesce(name, "_all") for name in (*rules, "district_type_encoded")}).drop("_all")
    angle = F.col("quarter") * (2 * math.pi / 4)
    return encode.one_hot(out, "kind", kinds).withColumns({"quarter_sin": F.sin(angle), "quarter_cos": F.cos(angle)})


def value_riyadh(subjects: DataFrame, ctx: DistrictContext, predict: Predict, rules: dict[str, Column], last_year: int,
                 live: DataFrame | None = None) -> DataFrame:
    """Value a table of subjects (id, lat, lon, property_type, area, year, quarter) by district, type and period.

    The type name is made canonical first; the year is held at the last trained one. With the context's ``features`` the prediction sees
    encodings, type and season flags and the district's baseline columns too; ``live`` (id and those columns) wins where it is not null.
    """
    ok, bad = validate_batch(subjects, rules)
    named = ok.withColumns({"kind": map_type("property_type", ctx.types, "equals"),
                            "qid": F.least(F.coalesce(F.col("year"), F.lit(last_year)), F.lit(last_year)) * 10 + F.coalesce(F.col("quarter"), F.lit(4))})
    if ctx.features is None:
        placed = spatial.nearest_attrs(named, ctx.centroids, ["district"], "centroid_m", p_id="district")
    else:
        f = ctx.features
        own = f.baseline.select(F.lit(None).cast(named.schema["id"].dataType).alias("id"), *f.columns).limit(0) if live is None else live
        placed = district_features(named, ctx.centroids, f.baseline, own, f.columns, f.work, f.kinds, f.main_kind, f.recent_from)
    known = placed.join(ctx.lags, "district", "left").join(ctx.type_lags, ["district", "kind"], "left").join(ctx.city_type, "kind", "left")
    type1 = F.coalesce("type_lag1", "city_type", ctx.city_lag)
    known = known.withColumns({
        "lag1": F.coalesce("lag1", ctx.city_lag), "lag2": F.coalesce("lag2", ctx.city_lag),
        "type_lag1": type1, "type_lag2": F.coalesce(F.col("type_lag2"), type1)}).withColumn("momentum", F.col("lag1") - F.col("lag2"))
    known = lookup_chain(known, [(ctx.type_index, ["qid", "kind"], "type_index"), (ctx.latest_index, ["kind"], "type_index")], "type_index", 100.0)
    priced = predict(known).withColumn("price_sqm", F.bround(F.expm1("log_prediction")).cast("bigint"))
    priced = priced.select(*named.columns, "district", "centroid_m", "price_sqm")
    overall = ctx.overall_error if isinstance(ctx.overall_error, Column) else F.lit(float(ctx.overall_error))
    out = evaluate.attach_error(priced, ctx.errors, "district", overall)
    out = evaluate.clamp_interval(out, "price_sqm", F.col("district_medape"))
    out = out.withColumn("total", F.bround(F.col("price_sqm") * F.col("area")).cast("bigint"))
    out = asking_overlay(out, ctx.spreads, "district", "price_sqm", F.col("area"), ctx.spread_pct)
    helpers = ["kind", "qid", "district_medape"]
    return out.drop(*helpers).unionByName(bad, allowMissingColumns=True)


def compare_pairs(pairs: DataFrame, values: DataFrame, id_col: str, value: str, same_pct: float = 2.0) -> DataFrame:
    """Two valuations side by side: difference, percent of the smaller, and which is higher ('equal' within 2 % of A)."""
    a = values.select(F.col(id_col).alias("id_a"), F.col(value).alias("value_a"))
    b = values.select(F.col(id_col).alias("id_b"), F.col(value).alias("value_b"))
    out = pairs.join(a, "id_a").join(b, "id_b")
    diff = F.col("value_b") - F.col("value_a")
    verdict = F.when(F.abs(diff) / F.col("value_a") * 100 < same_pct, "equal").when(diff > 0, "b").otherwise("a")
    return out.withColumns({"diff": diff, "diff_pct": F.abs(diff) / F.least("value_a", "value_b") * 100, "higher": verdict})
