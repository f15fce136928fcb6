"""Base learners, out-of-fold stacking, ridge blending, segment models and drivers, on Spark ML."""

from __future__ import annotations

import json
from functools import partial
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import one_row
from . import trees
from .evaluate import blend_segment
from .ranking import top_per_key


# column that keeps rows out of the boosted learners' fits, to stop them early
STOP_ROWS = "stop_rows"

# jobs that share the cluster; a job that grows trees keeps its own binned rows
FITS_AT_ONCE = 3


def default_learners(label: str = "label", seed: int = 42, size: int = 20, early_stop: bool = False) -> dict:
    """Four differently shaped learners for the stack; ``size`` scales the number of trees.

    With ``early_stop`` boosting ends when the rows marked in ``STOP_ROWS`` gain no more from it.
    """
    common = {"featuresCol": "features", "labelCol": label}
    boosted = common | ({"validationIndicatorCol": STOP_ROWS, "validationTol": 0.001} if early_stop else {})
    return {
        "gbt_deep": GBTRegressor(maxIter=size, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=seed, **boosted),
        "gbt_flat": GBTRegressor(maxIter=size * 2, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed + 1, **boosted),
        "forest": RandomForestRegressor(numTrees=size * 2, maxDepth=8, seed=seed, **common),
        "linear": LinearRegression(regParam=0.01, **common),
    }


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def spread(rows: DataFrame, per_task: int = 50_000) -> DataFrame:
    """Training rows dealt evenly to tasks, to all cores where there are enough, and kept: a fit passes over them hundreds of times,
    however few files hold them."""
    tasks = min(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // per_task + 1)
    return rows.repartition(tasks).persist()


def side_by_side(jobs: list) -> list:
    """Results of the jobs, a few of which run at once: the passes of one fill the pauses of the others."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(lambda job: job()), jobs, chunksize=1)


def fit_together(work: DataFrame, fits: list[tuple[Column | None, object]]) -> list:
    """A model for each (rows it is fitted on, None for all; learner): trees of all fits grow in the same passes, others are fitted beside."""
    grown = [i for i, (_, learner) in enumerate(fits) if trees.grows(learner)]
    others = [i for i in range(len(fits)) if i not in grown]
    jobs = [partial(trees.fit_trees, work, [fits[i] for i in grown])] if grown else []
    jobs += [partial(fits[i][1].fit, work if fits[i][0] is None else work.filter(fits[i][0])) for i in others]
    done = side_by_side(jobs)
    found = dict(zip(others, done[len(done) - len(others):])) | (dict(zip(grown, done[0])) if grown else {})
    return [found[i] for i in range(len(fits))]


def _score(model, df: DataFrame, name: str) -> DataFrame:
    return model.setPredictionCol(name).transform(df)


def fit_base(work: DataFrame, learners: dict) -> dict:
    """Fit every learner on all rows of an assembled table."""
    return dict(zip(learners, fit_together(work, [(None, learner) for learner in learners.values()])))


def predict_base(df: DataFrame, models: dict) -> DataFrame:
    for name, model in models.items():
        df = _score(model, df, name)
    return df


def out_of_fold(work: DataFrame, fold: str, k: int, learners: dict) -> DataFrame:
    """Each row predicted by models that never saw its fold (k fits per learner; k is a small parameter)."""
    fits = [(F.col(fold) != f, learner) for f in range(k) for learner in learners.values()]
    fitted, parts = iter(fit_together(work, fits)), None
    for f in range(k):
        part = predict_base(work.filter(F.col(fold) == f), {name: next(fitted) for name in learners})
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fit_ridge(df: DataFrame, inputs: list[str], target: str, alpha: float = 1.0, nonneg: bool = False) -> dict:
    """Ridge weights with a free intercept, from two passes: means, then centred cross products.

    With ``nonneg`` the best non-negative solution is found over all active sets (the blend has a handful of inputs).
    """
    cols = [*inputs, target]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = {c: F.col(c) - F.lit(means[i]) for i, c in enumerate(cols)}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.sum(centred[a] * centred[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    s = {p: row[i] for i, p in enumerate(pairs)}
    gram = np.array([[s.get((a, b), s.get((b, a))) for b in inputs] for a in inputs], dtype=float)
    rhs = np.array([s[(a, target)] for a in inputs], dtype=float)
    full = gram + alpha * np.eye(len(inputs))
    weights = np.linalg.solve(full, rhs)
    if nonneg and (weights < 0).any():
        best = (0.0, np.zeros(len(inputs)))
        for size in range(1, len(inputs) + 1):
            for active in combinations(range(len(inputs)), size):
                ix = np.array(active)
                w = np.linalg.solve(full[np.ix_(ix, ix)], rhs[ix])
                cost = w @ full[np.ix_(ix, ix)] @ w - 2 * w @ rhs[ix]
                if (w >= 0).all() and cost < best[0]:
                    full_w = np.zeros(len(inputs))
                    full_w[ix] = w
                    best = (cost, full_w)
        weights = best[1]
    intercept = means[-1] - float(np.dot(weights, means[:-1]))
    return {"intercept": intercept, "weights": dict(zip(inputs, map(float, weights)))}


def apply_linear(df: DataFrame, fitted: dict, out: str) -> DataFrame:
    total = sum((F.col(c) * F.lit(w) for c, w in fitted["weights"].items()), F.lit(fitted["intercept"]))
    return df.withColumn(out, total)


def tree_metas(oof: DataFrame, inputs: list[str], target: str, rows: list[Column | None], seed: int = 42) -> list:
    """Small boosted-tree blends on the out-of-fold predictions, one for each choice of rows; returns the fitted models."""
    a = VectorAssembler(inputCols=inputs, outputCol="stack_features").transform(oof)
    learner = GBTRegressor(featuresCol="stack_features", labelCol=target, predictionCol="_log", maxIter=20, maxDepth=3, seed=seed)
    return fit_together(a, [(where, learner) for where in rows])


def tree_meta(oof: DataFrame, inputs: list[str], target: str, seed: int = 42):
    """A small boosted-tree blend on the out-of-fold predictions; returns the fitted model."""
    return tree_metas(oof, inputs, target, [None], seed)[0]


def apply_meta(df: DataFrame, kind: str, meta, inputs: list[str]) -> DataFrame:
    """Column ``_log``: the blend of the base predictions."""
    if kind == "ridge":
        return apply_linear(df, meta, "_log")
    return meta.transform(VectorAssembler(inputCols=inputs, outputCol="stack_features").transform(df)).drop("stack_features")


def meta_errors(oof: DataFrame, fold: str, k: int, inputs: list[str], target: str, alpha: float, nonneg: bool) -> dict[str, float]:
    """Mean squared error of either blend on folds it was not fitted on."""
    rest = [F.col(fold) != f for f in range(k)]
    ridges = [partial(fit_ridge, oof.filter(others), inputs, target, alpha, nonneg) for others in rest]
    blends, *ridges = side_by_side([partial(tree_metas, oof, inputs, target, rest), *ridges])
    parts = None
    for f in range(k):
        part = oof.filter(F.col(fold) == f)
        ridge = apply_linear(part, ridges[f], "ridge")
        both = apply_meta(ridge, "tree", blends[f], inputs).withColumnRenamed("_log", "tree").select(target, "ridge", "tree")
        parts = both if parts is None else parts.unionByName(both)
    row = parts.agg(*[F.avg(F.pow(F.col(c) - F.col(target), 2)).alias(c) for c in ("ridge", "tree")]).first()
    return row.asDict()


def stack(work: DataFrame, features: list[str], target: str, fold: str, k: int, learners: dict | None = None,
          nonneg: bool = True, alpha: float = 1.0, segment: tuple[Column, float] | None = None, min_rows: int = 200) -> dict:
    """Out-of-fold stack on log1p(target): base models refitted on all work rows and the better of two blends.

    A tenth of the rows, by a hash of their values, stops the boosted learners early (default learners only). The ridge and
    the tree blend are compared by their error on folds they have not seen; ties go to the ridge. ``segment``: (rows, cut) of
    a model of its own that takes over from ``cut`` to twice the cut, if the segment has ``min_rows`` rows.
    """
    stop = F.pmod(F.xxhash64(*features, target), F.lit(10)) == 0
    data = spread(assemble(work.withColumn("label", F.log1p(target)).withColumn(STOP_ROWS, stop), features).select("features", "label", fold, STOP_ROWS))
    learners = learners or default_learners(early_stop=True)
    names = list(learners)

    def blend() -> dict:
        oof = out_of_fold(data, fold, k, learners).select("label", fold, *names).cache()
        errors = meta_errors(oof, fold, k, names, "label", alpha, nonneg)
        kind = "ridge" if errors["ridge"] <= errors["tree"] else "tree"
        meta = fit_ridge(oof, names, "label", alpha, nonneg) if kind == "ridge" else tree_meta(oof, names, "label")
        oof.unpersist()
        return {"kind": kind, "meta": meta, "errors": errors}

    blended, models, special = side_by_side([blend, partial(fit_base, data, learners), lambda: segment and fit_segment_model(work, features, target, segment[0], min_rows)])
    data.unpersist()
    return {"features": features, "models": models, "names": names, "segment": special, "cut": segment and segment[1]} | blended


def predict_stack(df: DataFrame, fitted: dict, out: str = "predicted") -> DataFrame:
    scored = predict_base(assemble(df, fitted["features"]), fitted["models"])
    scored = apply_meta(scored, fitted["kind"], fitted["meta"], fitted["names"]).withColumn(out, F.expm1("_log"))
    if fitted["segment"] is not None:
        scored = blend_segment(_score(fitted["segment"], scored, "_seg").withColumn("_seg", F.expm1("_seg")), out, "_seg", fitted["cut"], out).drop("_seg")
    return scored.drop("_log", "features", *fitted["names"])


MODEL_KINDS = {m.__name__: m for m in (GBTRegressionModel, RandomForestRegressionModel, LinearRegressionModel)}


def save_stack(spark, fitted: dict, folder: str) -> None:
    """All fitted models and, as one JSON line, what else a prediction needs; the folder must be new."""
    models = dict(fitted["models"])
    if fitted["kind"] == "tree":
        models["_meta"] = fitted["meta"]
    if fitted["segment"] is not None:
        models["_segment"] = fitted["segment"]
    for name, fit in models.items():
        fit.write().save(f"{folder}/models/{name}")
    about = {k: fitted[k] for k in ("features", "kind", "names", "errors", "cut")} | {
        "ridge": fitted["meta"] if fitted["kind"] == "ridge" else None, "kinds": {n: type(m).__name__ for n, m in models.items()}}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")


def load_stack(spark, folder: str) -> dict:
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    models = {n: MODEL_KINDS[kind].load(f"{folder}/models/{n}") for n, kind in about.pop("kinds").items()}
    ridge = about.pop("ridge")
    return about | {"meta": models.pop("_meta", ridge), "segment": models.pop("_segment", None), "models": models}


def fit_segment_model(work: DataFrame, features: list[str], target: str, where: Column, min_rows: int = 200, size: int = 20):
    """A model for one segment (e.g. luxury sales), or None when the segment has less than ``min_rows`` rows."""
    rows = spread(assemble(work.filter(where).withColumn("label", F.log1p(target)), features).select("features", "label"))
    try:
        return fit_together(rows, [(None, default_learners(size=size)["gbt_deep"])])[0] if rows.count() >= min_rows else None
    finally:
        rows.unpersist()


def importance_table(spark, model, names: list[str], categories: dict[str, str], n: int = 20) -> DataFrame:
    """Impurity importances scaled to a maximum of 100, with the feature's category."""
    raw = model.featureImportances.toArray()
    top = max(float(raw.max()), 1e-12)
    rows = [(f, float(v) / top * 100, categories.get(f, "Other")) for f, v in zip(names, raw)]
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double, category string")


def ablation_impacts(df: DataFrame, ids: list[str], features: list[str], medians: DataFrame, predict, labels: dict[str, str] | None = None) -> DataFrame:
    """(ids, feature, value, impact): change of the log prediction when a feature is set to its training median.

    ``predict`` maps a table to the same table with ``log_prediction``; it is called once on a table holding each row
    and its ablated variants.
    """
    m = one_row(medians)
    variants = F.array(F.struct(F.lit(None).cast("string").alias("ablated"), *[F.col(f).cast("double").alias(f) for f in features]), *[
        F.struct(F.lit(g).alias("ablated"), *[(m[f] if f == g else F.col(f)).cast("double").alias(f) for f in features])
        for g in features])
    wide = df.select(*ids, *features, F.explode(variants).alias("v")).select(*ids, "v.*")
    # only ids, the feature's name and the prediction are shuffled; values come from the row itself
    scored = predict(wide).select(*ids, "ablated", "log_prediction")
    base = F.max(F.when(F.col("ablated").isNull(), F.col("log_prediction")))
    per_row = scored.groupBy(*ids).agg(base.alias("_base"), F.map_from_entries(F.collect_list(F.when(F.col("ablated").isNotNull(), F.struct("ablated", "log_prediction")))).alias("_ab"))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                                 (F.col("_base") - F.col("_ab")[f]).alias("impact"),
                                 F.lit((labels or {}).get(f, f.replace("_", " ").title())).alias("description")) for f in features])
    return df.select(*ids, *features).join(per_row, ids).select(*ids, F.explode(entries).alias("d")).select(*ids, "d.*")


def top_drivers(impacts: DataFrame, ids: list[str], k: int = 10) -> DataFrame:
    """The k strongest features per row, with direction."""
    ranked = top_per_key(impacts, ids, [F.desc(F.abs("impact")), "feature"], k, rank="rank")
    return ranked.withColumn("direction", F.when(F.col("impact") > 0, "positive").otherwise("negative"))


def waterfall(drivers: DataFrame, ids: list[str]) -> DataFrame:
    """Running total of impacts in rank order."""
    upto = Window.partitionBy(*ids).orderBy("rank")
    return drivers.withColumn("total_after", F.sum("impact").over(upto)).withColumn("total_before", F.col("total_after") - F.col("impact"))
