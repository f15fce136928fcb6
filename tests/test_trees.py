"""Trees grown together against Spark ML's own fits."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from hectare.operators import model, trees


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    made = [(i, float(r.randrange(25)), float(r.randrange(7)), r.choice([0.0, 1.5]), r.randrange(3)) for i in range(3000)]
    made = [(*m, 3 * m[1] + (m[2] - 3) ** 2 * (1 + m[3]) + r.gauss(0, 2), r.random() < 0.2) for m in made]
    df = spark.createDataFrame(made, "id int, a double, b double, c double, fold int, label double, stop boolean").repartition(5)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()


def shape(fitted):
    """Every node of every tree: depth first, with split, prediction and rows."""
    def walk(node):
        own = (round(node.prediction(), 6) + 0.0, int(node.impurityStats().count()))
        if node.subtreeDepth() == 0:
            return [own]
        split = node.split()
        return [(*own, split.featureIndex(), split.threshold(), round(node.gain(), 5), round(node.impurity(), 5)), *walk(node.leftChild()), *walk(node.rightChild())]

    return [walk(tree._call_java("rootNode")) for tree in fitted.trees], [round(w, 9) for w in fitted.treeWeights]


# without random draws and with all values as splits, both must grow the same trees
@pytest.mark.parametrize("make", [
    lambda: GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.1, seed=1),
    lambda: GBTRegressor(maxIter=30, maxDepth=4, stepSize=0.5, seed=2, validationIndicatorCol="stop", validationTol=0.01),
    lambda: GBTRegressor(maxIter=3, maxDepth=2, seed=1, minInstancesPerNode=400, minInfoGain=0.5),
    lambda: RandomForestRegressor(numTrees=2, maxDepth=9, bootstrap=False, featureSubsetStrategy="all", seed=5),
    lambda: RandomForestRegressor(numTrees=1, maxDepth=1, bootstrap=False, seed=5),
])
def test_equals_spark_ml(rows, make, tmp_path):
    learner = make()
    where = F.col("fold") != 1
    got, all_of_it = trees.fit_trees(rows, [(where, learner), (None, learner)])
    for fitted, part in ((got, rows.filter(where)), (all_of_it, rows)):
        own = learner.fit(part)
        assert shape(fitted) == shape(own)
        assert fitted.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=1e-9)
        assert {p.name: v for p, v in fitted.extractParamMap().items() if learner.isSet(p.name)} == {p.name: v for p, v in learner._paramMap.items()}
    got.write().save(f"{tmp_path}/m")
    again = type(got).load(f"{tmp_path}/m")
    assert shape(again) == shape(got) and again.transform(rows).select("prediction").collect() == got.transform(rows).select("prediction").collect()


def test_random_draws(rows):
    """Bags and subsets differ from Spark's, their errors hardly do; a fit gives the same trees again."""
    learners = [GBTRegressor(maxIter=20, maxDepth=4, subsamplingRate=0.8, seed=3), RandomForestRegressor(numTrees=30, maxDepth=6, featureSubsetStrategy="2", seed=4)]
    got, again = (trees.fit_trees(rows, [(None, x) for x in learners]) for _ in range(2))
    mse = lambda m: m.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    for mine, twice, learner in zip(got, again, learners):
        assert shape(mine) == shape(twice) and mse(mine) == pytest.approx(mse(learner.fit(rows)), rel=0.25)
    bags = {tree[0][1] for tree in shape(got[1])[0]}
    assert len(bags) > 20 and all(2700 < n < 3300 for n in bags)
    assert all(2300 < tree[0][1] < 2500 for tree in shape(got[0])[0])


def test_odd_rows(spark, rows):
    learner = GBTRegressor(maxIter=2, maxDepth=2, seed=1)
    with pytest.raises(ValueError):
        trees.fit_trees(rows, [(F.col("fold") > 7, learner)])
    with pytest.raises(Exception, match="null or NaN"):
        trees.fit_trees(rows.withColumn("label", F.when(F.col("id") > 0, F.col("label"))), [(None, learner)])
    one = rows.withColumn("label", F.lit(2.5))
    fitted, = trees.fit_trees(one, [(None, learner)])
    assert {r.prediction for r in fitted.transform(one).select("prediction").collect()} == {2.5} and fitted.trees[0].numNodes == 1
    wide = spark.range(40_000).select(F.rand(1).alias("a")).withColumn("label", F.col("a") * 10)
    fitted, = trees.fit_trees(VectorAssembler(inputCols=["a"], outputCol="features").transform(wide), [(None, GBTRegressor(maxIter=1, maxDepth=5, seed=1))])
    cuts = sorted(n[3] for n in shape(fitted)[0][0] if len(n) > 2)
    assert len(cuts) == 31 and all(abs(c - (i + 1) / 32) < 0.03 for i, c in enumerate(cuts))


def test_fits_share_their_passes(spark, rows):
    """A stack's fits grow in the same passes: their number does not grow with the folds and learners."""
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    learners = {"deep": GBTRegressor(maxIter=4, maxDepth=3, seed=1), "flat": GBTRegressor(maxIter=6, maxDepth=2, seed=1),
                "forest": RandomForestRegressor(numTrees=8, maxDepth=3, seed=1), "linear": LinearRegression(regParam=0.01)}
    before = jobs()
    out = model.out_of_fold(rows, "fold", 3, learners)
    spent = jobs() - before
    assert out.count() == 3000 and {"deep", "flat", "forest", "linear"} <= set(out.columns)
    assert spent < 12 * 9 + 40  # 12 passes, 9 models written and loaded
