"""Boosted trees and forests of Spark ML, many fits at once.

The rows of all fits are binned to bytes and kept as blocks; one pass over the blocks serves one level of the growing trees of every fit.
Rules are those of Spark ML's own fits (splits from a sample, variance gain, squared loss, subsampling per tree, early stop), and what is
returned are Spark ML's models.
"""

from __future__ import annotations

import json
import math
import pickle
import time
import uuid
from collections import namedtuple
from functools import cache, partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable, scratch_path

BLOCK = 1 << 18  # rows of a block: masks of one byte a row stay in the core's cache
PAIRED = 64  # two features with at most that many bins are counted in one go
COLLECTED = 32  # partial sums of more tasks than these are merged in two steps
EPSILON = float(np.finfo(float).eps)

# rows of the same views: their bytes per view and, per boosted fit, the sums of the trees so far
Block = namedtuple("Block", "key views stop label bins sums")


def grows(learner) -> bool:
    """Can the learner be fitted here?"""
    if not isinstance(learner, (GBTRegressor, RandomForestRegressor)):
        return False
    get = learner.getOrDefault
    plain = not learner.isSet("weightCol") and get("minWeightFractionPerNode") == 0 and get("impurity") == "variance" and get("maxBins") <= 256
    return plain and (get("lossType") == "squared" if isinstance(learner, GBTRegressor) else True)


def fit_trees(rows: DataFrame, fits: list[tuple[Column | None, object]]) -> list:
    """A model for each (rows it is fitted on, learner); None stands for all rows. The learners share the columns of features and label."""
    importable(rows.sparkSession)
    keys = [str(where) for where, _ in fits]
    views = list(dict.fromkeys(keys))
    chosen = {key: where for key, (where, _) in zip(keys, fits)}
    learners = [learner for _, learner in fits]
    get = learners[0].getOrDefault
    if len({(x.getOrDefault("featuresCol"), x.getOrDefault("labelCol")) for x in learners}) > 1 or len({s for x in learners if (s := _stop_column(x))}) > 1:
        raise ValueError("learners fitted together share their columns")
    stop = next((s for s in map(_stop_column, learners) if s), None)
    code = sum(((F.lit(1).cast("bigint") if chosen[v] is None else F.coalesce(chosen[v], F.lit(False)).cast("bigint")) * F.lit(1 << i) for i, v in enumerate(views)), F.lit(0).cast("bigint"))
    label = F.col(get("labelCol")).cast("double")
    label = F.when(label.isNull() | F.isnan(label), F.raise_error(F.lit("labels must not be null or NaN")).cast("double")).otherwise(label)
    table = rows.select(code.alias("code"), (F.col(stop).cast("boolean") if stop else F.lit(False)).alias("stop"), label.alias("label"), vector_to_array(get("featuresCol")).alias("x"))
    table = table.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # a pass has few tasks
    counts = [[0, 0] for _ in views]
    for r in table.groupBy("code", "stop").count().collect():
        for v, n in enumerate(counts):
            n[bool(r["stop"])] += r["count"] * (r["code"] >> v & 1)
    # fits on the same rows with as many bins share them; rows that stop one of them have no part in its splits
    stopped = [any(_stop_column(x) for x, key in zip(learners, keys) if key == v) for v in views]
    made = []
    for key, learner in zip(keys, learners):
        v = views.index(key)
        n = counts[v][0] + (0 if stopped[v] else counts[v][1])
        if n == 0:
            raise ValueError("a learner has no rows")
        made.append((v, stopped[v], n, min(learner.getOrDefault("maxBins"), n)))
    shared = list(dict.fromkeys(made))
    at = [shared.index(m) for m in made]
    splits = _find_splits(table, shared, get("seed"))
    growing = {i: (_Boost if isinstance(x, GBTRegressor) else _Forest)(x, at[i], bool(_stop_column(x)), splits[at[i]]) for i, x in enumerate(learners)}
    passes = max((g.passes for g in growing.values() if isinstance(g, _Boost)), default=0)
    for g in growing.values():
        g.spread_over(passes)
    made_of = partial(_blocks, splits=splits, members=[m[0] for m in shared])
    blocks = table.mapInArrow(made_of, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    _grow(blocks, growing).unpersist()
    with ThreadPool(4) as pool:
        return pool.map(inheritable_thread_target(lambda i: _model(rows.sparkSession, learners[i], growing[i], splits[at[i]])), range(len(fits)), chunksize=1)


def _stop_column(learner) -> str | None:
    return learner.getOrDefault("validationIndicatorCol") if learner.hasParam("validationIndicatorCol") and learner.isDefined("validationIndicatorCol") else None


# ---- splits and blocks ----


def _find_splits(table: DataFrame, shared: list[tuple], seed: int) -> list[list[np.ndarray]]:
    """Thresholds per view and feature, from a sample of its training rows of the size Spark ML takes."""
    def sample(batches):
        r = np.random.default_rng([seed & 0xFFFFFFFF, _partition()])
        for batch in batches:
            code, stop, _, x = _arrays(batch)
            draw = r.random(len(code), dtype=np.float32)
            for i, (v, stops, n, bins) in enumerate(shared):
                take = (code >> v & 1).astype(bool) & (draw < max(bins * bins, 10_000) / n)
                if stops:
                    take &= ~stop
                if take.any():
                    yield pa.RecordBatch.from_pydict({"view": pa.array([i], pa.int32()), "x": pa.array([x[take].tobytes()], pa.binary())})

    found = [[] for _ in shared]
    for r in table.mapInArrow(sample, "view int, x binary").collect():
        found[r["view"]].append(np.frombuffer(r["x"]))
    width = len(table.select("x").first()["x"])
    out = []
    for parts, (_, _, _, bins) in zip(found, shared):
        x = np.concatenate(parts).reshape(-1, width) if parts else np.empty((0, width))
        out.append([_thresholds(x[:, f], bins - 1) for f in range(width)])
    return out


def _thresholds(sample: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between values: all of them, or those next to equal shares of the rows."""
    values, n = np.unique(sample, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    step, upto = len(sample) / (most + 1), np.cumsum(n)
    target, taken = step, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            taken.append(i - 1)
            target += step
    return middle[taken]


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _arrays(batch: pa.RecordBatch):
    code, stop, label, x = (batch.column(i) for i in range(4))
    return (code.to_numpy(zero_copy_only=False), stop.to_numpy(zero_copy_only=False).astype(bool), label.to_numpy(zero_copy_only=False),
            x.flatten().to_numpy(zero_copy_only=False).reshape(len(code), -1))


def _blocks(batches, splits: list[list[np.ndarray]], members: list[int]):
    """Rows by their memberships, binned per view, as pickled blocks."""
    part, made, waiting = _partition(), 0, {}

    def block(key, pieces):
        code, stop = key
        y, x = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        views = [i for i, v in enumerate(members) if code >> v & 1]
        bins = {i: np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(splits[i])]).astype(np.uint8) for i in views}
        data = pickle.dumps(Block((part, made), views, stop, y, bins, {}), protocol=5)
        return pa.RecordBatch.from_pydict({"block": pa.array([data], pa.binary())})

    for batch in batches:
        code, stop, y, x = _arrays(batch)
        both = code * 2 + stop
        for c in np.unique(both):
            key, rows = (int(c) >> 1, bool(c & 1)), both == c
            if key[0]:
                waiting.setdefault(key, []).append((y[rows], x[rows]))
                if sum(len(p[0]) for p in waiting[key]) >= BLOCK:
                    yield block(key, waiting.pop(key))
                    made += 1
    for key, pieces in waiting.items():
        yield block(key, pieces)
        made += 1


# ---- one pass, in the tasks ----


def _codes(bins: np.ndarray, split: dict[int, tuple[int, int]], nodes: list[int], start: np.ndarray) -> np.ndarray:
    """1, 2, … for rows of ``start`` in the first, second, … of the nodes, else 0. Nodes are numbered as in a heap."""
    at, out = {h: i + 1 for i, h in enumerate(nodes)}, np.zeros(len(start), np.uint8 if len(nodes) < 256 else np.int32)
    todo = [(0, start)]
    while todo:
        h, mask = todo.pop()
        if h in at:
            out += mask.view(np.uint8) * out.dtype.type(at[h])
        elif h in split:
            f, b = split[h]
            right = mask & (bins[f] > b)
            todo += [(2 * h + 1, mask ^ right), (2 * h + 2, right)]
    return out


@cache
def _poisson_table(rate: float) -> np.ndarray:
    terms = np.cumsum([math.exp(-rate) * rate ** k / math.factorial(k) for k in range(40)])
    return np.searchsorted(terms, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _bag(n: int, key: tuple[int, int], seed: int, tree: int, rate: float, replace: bool) -> np.ndarray | None:
    """How often each row is taken; None stands for all rows once. The same in every pass of a tree."""
    if not replace and rate >= 1:
        return None
    draw = np.random.default_rng([seed & 0xFFFFFFFF, tree, *key]).integers(0, 1 << 16, n, dtype=np.uint16)
    return _poisson_table(rate)[draw] if replace else draw < rate * (1 << 16)


def _histograms(bins: np.ndarray, code: np.ndarray, k: int, weights: list[np.ndarray | None], out: np.ndarray) -> None:
    """Adds to ``out`` [channel, node, feature, bin] the sums of each weight (None: 1)."""
    d, nb = len(bins), out.shape[3]
    paired = nb <= PAIRED and 2 * (k + 1) * nb * nb <= len(code)
    step = 2 if paired else 1
    base = code.astype(np.intp)
    for f in range(0, d, step):
        two = step == 2 and f + 1 < d
        size = nb * nb if two else nb
        within = bins[f].astype(np.uint16) * np.uint16(nb) + bins[f + 1] if two else bins[f]
        cell = base * size + within
        for c, w in enumerate(weights):
            sums = np.bincount(cell, w, (k + 1) * size)[size:]
            if two:
                sums = sums.reshape(k, nb, nb)
                out[c, :, f] += sums.sum(2)
                out[c, :, f + 1] += sums.sum(1)
            else:
                out[c, :, f] += sums.reshape(k, nb)


def _pass(blocks, plan: dict):
    """Per fit: error sums of its stop rows; per growing tree the histograms of its open nodes and their sums of squares."""
    errors, hists = {}, {}
    for block in blocks:
        n = len(block.label)
        for i, p in plan.items():
            if p["view"] not in block.views:
                continue
            if block.stop and p["stops"]:
                if p["check"]:
                    off = block.sums[i] - block.label
                    errors[i] = errors.get(i, 0) + np.array([(off * off).sum(), n])
                continue
            bins = block.bins[p["view"]]
            target = block.label if i not in block.sums else 2 * (block.label - block.sums[i])
            for t, (split, nodes, feats, squares) in p["trees"].items():
                k = len(nodes)
                bag = _bag(n, block.key, p["seed"], t, p["rate"], p["replace"])
                taken = np.ones(n, bool) if bag is None else bag > 0 if p["replace"] else bag
                code = _codes(bins, split, nodes, taken)
                w = bag.astype(float) if p["replace"] else None
                first = target if w is None else w * target
                second = first * target
                channels = [w, first, *([second] if squares else [])]
                if (i, t) not in hists:
                    hists[i, t] = [np.zeros((len(channels), k, len(bins), p["bins"])), np.zeros(k)]
                _histograms(bins, code, k, channels, hists[i, t][0])
                hists[i, t][1] += np.bincount(code, second, k + 1)[1:]
    for (i, t), (h, _) in hists.items():
        feats = plan[i]["trees"][t][2]
        if feats is not None:  # a forest's nodes see a few features each
            hists[i, t][0] = h[:, np.arange(len(feats))[:, None], feats]
    yield errors, hists


def _merge(a, b):
    for i, e in b[0].items():
        a[0][i] = a[0].get(i, 0) + e
    for key, (h, s) in b[1].items():
        if key in a[1]:
            a[1][key][0] += h
            a[1][key][1] += s
        else:
            a[1][key] = [h, s]
    return a


def _advance(block: Block, done: dict, alive: set[int]) -> Block:
    """The block with the finished trees added to its sums."""
    sums = {i: s for i, s in block.sums.items() if i in alive}
    for i, (view, weight, split, leaves, values) in done.items():
        if view in block.views:
            step = (weight * np.array([0.0, *values]))[_codes(block.bins[view], split, leaves, np.ones(len(block.label), bool))]
            sums[i] = sums[i] + step if i in sums else step
    return block._replace(sums=sums)


def _grow(blocks, growing: dict):
    """Passes until all fits are done; returns the last version of the blocks."""
    parts = blocks.getNumPartitions()
    while alive := {i for i, g in growing.items() if not g.done}:
        done = {i: growing[i].finished for i in alive if growing[i].finished is not None}
        old = None
        if done:
            old, blocks = blocks, blocks.map(partial(_advance, done=done, alive=alive)).persist(StorageLevel.MEMORY_AND_DISK)
        sums = blocks.mapPartitions(partial(_pass, plan={i: growing[i].plan() for i in alive}))
        errors, hists = sums.treeReduce(_merge, 2) if parts > COLLECTED else reduce(_merge, sums.collect())
        if old is not None:
            old.unpersist()
        for i in alive:
            growing[i].take(errors.get(i), {t: h for (j, t), h in hists.items() if j == i})
    return blocks


# ---- growing trees, on the driver ----


class _Tree:
    """A tree grown level by level; nodes are numbered as in a heap."""

    def __init__(self, depth: int, feats):
        self.depth, self.level, self.open, self.split, self.nodes, self.feats = depth, 0, [0], {}, {}, feats
        self.see()

    def see(self) -> None:
        self.seen = None if self.feats is None else np.array([self.feats() for _ in self.open])

    def take(self, hist: np.ndarray, squares: np.ndarray, widths: np.ndarray, least: int, least_gain: float) -> None:
        n, s = hist[0].cumsum(2), hist[1].cumsum(2)
        total, total_s = n[:, 0, -1], s[:, 0, -1]
        rest, rest_s = total[:, None, None] - n, s[:, :, -1:] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (s * s / n + rest_s * rest_s / rest - (total_s * total_s / total)[:, None, None]) / total[:, None, None]
            impurity = (squares - total_s * total_s / total) / total
        seen = np.broadcast_to(np.arange(hist.shape[2]), hist.shape[1:3]) if self.seen is None else self.seen
        fits = (n >= least) & (rest >= least) & (np.arange(hist.shape[3]) < widths[seen][:, :, None])
        gain = np.where(fits & (gain >= least_gain), gain, -np.inf)
        best = gain.reshape(len(gain), -1).argmax(1)
        opened = []
        for k, h in enumerate(self.open):
            j, b = divmod(int(best[k]), hist.shape[3])
            node = {"n": total[k], "s": total_s[k], "q": squares[k], "impurity": impurity[k], "gain": float(gain[k, j, b])}
            self.nodes[h] = node
            if not total[k] or node["gain"] <= 0 or abs(impurity[k]) < EPSILON or self.level == self.depth:
                continue
            self.split[h] = (int(seen[k, j]), b)
            opened += [2 * h + 1, 2 * h + 2]
            if self.level + 1 == self.depth:
                q = hist[2, k, j].cumsum()
                for c, (cn, cs, cq) in ((2 * h + 1, (n[k, j, b], s[k, j, b], q[b])), (2 * h + 2, (rest[k, j, b], rest_s[k, j, b], q[-1] - q[b]))):
                    self.nodes[c] = {"n": cn, "s": cs, "q": cq, "impurity": (cq - cs * cs / cn) / cn, "gain": -1.0}
        self.level += 1
        self.open = [] if self.level == self.depth else opened
        self.see()

    def value(self, h: int) -> float:
        node = self.nodes[h]
        return float(node["s"] / node["n"]) if node["n"] else 0.0

    def leaves(self) -> list[int]:
        return [h for h in self.nodes if h not in self.split]

    def plan(self):
        return self.split, self.open, self.seen, self.level + 1 >= self.depth


class _Fit:
    def __init__(self, learner, view: int, stops: bool, splits: list[np.ndarray]):
        get, self.width = learner.getOrDefault, len(splits)
        self.view, self.stops, self.seed, self.rate = view, stops, get("seed"), get("subsamplingRate")
        self.depth, self.least, self.least_gain = get("maxDepth"), get("minInstancesPerNode"), get("minInfoGain")
        self.widths, self.bins = np.array([len(t) for t in splits]), 1 + max(len(t) for t in splits)
        self.trees, self.now, self.finished, self.done, self.check, self.replace = [], {}, None, False, False, False
        self.some = _subset(get("featureSubsetStrategy"), self.width, self.count(learner))

    def tree(self, t: int) -> _Tree:
        r = np.random.default_rng([self.seed & 0xFFFFFFFF, t])
        return _Tree(self.depth, None if self.some == self.width else lambda: np.sort(r.choice(self.width, self.some, replace=False)))

    def plan(self) -> dict:
        return {"view": self.view, "stops": self.stops, "seed": self.seed, "rate": self.rate, "replace": self.replace, "bins": self.bins,
                "check": self.check, "trees": {t: tree.plan() for t, tree in self.now.items() if tree.open}}

    def took(self, hists: dict) -> None:
        for t, tree in self.now.items():
            if tree.open:
                tree.take(*hists[t], self.widths, self.least, self.least_gain)


class _Boost(_Fit):
    def __init__(self, learner, *about):
        super().__init__(learner, *about)
        self.rounds, self.step, self.tol = learner.getMaxIter(), learner.getStepSize(), learner.getOrDefault("validationTol")
        self.passes, self.best, self.best_error = self.rounds * max(1, self.depth), 0, None
        self.now = {0: self.tree(0)}

    @staticmethod
    def count(learner) -> int:
        return 1

    def spread_over(self, passes: int) -> None:
        """A tree after the other, whatever the others do."""

    def weight(self, t: int) -> float:
        return self.step if t else 1.0

    def take(self, error, hists: dict) -> None:
        if self.check:
            mean = error[0] / error[1] if error is not None else math.nan
            if self.best_error is None:
                self.best, self.best_error = 1, mean
            elif self.best_error - mean < self.tol * max(mean, 0.01):
                self.done = True
            elif mean < self.best_error:
                self.best, self.best_error = len(self.trees), mean
        self.finished, self.check = None, False
        if self.done or not self.now:
            self.done, self.trees = True, self.trees[:self.best] if self.stops else self.trees
            return
        self.took(hists)
        (t, tree), = self.now.items()
        if not tree.open:
            self.trees.append(tree)
            last = t + 1 == self.rounds
            self.now, self.check = {} if last else {t + 1: self.tree(t + 1)}, self.stops
            if last and not self.stops:
                self.done = True
            else:
                leaves = tree.leaves()
                self.finished = (self.view, self.weight(t), tree.split, leaves, [tree.value(h) for h in leaves])


class _Forest(_Fit):
    def __init__(self, learner, *about):
        super().__init__(learner, *about)
        self.rounds, self.replace = learner.getNumTrees(), learner.getOrDefault("bootstrap") and learner.getNumTrees() > 1
        self.at_once = self.rounds

    @staticmethod
    def count(learner) -> int:
        return learner.getNumTrees()

    def spread_over(self, passes: int) -> None:
        """As many trees at a time as the boosted fits' passes call for, within a bound of what a pass sends to the driver."""
        most = max(1, (4 << 20) // (16 * self.some * self.bins * (1 << max(0, self.depth - 1))))
        self.at_once = min(most, -(-self.rounds // max(1, passes // max(1, self.depth))))
        self.begin()

    def begin(self) -> None:
        self.now = {t: self.tree(t) for t in range(len(self.trees), min(self.rounds, len(self.trees) + self.at_once))}

    def take(self, error, hists: dict) -> None:
        self.took(hists)
        if all(not tree.open for tree in self.now.values()):
            self.trees += self.now.values()
            self.begin()
            self.done = not self.now

    def weight(self, t: int) -> float:
        return 1.0


def _subset(strategy: str, width: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    if strategy in ("all", "sqrt", "log2", "onethird"):
        return {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}[strategy]
    return min(int(strategy), width) if strategy.isdigit() else max(1, math.ceil(float(strategy) * width))


# ---- Spark ML's models ----

NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double,
    leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def _stored_nodes(tree: _Tree, splits: list[np.ndarray]) -> list[tuple]:
    """Nodes in Spark's stored form, in preorder; a split into two leaves of one prediction is a leaf, as in Spark."""
    same = {}
    for h in sorted(tree.nodes, reverse=True):
        split = h in tree.split
        kids = (2 * h + 1, 2 * h + 2)
        same[h] = not split or all(same[c] for c in kids) and tree.value(kids[0]) == tree.value(kids[1])
    out, todo = [], [(0, None)]
    while todo:
        h, parent = todo.pop()
        node, i = tree.nodes[h], len(out)
        if parent is not None:
            out[parent][6 if h % 2 else 7] = i
        f, b = tree.split.get(h, (-1, 0))
        leaf = same[h]
        split = (-1, [], -1) if leaf else (f, [float(splits[f][b])], -1)
        out.append([i, tree.value(h), float(node["impurity"]), [float(node["n"]), float(node["s"]), float(node["q"])], int(node["n"]), -1.0 if leaf else node["gain"], -1, -1, split])
        if not leaf:
            todo += [(2 * h + 2, i), (2 * h + 1, i)]
    return [tuple(x) for x in out]


def _model(spark, learner, fit: _Fit, splits: list[np.ndarray]):
    """The fitted trees as a model of Spark ML: written in the form Spark stores models in, and loaded."""
    boosted = isinstance(learner, GBTRegressor)
    kind = GBTRegressionModel if boosted else RandomForestRegressionModel
    folder, now = scratch_path(spark, "trees"), int(time.time() * 1000)
    about = lambda name, uid, params, usual, **more: json.dumps({
        "class": f"org.apache.spark.ml.regression.{name}", "timestamp": now, "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": usual} | more)
    params, usual = ({p.name: v for p, v in some.items()} for some in (learner._paramMap, learner._defaultParamMap))
    common = {c: learner.getOrDefault(c) for c in ("featuresCol", "labelCol", "maxDepth", "seed")}
    one_tree = [(t, about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", common, {"impurity": "variance"}), fit.weight(t)) for t in range(len(fit.trees))]
    nodes = [(t, node) for t, tree in enumerate(fit.trees) for node in _stored_nodes(tree, splits)]
    one_line = spark.createDataFrame([(about(kind.__name__, learner.uid, params, usual, numFeatures=len(splits), numTrees=len(fit.trees)),)], "value string")
    one_line.coalesce(1).write.text(f"{folder}/metadata")
    spark.createDataFrame(one_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    spark.createDataFrame(nodes, NODES, verifySchema=False).coalesce(1).write.parquet(f"{folder}/data")
    return kind.load(folder)
