"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to some reference directions. For two vectors a and x and any reference r the angle between
them is at least |angle(a, r) - angle(x, r)| and at most angle(a, r) + angle(x, r) (or what is left of the full circle), so the cosine
lies in an interval; times both norms, widened by more than the rounding can be, that bounds the score. Only rows whose bounds meet a
wanted window of scores are scored, in whole numbers.

Rows are range-partitioned by label, nearest reference and angle, and stored as blocks. A table of fixed size holds the bounds of all regions
(partitions), so anchors are sent only to the blocks that can matter. The first region an anchor visits gives it k-th scores that narrow
its windows for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, parts_for, prepare, staged, with_row_key

REFERENCES, SAMPLE, MAX_REGIONS = 16, 2048, 16384
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9  # far more than what arccos, norms and products of doubles can be off
EXACT_FLOAT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1
ROW_SCHEMA = "rid bigint, vec_id bigint, label bigint, dims int, v binary, norm double, cell int, near double, angles binary"
BLOCK_SCHEMA = ("block bigint, region int, dims int, rids binary, ids binary, labels binary, points binary, norms binary, angles binary, low array<double>, high array<double>, "
                "norm_low double, norm_high double, label_low bigint, label_high bigint")
WANT = "lows array<bigint>, highs array<bigint>, pids array<bigint>, pscores array<bigint>"
ASK_SCHEMA = f"rid bigint, vec_id bigint, label bigint, dims int, v binary, norm double, angles binary, {WANT}"
HIT_SCHEMA = "anchor_rid bigint, anchor_id bigint, slot int, pid bigint, pscore bigint, rid bigint, vec_id bigint, score bigint"


def valid_rows(vectors: DataFrame, label: Column, is_anchor: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """rid, vec_id, label, v (floor(scale * x) per component), asks."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return with_row_key(vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("label IS NOT NULL"))


def reference_directions(rows: DataFrame, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors, each far from those before it, out of at most SAMPLE rows with the smallest digests. Any directions give the same result."""
    taken = rows.orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(SAMPLE).select("v").toPandas()["v"]
    width = max((len(v) for v in taken), default=1)
    points = np.zeros((len(taken), width))
    for i, v in enumerate(taken):
        points[i, :len(v)] = v
    norms = np.linalg.norm(points, axis=1)
    points = points[norms > 0] / norms[norms > 0, None]
    if not len(points):
        return np.eye(1, width)
    chosen, closest = [0], points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[chosen[-1]])
    return points[chosen]


def angles_to(points: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references, cut or filled up to the rows' dimensions; a vector or reference without length stands at a right angle."""
    dims = points.shape[1]
    r = np.zeros((len(references), dims))
    r[:, :min(dims, references.shape[1])] = references[:, :dims]
    size = np.linalg.norm(r, axis=1)
    r[size > 0] /= size[size > 0, None]
    unit = points / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(unit @ r.T, -1.0, 1.0))


def score_bounds(norm: np.ndarray, alpha: np.ndarray, norms_low, norms_high, low, high) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of anchors (rows) with everything in boxes (columns) of norms and of angles to the references."""
    near = np.zeros((len(alpha), low.shape[0]))
    far = np.full_like(near, np.pi)
    for r in range(alpha.shape[1]):
        a = alpha[:, r, None]
        np.maximum(near, low[:, r] - a, out=near)
        np.maximum(near, a - high[:, r], out=near)
        np.minimum(far, a + high[:, r], out=far)
        np.minimum(far, 2 * np.pi - a - low[:, r], out=far)
    most, least = np.cos(np.clip(near - ANGLE_SLACK, 0, np.pi)), np.cos(np.clip(far + ANGLE_SLACK, 0, np.pi))
    most *= norm[:, None] * np.where(most > 0, norms_high, norms_low)
    least *= norm[:, None] * np.where(least > 0, norms_low, norms_high)
    slack = norm[:, None] * norms_high * SCORE_SLACK + 1.0
    return least - slack, most + slack


def _placed(rows: DataFrame, references) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, vec_id, label, v = (batch.column(i) for i in range(4))
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dims in np.unique(sizes):
                at = np.nonzero(sizes == dims)[0]
                points = np.ascontiguousarray(flat[(ends[at] - dims)[:, None] + np.arange(dims)])
                norms = np.linalg.norm(points.astype(np.float64), axis=1)
                angles = angles_to(points, norms, references.value)
                cell = angles.argmin(axis=1)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [rid.take(take), vec_id.take(take), label.take(take), pa.array(np.full(len(at), dims), pa.int32()), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(norms),
                     pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(at)), cell]), pa.array([a.tobytes() for a in angles], pa.binary())],
                    ["rid", "vec_id", "label", "dims", "v", "norm", "cell", "near", "angles"])

    return rows.select("rid", "vec_id", "label", "v").mapInArrow(place, ROW_SCHEMA)


def _blocks(placed: DataFrame, regions: int, numbers: int, n_references: int) -> DataFrame:
    """One row per block: at most ``numbers`` components of rows that stand together in (dims, label, cell, angle)."""
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, made, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            join = lambda name: b"".join(rows[name].to_pylist())
            norms, labels = rows["norm"].to_numpy(), rows["label"].to_numpy()
            angles = np.frombuffer(join("angles")).reshape(len(norms), n_references)
            values = [(region << 32) + made, region, rows["dims"][0].as_py(), rows["rid"].to_numpy().tobytes(), rows["vec_id"].to_numpy().tobytes(), labels.tobytes(), join("v"),
                      norms.tobytes(), angles.tobytes(), angles.min(axis=0).tolist(), angles.max(axis=0).tolist(), norms.min(), norms.max(), int(labels.min()), int(labels.max())]
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 2, *[pa.int64()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names)

        count, dims = 0, None
        for batch in batches:
            sizes, start = batch.column(3).to_numpy(), 0
            for i, d in enumerate(sizes):
                if count and (d != dims or (count + 1) * d > numbers):
                    yield block(pa.Table.from_batches([*held, batch.slice(start, i - start)]))
                    held, start, count = [], i, 0
                count, dims = count + 1, d
            held.append(batch.slice(start))
        if count:
            yield block(pa.Table.from_batches(held))

    order = ["dims", "label", "cell", "near", "rid"]
    return placed.repartitionByRange(regions, *order).sortWithinPartitions(*order).mapInArrow(cut, BLOCK_SCHEMA)


def _region_table(blocks: DataFrame, n_references: int) -> pd.DataFrame:
    """At most MAX_REGIONS rows of bounds come to the driver."""
    return blocks.groupBy("region").agg(
        F.count("*").alias("blocks"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("dims",) for f in (F.min, F.max)], F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"),
        F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"),
        F.array(*[F.min(F.col("low")[i]) for i in range(n_references)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(n_references)]).alias("high"),
    ).orderBy("region").toPandas()


def _routed(asked: DataFrame, table, same_label: bool, first: bool | None) -> DataFrame:
    """``asked`` with the blocks each row must see. ``first``: only the region that promises most, or all but that one (by the windows it had then)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        low, high = np.array(t["low"].tolist()), np.array(t["high"].tolist())
        norm_low, norm_high = t["norm_low"].to_numpy(), t["norm_high"].to_numpy()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                label, dims, norm = (part.column(part.schema.get_field_index(c)).to_numpy()[:, None] for c in ("label", "dims", "norm"))
                alpha = np.array([np.frombuffer(a) for a in part.column(part.schema.get_field_index("angles")).to_pylist()])
                least, most = score_bounds(norm[:, 0], alpha, norm_low, norm_high, low, high)
                fits = (t["dims_min"].to_numpy() <= dims) & (dims <= t["dims_max"].to_numpy())
                if same_label:
                    fits &= (t["label_low"].to_numpy() <= label) & (label <= t["label_high"].to_numpy())
                else:
                    fits &= (t["label_low"].to_numpy() != label) | (t["label_high"].to_numpy() != label)
                # where it starts depends on labels and bounds alone, so both visits agree on it
                promise = np.where(fits, most, -np.inf)
                home = np.zeros_like(fits)
                home[np.arange(len(home)), promise.argmax(axis=1)] = True
                meets = np.zeros_like(fits)
                for i, (lows, highs) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lows", "highs")))):
                    for a, b in zip(lows, highs):
                        meets[i] |= (most[i] >= a) & (least[i] <= b) & (a <= b)
                at, region = np.nonzero(fits & (home if first else meets & ~home))
                n = t["blocks"].to_numpy()[region]
                at, region = np.repeat(at, n), np.repeat(region, n)
                sub = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                if len(at):
                    block = (t["region"].to_numpy(np.int64)[region] << 32) + sub
                    out = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(block), *out.columns], ["block", *out.schema.names])

    names = ["rid", "vec_id", "label", "dims", "v", "norm", "angles", "lows", "highs", "pids", "pscores"]
    return asked.select(*names).mapInArrow(route, f"block bigint, {ASK_SCHEMA}")


class Block:
    def __init__(self, row):
        ints = lambda x: np.frombuffer(x, np.int64)
        self.rids, self.ids, self.labels, self.norms = ints(row.rids), ints(row.ids), ints(row.labels), np.frombuffer(row.norms)
        self.points = ints(row.points).reshape(len(self.rids), row.dims)
        self.angles = np.frombuffer(row.angles).reshape(len(self.rids), -1)
        self.kinds = {}

    def as_kind(self, reach: float) -> np.ndarray:
        """Components in a type whose products and sums are exact up to ``reach``."""
        kind = np.float64 if reach < EXACT_FLOAT else np.int64 if reach < 2.0**62 else object
        if kind not in self.kinds:
            self.kinds[kind] = self.points.astype(kind)
        return self.kinds[kind]

    def search(self, asked: pd.DataFrame, same_label: bool, k: int) -> Iterator[tuple]:
        """(row of ``asked``, slot, position, score) of the k best of every window; ties to the smaller id, then the earlier row."""
        norm, alpha = asked["norm"].to_numpy(), np.array([np.frombuffer(a) for a in asked["angles"]])
        width = max(map(len, asked["lows"]), default=0)
        lows, highs = np.full((len(asked), width), HIGHEST), np.full((len(asked), width), LOWEST)
        for i, (a, b) in enumerate(zip(asked["lows"], asked["highs"])):
            lows[i, :len(a)], highs[i, :len(b)] = a, b
        step = max(1, (1 << 18) // max(1, len(self.rids)))
        biggest = float(np.abs(self.points).max(initial=0)) * self.points.shape[1]
        for start in range(0, len(asked), step):
            least, most = score_bounds(norm[start:start + step], alpha[start:start + step], self.norms, self.norms, self.angles, self.angles)
            for i in range(start, min(start + step, len(asked))):
                row = asked.iloc[i]
                fits = (self.labels == row.label) & (self.rids != row.rid) if same_label else self.labels != row.label
                meets = np.zeros(len(self.rids), bool)
                for a, b in zip(lows[i], highs[i]):
                    meets |= (most[i - start] >= a) & (least[i - start] <= b)
                at = np.nonzero(fits & meets)[0]
                if not len(at):
                    continue
                v = np.frombuffer(row.v, np.int64)
                points = self.as_kind(biggest * float(np.abs(v).max(initial=0)))
                # rows that stand together are scored as one stretch
                from_, to = at[0], at[-1] + 1
                scores = (points[from_:to] @ v.astype(points.dtype))[at - from_] if to - from_ < 2 * len(at) else points[at] @ v.astype(points.dtype)
                for slot in range(width):
                    inside = np.nonzero((scores >= lows[i, slot]) & (scores <= highs[i, slot]))[0]
                    if len(inside) > k and scores.dtype != object:
                        kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                        inside = inside[scores[inside] >= kth]
                    best = sorted(inside.tolist(), key=lambda j: (-scores[j], self.ids[at[j]], self.rids[at[j]]))[:k]
                    for j in best:
                        yield i, slot, at[j], int(scores[j])


def _hits(blocks: DataFrame, routed: DataFrame, parts: int, same_label: bool, k: int) -> DataFrame:
    """What every (block, part of the anchors) holds; a block is copied only for parts that ask for it."""
    asked = routed.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(parts)).cast("int"))
    stored = blocks.select("block", "dims", "rids", "ids", "labels", "points", "norms", "angles")
    pairs = asked.select(F.col("block").alias("at"), F.col("part").alias("of")).distinct()
    wanted = stored.join(pairs, stored.block == pairs["at"])
    names = [f.split()[0] for f in HIT_SCHEMA.split(", ")]

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right[right["dims"] == left["dims"].iloc[0]] if len(left) else right[:0]
        if right.empty:
            return pd.DataFrame(columns=names)
        block, rows = Block(left.iloc[0]), []
        for i, slot, at, score in block.search(right, same_label, k):
            row = right.iloc[i]
            pid, pscore = (None, None) if same_label else (row.pids[slot], row.pscores[slot])
            rows.append((row.rid, row.vec_id, slot, pid, pscore, block.rids[at], block.ids[at], score))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"pid": "Int64", "pscore": "Int64"})

    return wanted.groupBy("at", "of").cogroup(asked.groupBy("block", "part")).applyInPandas(look, HIT_SCHEMA)


def _best(hits: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("anchor_rid", "slot").orderBy(F.desc("score"), "vec_id", "rid")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, block_numbers: int = 1 << 18, anchors_per_part: int = 4096, max_regions: int = MAX_REGIONS,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x). An anchor's positives are its best other rows of the same label; its negatives for a
    positive of score p are the best rows of another label with ``low`` * p <= 100 * score <= ``high`` * p, ranked from 1. Ties go to the
    smaller id, then to the earlier row. Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
    part; vectors of another length than the anchor's are no partners. Rows that repeat an id are rows of their own. Anchors without
    positives and positives without negatives give no rows, nor does an empty table. Scores and the ends of windows must fit 64 bits. ``block_numbers``, ``anchors_per_part`` and
    ``max_regions`` bound what a task and the driver hold and never change the result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = staged(valid_rows(vectors, F.col(label_col) if label is None else label, is_anchor, scale, id_col, vector_col), "negative-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.sum(F.size("v").cast("bigint")).alias("numbers")).first()
    directions = reference_directions(rows)
    references = spark.sparkContext.broadcast(directions)
    n_references = len(directions)
    regions = min(max_regions, parts_for(counts.numbers or 1, block_numbers))
    blocks = staged(_blocks(_placed(rows, references), regions, block_numbers, n_references), "negative-blocks")
    anchors = _placed(rows.where("asks"), references).select("rid", "vec_id", "label", "dims", "v", "norm", "angles")
    table = spark.sparkContext.broadcast(_region_table(blocks, n_references))
    parts = parts_for(counts.asks, anchors_per_part)
    longs = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    none = F.lit(None).cast("array<bigint>")

    def visits(asked: DataFrame, same_label: bool, k: int, narrowed) -> DataFrame:
        """The k best per slot: first from the region that promises most, then from all others that can still matter."""
        home = staged(_hits(blocks, _routed(asked, table, same_label, True), parts, same_label, k), "negative-home")
        kth = home.groupBy(F.col("anchor_rid").alias("rid"), "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        per = kth.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))
        rest = _hits(blocks, _routed(narrowed(asked.join(per, "rid", "left")), table, same_label, False), parts, same_label, k)
        out = staged(_best(home.unionByName(rest), k), "negative-best")
        discard(home)
        return out

    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kths", i), F.lit(LOWEST))))
    narrowed = lambda df: df.withColumn("lows", raised)
    asked = anchors.select("*", longs(LOWEST).alias("lows"), longs(HIGHEST).alias("highs"), none.alias("pids"), none.alias("pscores"))
    near = visits(asked, True, positives, narrowed)
    own = near.groupBy(F.col("anchor_rid").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))
    window = anchors.join(own, "rid").select(
        *anchors.columns, F.transform("own", lambda p: _percent(p["score"], low, True)).alias("lows"),
        F.transform("own", lambda p: _percent(p["score"], high, False)).alias("highs"), F.col("own.vec_id").alias("pids"), F.col("own.score").alias("pscores"))
    window = staged(window, "negative-windows")
    found = visits(window, False, negatives, narrowed)
    discard(rows, blocks, window, near)
    references.destroy()
    table.destroy()
    return found.select(F.col("anchor_id"), F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def _percent(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100 rounded down or up, without leaving 64 bits on the way."""
    rest = F.pmod(score, F.lit(100))
    part = F.ceil(rest * percent / 100) if up else F.floor(rest * percent / 100)
    return F.call_function("div", score - rest, F.lit(100)) * percent + part.cast("bigint")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::bigint AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT anchor_id, positive_id, positive_score, vec_id, score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5
"""
