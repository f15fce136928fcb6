"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each tree is one order of the documents: sorted by the tree's own sequence of MinHash values. Documents that stand next to each other
share the longest prefixes, so a document's candidates are its nearest predecessors in the order, provided they share at least
``least_depth`` values. Where few documents share that prefix these are all of them; in a dense region only the ones with the longest
common prefix, so the depth adapts to the region. Orders are range-partitioned: a region with a third of all documents is spread
over many tasks; its documents in different components are then compared by bit sketches, in blocks. Links are confirmed on the full
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, prepare, rows_among, staged, text_of, with_row_key
from .graph import components
from .hashing import LOWER, MinHash, chunks, common_size, mixed, shingle_sets

SKETCH_BITS = 2048
# candidates with fewer shingles are cheap to check on the full sets
SMALL_SET = 64
SIGNED_SCHEMA = "n_shingles bigint, set_a bigint, set_b bigint, signature binary"


def _lowered(column: pa.Array) -> list[bytes]:
    return [x.translate(LOWER) for x in column.cast(pa.binary()).to_pylist()]


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int, depth: int) -> DataFrame:
    """doc_id, text_key, size of the shingle set, its digest and the signature (big-endian, tree by tree); null without shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(trees * depth)
        for batch in batches:
            texts = _lowered(batch.column(2))
            counts, first, second, signatures = [], [], [], []
            for _, part in chunks(texts):
                sets = list(shingle_sets(part, words))
                full = [x for x in sets if len(x)]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in full])[:-1]]).astype(np.int64) if full else np.zeros(0, np.int64)
                minima = iter(hashed.of(np.concatenate(full) >> np.uint64(32), starts).astype(">u4") if full else ())
                for x in sets:
                    digest = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64)
                    counts.append(len(x))
                    first.append(digest[0])
                    second.append(digest[1])
                    signatures.append(next(minima).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_key": batch.column(1), "n_shingles": pa.array(counts, pa.int64()), "set_a": pa.array(first, pa.int64()),
                "set_b": pa.array(second, pa.int64()), "signature": pa.array(signatures, pa.binary())})

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_key binary, {SIGNED_SCHEMA}")


def neighbours(reps: DataFrame, trees: int, depth: int, least_depth: int, reach: int) -> DataFrame:
    """Candidate pairs a < b with the values they share in each order; reps: node (long) and signature."""
    width = 4 * depth
    rows = reps.select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature").select(
        "tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("path"), "node")
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")

    def compared(tree, path, node):
        """Pairs of rows up to ``reach`` apart that share a long enough prefix."""
        for back in range(1, reach + 1):
            same = path[back:] == path[:-back] if len(node) > back else np.zeros((0, depth), bool)
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            at = np.flatnonzero((shared >= least_depth) & (tree[back:] == tree[:-back])) if len(shared) else np.zeros(0, int)
            one, other = node[at], node[at + back]
            yield at + back, np.minimum(one, other), np.maximum(one, other), shared[at]

    def arrays(batch: pa.RecordBatch):
        path = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, depth)
        return batch.column(0).to_numpy(), path, batch.column(2).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, path, node = np.zeros(0, np.int32), np.zeros((0, depth), ">u4"), np.zeros(0, np.int64)
        head, old = [], 0
        for batch in batches:
            new = arrays(batch)
            tree, path, node = np.concatenate([tree, new[0]]), np.concatenate([path, new[1]]), np.concatenate([node, new[2]])
            if len(head) < reach:
                head += list(zip(tree[old:].tolist(), path[old:], node[old:].tolist()))[: reach - len(head)]
            found = [(a[k >= old], b[k >= old], s[k >= old]) for k, a, b, s in compared(tree, path, node)]
            a, b, s = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "shared": pa.array(s.astype(np.int32)),
                                              "tree": pa.nulls(len(a), pa.int32()), "path": pa.nulls(len(a), pa.binary())})
            tree, path, node = tree[-reach:], path[-reach:], node[-reach:]
            old = len(node)
        # the rows at both ends, to be compared across the border of two partitions
        ends = head + [x for x in zip(tree.tolist(), path, node.tolist())]
        ends = list({(t, p.tobytes(), n): (t, p.tobytes(), n) for t, p, n in ends}.values())
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[2] for x in ends], pa.int64()), "b": pa.nulls(len(ends), pa.int64()), "shared": pa.nulls(len(ends), pa.int32()),
                                          "tree": pa.array([x[0] for x in ends], pa.int32()), "path": pa.array([x[1] for x in ends], pa.binary())})

    out = staged(ordered.mapInArrow(run, "a bigint, b bigint, shared int, tree int, path binary"), "order-pairs")
    pairs = out.where("b IS NOT NULL").select("a", "b", "shared")
    # a few rows per partition: the predecessors of each in the whole order
    near = Window.partitionBy("tree").orderBy("path", "a")
    ends = out.where("b IS NULL").select("tree", "path", "a")
    before = F.array(*[F.struct(F.lag("a", k).over(near).alias("b"), F.lag("path", k).over(near).alias("other")) for k in range(1, reach + 1)])
    across = ends.withColumn("before", before).select("path", "a", F.explode("before").alias("x"))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.substring("path", F.lit(1), i * 4) == F.substring("other", F.lit(1), i * 4)))
    across = across.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"), "path", F.col("x.other").alias("other")).where("other IS NOT NULL AND a <> b")
    across = across.select("a", "b", shared.cast("int").alias("shared")).where(F.col("shared") >= least_depth)
    return pairs.unionByName(across).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def sketched(minima: np.ndarray) -> np.ndarray:
    """One bit per minimum, packed; each permutation mixes on its own, so that the bits of two different elements agree independently."""
    own = np.arange(minima.shape[1], dtype=np.uint64) << np.uint64(32)
    return np.packbits((mixed(minima.astype(np.uint64) | own) & np.uint64(1)).astype(bool), axis=1)


def likely(one: np.ndarray, other: np.ndarray, one_size: np.ndarray, other_size: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sketches can be linked: the sizes allow it and the estimate is within five deviations of the threshold."""
    least = percent / 100
    same = SKETCH_BITS - np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int32)
    deviation = 2 * np.sqrt((1 + least) * (1 - least) / 4 / SKETCH_BITS)
    sizes = 100 * np.minimum(one_size, other_size) >= percent * np.maximum(one_size, other_size)
    return sizes & (2 * same / SKETCH_BITS - 1 >= least - 5 * deviation)


def crowded_pairs(reps: DataFrame, sketches: DataFrame, label: DataFrame, percent: int, trees: int, depth: int, least_depth: int, reach: int,
                  block: int = 2048) -> DataFrame:
    """Likely pairs a < b of different components that share the first ``least_depth`` values of an order with more than ``reach`` others.

    Sketches of a region are compared in blocks of about ``block`` nodes inside the tasks; only pairs that pass leave them.
    """
    start = F.expr(f"substring(signature, tree * {4 * depth} + 1, {4 * least_depth})")
    rows = reps.select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature").select(F.xxhash64("tree", start).alias("region"), "node")
    full = staged(rows.groupBy("region").agg(F.count("*").alias("n")).where(f"n > {reach + 1}"), "full-regions")
    rows = rows_among(rows, full, "region").join(full, "region").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # one component holds all of it: nothing to compare
    mixed_regions = rows.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("region")
    rows = rows.join(mixed_regions, "region", "left_semi").join(sketches, "node")
    blocks = F.ceil(F.col("n") / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.select("region", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node", "root", "n_shingles", "sketch")
    rows = rows.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")

    def compared(group: list) -> Iterator[pa.RecordBatch]:
        own, node, root, size = (np.array([r[c] for r in group]) for c in ("own", "node", "root", "n_shingles"))
        bits = np.frombuffer(b"".join(r["sketch"] for r in group), np.uint64).reshape(len(group), -1)
        low, high = group[0]["low"], group[0]["high"]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        for i in left:
            others = right if low != high else right[right > i]
            hits = others[root[others] != root[i]]
            hits = hits[likely(bits[hits], bits[i], size[hits], size[i], percent)]
            if len(hits):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[hits], node[i])), pa.array(np.maximum(node[hits], node[i]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["region"], r["low"], r["high"])):
            found = list(compared(list(group)))
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """node, sorted shingle set (binary), its size and its sketch, of the wanted (node, text_key)."""
    text = text_of(text_col)
    rows = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text")).withColumn("key", F.xxhash64("text_key"))
    # merge: the shuffle keeps the two Python steps in stages of their own, and so half as many workers in memory
    rows = rows_among(rows, wanted.select(F.xxhash64("text_key").alias("key")), "key").join(wanted.hint("merge"), "text_key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(SKETCH_BITS, seed=53)
        for batch in batches:
            sets, sketches = [], []
            for _, part in chunks(_lowered(batch.column(1))):
                own = list(shingle_sets(part, words))
                starts = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]]).astype(np.int64)
                minima = hashed.of(np.concatenate(own) >> np.uint64(32), starts)
                sketches += [x.tobytes() for x in sketched(minima)]
                sets += own
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "items": pa.array([x.tobytes() for x in sets], pa.binary()),
                                              "n_shingles": pa.array([len(x) for x in sets], pa.int64()), "sketch": pa.array(sketches, pa.binary())})

    # a kept text may stand in several rows
    return rows.mapInArrow(run, "node bigint, items binary, n_shingles bigint, sketch binary").dropDuplicates(["node"])


def likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule a link out, and all of small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 6))
            one, other = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            keep = likely(x, y, one, other, percent) | (np.minimum(one, other) < SMALL_SET) if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    def of(node: str) -> DataFrame:
        return sketches.select(F.col("node").alias(node), F.col("n_shingles").alias(f"{node}_size"), F.col("sketch").alias(f"{node}_sketch"))

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "shared", "a_size", "a_sketch", "b_size", "b_sketch")
    return joined.mapInArrow(run, "a bigint, b bigint, shared bigint")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union."""
    one, other = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common_size(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_components(docs: DataFrame, percent: int = 85, words: int = 5, trees: int = 16, depth: int = 8, least_depth: int = 4, reach: int = 6,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (md5 of the text) per input row.

    Texts are lower-cased (A to Z) and cut at blanks; a text's set holds its distinct shingles of ``words`` words, or all its words as one.
    Documents whose sets have a Jaccard similarity of at least ``percent`` in a hundred are linked; a component is what links reach, and
    keeps its smallest id. Empty and null texts have no shingles and are linked with nothing. Equal sets are one node, so copies need no
    pairs. Rows that repeat an id keep it together; null ids count only where a component has no other. An empty table gives no rows.

    A pair at the threshold shares a region with probability 1 - (1 - 0.85^least_depth)^trees (0.999993 with the defaults; with
    percent 80 1 - (1 - 0.8^least_depth)^trees = 0.99978); every pair
    of different components that shares a region is checked exactly.
    """
    prepare(docs.sparkSession)
    rows = staged(with_row_key(signed(docs, id_col, text_col, words, trees, depth)), "signed")
    classes = staged(rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    signed_rows, rows = rows, staged(rows.drop("signature"), "documents")
    reps = staged(signed_rows.join(classes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "text_key", "signature"), "nodes")
    discard(signed_rows)
    pairs = staged(neighbours(reps.select("node", "signature"), trees, depth, least_depth, reach), "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = staged(reps.select("node", "text_key").join(nodes, "node"), "wanted")
    sets = staged(_texts(docs, text_col, wanted, words), "sets")

    sketches = sets.select("node", "n_shingles", "sketch")
    candidates, pairs = pairs, staged(likely_pairs(pairs, sketches, percent), "likely-pairs")
    discard(candidates, wanted)

    # first every node with the neighbour it shares most with; what these links leave in different components is checked after that
    def closest(node: str, other: str) -> DataFrame:
        order = Window.partitionBy(node).orderBy(F.desc("shared"), other)
        return pairs.withColumn("at", F.row_number().over(order)).where("at = 1").select("a", "b")

    best = staged(closest("a", "b").union(closest("b", "a")).distinct(), "best-pairs")
    links = staged(linked(best, sets, percent), "links")
    label = components(links)

    def apart(df: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        for node in ("a", "b"):
            named = label.select(F.col("node").alias(node), F.col("root").alias(f"root_{node}"))
            df = df.join(named, node, "left").withColumn(f"root_{node}", F.coalesce(f"root_{node}", node))
        return df.where("root_a <> root_b").select("a", "b")

    rest = apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"))
    first, links = links, staged(links.union(linked(rest, sets, percent)), "more-links")
    discard(first)
    label = components(links)
    # regions too full for an order's neighbours to be all pairs
    crowded = crowded_pairs(reps.select("node", "signature"), sketches, label, percent, trees, depth, least_depth, reach)
    crowded = staged(crowded.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "crowded-pairs")
    final = staged(links.union(linked(crowded, sets, percent)), "all-links")
    roots = components(final)

    found = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    merged = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    settled = staged(found.join(merged, "root").select("set_a", "set_b", "component_id"), "settled")
    discard(classes, reps, sets, pairs, best, links, crowded, final)
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    joined = rows.where("n_shingles > 0").join(settled, ["set_a", "set_b"])
    columns = ["doc_id", "n_shingles", "component_id", "text_key"]
    return joined.select(*columns).unionByName(alone.select(*columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows with one document of each component; of rows that agree in id and text one stays."""
    kept = near_components(docs, id_col=id_col, text_col=text_col, **options).where("kept").select("doc_id", "text_key").distinct()
    kept = staged(kept, "kept-documents").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    keyed = docs.withColumn("__text", F.unhex(F.md5(text_of(text_col))))
    same = keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__text"] == kept["__key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, "__text"]).select(*docs.columns)


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, linked from a similarity of 85 in a hundred."""
    return near_components(spark.read.parquet(f"{folder}/documents.parquet")).drop("text_key")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(g)::bigint AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""
