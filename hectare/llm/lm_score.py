"""Language-model scores by context-tree weighting, trained and applied as Spark jobs.

Documents are stored once, normalised, in buckets (one per input partition). Each bucket asks for what it needs of the corpus: its
distinct (context, byte) keys and words, with how often training documents hold them. Requests meet by part (all contexts with the same
two nearest bytes are in one part), where counts are summed and the trees weighted; the answer goes back to the bucket as one number
per key. A task holds the keys of one part, or the texts of one bucket with its own keys, never the model or the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare, remainder, staged, text_of
from .ctw import Level, keys_of, levels, log10_of, summed
from .hashing import BLANKS, LOWER, mixed, words

CHUNK = 1 << 20
GRAM, WORD = 0, 1
END = b"\n"
END_WORD = np.uint64(0)
REQUEST_SCHEMA = "kind int, part int, bucket int, size bigint, keys binary, counts binary"


def normalised(text: bytes) -> bytes:
    """Lower-case words with one blank between them, then the end."""
    return BLANKS.sub(b" ", text.translate(LOWER)).strip(b" ") + END


def packed(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = pa.decompress(blob, decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, size).T).view(kind).reshape(size)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpacked_keys(blob: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpacked(blob, size, np.uint64), dtype=np.uint64)


def grams_of(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the bodies, each with ends before it, and where each body's keys begin."""
    pad = END * depth
    data = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    real = np.ones(len(data), bool)
    for at in np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]):
        real[at : at + depth] = False
    return keys_of(data, depth)[real[depth:]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def terms_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the bodies, an end after each body's words, and where each body's begin."""
    hashes, _, _, bounds = words(bodies)
    ends = bounds[1:]
    return np.insert(np.maximum(hashes, np.uint64(1)), ends, END_WORD), bounds[:-1] + np.arange(len(bodies))


def in_chunks(bodies: list[bytes], size: int = CHUNK) -> Iterator[slice]:
    first, total = 0, 0
    for at, body in enumerate(bodies):
        if at > first and total + len(body) > size:
            yield slice(first, at)
            first, total = at, 0
        total += len(body)
    if bodies:
        yield slice(first, len(bodies))


def wanted(bodies: list[bytes], train: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys and their training counts, of grams and words."""
    out = {}
    for kind in (GRAM, WORD):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in in_chunks(bodies):
            keys, starts = grams_of(bodies[part], depth) if kind == GRAM else terms_of(bodies[part])
            learns = np.repeat(train[part], np.diff(np.append(starts, len(keys))))
            seen, counts = np.unique(keys[learns], return_counts=True)
            new = np.unique(keys[~learns])
            found += [(seen, counts.astype(np.int64)), (new, np.zeros(len(new), np.int64))]
            if sum(len(x[0]) for x in found[1:]) > max(2 * CHUNK, len(found[0][0]) // 2):
                found = [tuple(summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])))]
        out[kind] = tuple(summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])))
    return out


def parts_of(kind: int, keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth - 1)) if kind == GRAM else keys
    return (mixed(near) % np.uint64(parts)).astype(np.int64)


def by_part(kind: int, keys: np.ndarray, depth: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions of its keys in order)."""
    part = parts_of(kind, keys, depth, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(part[at[0]]), at


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of sorted frames, one run of equal keys at a time."""
    from itertools import groupby

    rows = (row for pdf in frames for row in pdf.itertuples(index=False))
    return groupby(rows, key=lambda row: tuple(getattr(row, c) for c in by))


def stored_bodies(docs: DataFrame, folds: int, fold: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, held_out, bucket and normalised body, written once in buckets; and the number of buckets."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        for batch in batches:
            bodies = [normalised(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(bodies), bucket, np.int32)), pa.array(bodies, pa.binary())],
                                             names=["doc_id", "held_out", "bucket", "body"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, folds) == fold).alias("held_out"), text_of(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, bucket int, body binary")
    count = max(1, rows.rdd.getNumPartitions())
    table = f"lm_bodies_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "bodies")).bucketBy(count, "bucket").saveAsTable(table)
    return spark.table(table), count


def score_documents(docs: DataFrame, depth: int = 6, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte per input row.

    The model learns from all documents outside the held-out fold (crc32 of the id modulo ``folds`` equals ``fold``; a null id counts as
    the empty text) and gives the probability of the normalised text: lower-case words with one blank between them and an end. ``score``
    is its log10, ``bits_per_byte`` the code length per byte. A byte is predicted from the longest context that training has seen, mixed
    with all shorter ones. Null and empty texts are the end alone; without training documents every byte costs eight bits. Rows that
    repeat an id are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    bodies, buckets = stored_bodies(docs, folds, fold, id_col, text_col)
    parts = min(1 << 16, max(64, 2 * buckets))

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, (keys, counts) in wanted(pdf["body"].tolist(), ~pdf["held_out"].to_numpy(bool), depth).items():
            for part, at in by_part(kind, keys, depth, parts):
                rows.append((kind, part, int(key[0]), len(at), packed_keys(keys[at]), packed(counts[at])))
        return pd.DataFrame(rows, columns=["kind", "part", "bucket", "size", "keys", "counts"])

    requests = staged(bodies.select("bucket", "held_out", "body").groupBy("bucket").applyInPandas(ask, REQUEST_SCHEMA), "requests")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (kind, part), rows in _groups(frames, ["kind", "part"]):
            keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

            def settle(keys, counts, waiting):
                return summed(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))

            for row in rows:
                waiting.append((unpacked_keys(row.keys, row.size), unpacked(row.counts, row.size, np.int64)))
                if sum(len(w[0]) for w in waiting) > max(CHUNK, len(keys)):
                    keys, counts = settle(keys, counts, waiting)
                    waiting = []
            keys, counts = settle(keys, counts, waiting)
            near = (b"", b"", b"", b"")
            if kind == GRAM:
                top = levels(keys, counts, depth, 2)[0]
                # what the contexts of one byte need of this part
                shorter = (top.nodes >> np.uint64(16) << np.uint64(8)) | (top.nodes & np.uint64(255))
                near = tuple(x.tobytes() for x in summed(shorter, top.zeros, top.ones, top.log_weighted))
            yield pd.DataFrame([(kind, part, -1, len(keys), packed_keys(keys), packed(counts), int((counts > 0).sum()), int(counts.sum()), *near)],
                               columns=["kind", "part", "bucket", "size", "keys", "counts", "n_known", "n_all", "nodes", "zeros", "ones", "below"])

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("kind", "part").sortWithinPartitions("kind", "part", "bucket")

    model = staged(together(requests).mapInPandas(merge, REQUEST_SCHEMA + ", n_known bigint, n_all bigint, nodes binary, zeros binary, ones binary, below binary"), "counts")
    sizes = model.where(f"kind = {WORD}").agg(F.coalesce(F.sum("n_known"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    n_words, n_tokens = int(sizes[0]), int(sizes[1])

    def nodes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"node": np.frombuffer(row.nodes, np.uint64).astype(np.int64), "zeros": np.frombuffer(row.zeros, np.int64),
                                    "ones": np.frombuffer(row.ones, np.int64), "below": np.frombuffer(row.below, np.float64)})

    # contexts of one byte: at most 256 x 255 decisions whatever the corpus
    first = model.where(f"kind = {GRAM}").select("nodes", "zeros", "ones", "below").mapInPandas(nodes_of, "node bigint, zeros bigint, ones bigint, below double")
    first = first.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas().sort_values("node")
    one = Level(first["node"].to_numpy(np.uint64), first["zeros"].to_numpy(np.int64), first["ones"].to_numpy(np.int64), first["below"].to_numpy(np.float64))
    nodes, zeros, ones = summed(one.nodes & np.uint64(255), one.zeros, one.ones)
    shared = spark.sparkContext.broadcast([Level(nodes, zeros, ones, one.up(nodes)), one])

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (kind, part), rows in _groups(frames, ["kind", "part"]):
            known, values = np.zeros(0, np.uint64), np.zeros(0)
            for row in rows:
                keys = unpacked_keys(row.keys, row.size)
                if row.bucket < 0:
                    counts, known = unpacked(row.counts, row.size, np.int64), keys
                    values = counts if kind == WORD else log10_of(keys, shared.value + levels(keys, counts, depth, 2), depth).astype(np.float32)
                else:
                    yield pd.DataFrame([(row.bucket, kind, part, values[np.searchsorted(known, keys)].tobytes())], columns=["bucket", "kind", "part", "found"])

    columns = ["kind", "part", "bucket", "size", "keys", "counts"]
    asked = together(model.select(*columns).unionByName(requests.select(*columns).withColumn("counts", F.lit(None).cast("binary"))))
    answers = asked.mapInPandas(answer, "bucket int, kind int, part int, found binary")
    kind_of_id = bodies.schema["doc_id"].dataType.simpleString()

    def score(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        texts = docs["body"].tolist()
        out = docs[["doc_id", "held_out"]].copy()
        tables = {}
        for kind, (keys, _) in wanted(texts, ~docs["held_out"].to_numpy(bool), depth).items():
            values = np.zeros(len(keys), np.float32 if kind == GRAM else np.int64)
            blobs = dict(zip(found["part"][found["kind"] == kind], found["found"][found["kind"] == kind]))
            for part, at in by_part(kind, keys, depth, parts):
                values[at] = np.frombuffer(blobs[part], values.dtype)
            tables[kind] = keys, values

        def looked_up(kind: int, keys: np.ndarray) -> np.ndarray:
            order = np.argsort(keys)
            out = np.empty(len(keys), tables[kind][1].dtype)
            out[order] = tables[kind][1][np.searchsorted(tables[kind][0], keys[order])]
            return out

        rows = []
        for part in in_chunks(texts):
            keys, starts = grams_of(texts[part], depth)
            scores = np.add.reduceat(looked_up(GRAM, keys).astype(np.float64), starts)
            keys, starts = terms_of(texts[part])
            counts = looked_up(WORD, keys)
            base = np.add.reduceat(np.log10((counts + 1.0) / (n_tokens + n_words + 1.0)), starts)
            sizes = np.diff(np.append(starts, len(keys)))
            rows.append(pd.DataFrame({"n_tokens": sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts), "train_tokens": n_tokens,
                                      "base_score": base, "score": scores, "n_bytes": [len(x) for x in texts[part]]}))
        for name, column in pd.concat(rows).items():
            out[name] = column.to_numpy()
        out["bits_per_byte"] = -out["score"] / np.log10(2.0) / out["n_bytes"]
        return out

    schema = f"doc_id {kind_of_id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
    return bodies.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(score, schema)


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; those with remainder 2 of 7 are held out."""
    return score_documents(spark.read.parquet(f"{folder}/documents.parquet"))
