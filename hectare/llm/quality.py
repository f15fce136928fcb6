"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are byte pairs, hashed to a fixed number of columns, and the words that repeat the word before them; their damped and idf-weighted counts are projected on the leading singular
directions of a bounded sample of labelled documents. The sample's vectors go to every task; each document takes its cosine with all of
them in one blocked product, and its most similar ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, remainder, staged, text_of

BLOCK = 256
# what a repeated word counts against a byte pair
REPEAT_WEIGHT = 16


def term_counts(text: bytes, columns: int) -> np.ndarray:
    """Byte pairs per hashed column and, in the last column, repeated words, over the whole text."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) < 2:
        return np.zeros(columns, np.float32)
    pairs = np.bincount(data[:-1] << np.uint32(8) | data[1:], minlength=1 << 16)
    at = np.flatnonzero(pairs)
    column = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(columns - 1)
    counts = np.bincount(column.astype(np.int64), weights=pairs[at], minlength=columns)
    words = text.split()
    counts[-1] = REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
    return counts.astype(np.float32)


def _damped(counts: np.ndarray) -> np.ndarray:
    """Share of each term, its root taken so that a few common terms don't decide."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voters:
    """A fitted space and the labelled vectors in it; of bounded size whatever the corpus."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, nearest: int):
        self.idf, self.axes, self.vectors, self.labels, self.nearest = idf, axes, vectors, labels, nearest

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dims: int, nearest: int) -> Voters:
        columns = counts.shape[1]
        if not len(labels):
            return cls(np.ones(columns, np.float32), np.zeros((columns, 1), np.float32), np.zeros((0, 1), np.float32), labels, nearest)
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        rows = _unit(_damped(counts) * idf)
        # singular directions from the smaller square matrix of the sample
        values, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        axes = vectors[:, ::-1][:, : max(1, min(dims, int((values > 1e-6).sum())))].astype(np.float32)
        return cls(idf, axes, _unit(rows @ axes), labels.astype(np.float32), nearest)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, by similarity; without terms the share in the sample; 0.5 without a sample."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.labels):
            return out
        k = min(self.nearest, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            block = counts[at : at + BLOCK]
            sims = _unit(_unit(_damped(block) * self.idf) @ self.axes) @ self.vectors.T
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sims, top, axis=1), 0) ** 4
            total = weight.sum(axis=1)
            vote = (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12)
            some = (block.sum(axis=1) > 0) & (total > 1e-9)
            out[at : at + BLOCK][some] = np.clip(vote[some], 0, 1)
        return out


def fit_voters(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, sample_rows: int = 2000, columns: int = 1536, dims: int = 64,
               nearest: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Voters:
    """Voters from at most ``sample_rows`` labelled documents of each label, taken by a hash of the id, outside fold 0.

    Labels that are null or neither 0 nor 1 are left out; of several labels of a document the greatest counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col, folds) != 0)).groupBy(
        F.col(id_col).alias("known_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = [F.xxhash64("known_id"), F.col("known_id")]
    # bounded: sample_rows of each label
    chosen = known.where("label = 0").orderBy(*order).limit(sample_rows).union(known.where("label = 1").orderBy(*order).limit(sample_rows))
    chosen = staged(chosen, "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [term_counts(x, columns).tobytes() for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary())], names=["known_id", "label", "terms"])

    texts = docs.select(F.col(id_col).alias("known_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "known_id").select("known_id", "label", "text")
    # one row per labelled id, also where the documents repeat it
    fields = chosen.schema["known_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"known_id {fields}, label int, terms binary").groupBy("known_id").agg(F.max("label").alias("label"), F.min("terms").alias("terms"))
    rows = rows.orderBy(*order).limit(2 * sample_rows)

    # the sample is bounded, so one task can hold it; the driver sees only axes and projected vectors
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, own = [], []
        for batch in batches:
            terms += batch.column(1).to_pylist()
            own += batch.column(0).to_pylist()
        if own:
            made = Voters.fit(np.frombuffer(b"".join(terms), np.float32).reshape(len(own), columns), np.array(own, np.float32), dims, nearest)
            values = [x.tobytes() for x in (made.idf, made.axes, made.vectors, made.labels)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in values], names=["idf", "axes", "vectors", "labels"])

    made = rows.select("label", "terms").coalesce(1).mapInArrow(fit, "idf binary, axes binary, vectors binary, labels binary").first()
    if made is None:
        return Voters.fit(np.zeros((0, columns), np.float32), np.zeros(0, np.float32), dims, nearest)
    idf, axes, vectors, own = (np.frombuffer(x, np.float32) for x in made)
    return Voters(idf, axes.reshape(columns, -1), vectors.reshape(len(own), -1), own, nearest)


def score_quality(docs: DataFrame, voters: Voters, cut: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted per input row, plus the columns named in ``keep`` (before the others).

    The score reads the text alone. Null counts as the empty text; texts of less than two bytes get the sample's share of label 1. Rows
    that repeat an id are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(voters)
    columns = len(voters.idf)
    keep = keep or []
    body = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("doc_id"), (remainder(id_col, folds) == 0).alias("held_out"),
                       text_of(text_col).alias("text"))
    fields = [f for f in body.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            scores = np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                part = texts.slice(at, BLOCK).to_pylist()
                scores[at : at + BLOCK] = shared.value.scores(np.array([term_counts(x, columns) for x in part], np.float32).reshape(len(part), columns))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                                             names=[*(f.name for f in fields), "score", "predicted"])

    scored = body.mapInArrow(run, schema)
    return scored.select(*[F.col(f"k{i}").alias(f"kept_{c}") for i, c in enumerate(keep)], "doc_id", "held_out", "score", "predicted")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, voters from ``labels``."""
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score_quality(docs, fit_voters(docs, spark.read.parquet(f"{folder}/labels.parquet")))
