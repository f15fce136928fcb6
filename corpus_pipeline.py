"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hectare.llm.common import prepare, staged
from hectare.llm.line_dedup import dedup_lines
from hectare.llm.near_dedup import without_near_duplicates
from hectare.llm.packing import pack_documents
from hectare.llm.quality import fit_voters, score_quality
from hectare.llm.suffix_dedup import marked, repeated_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, prefix: str, text: str | None = None) -> DataFrame:
    """The columns of ``documents`` from a struct or prefix, with a new text and its length where one is given."""
    columns = {c: F.col(f"{prefix}{c}") for c in COLUMNS}
    if text:
        columns |= {"text": F.col(text), "n_chars": F.length(text).cast(df.select(columns["n_chars"]).schema[0].dataType)}
    return df.select(*[column.alias(c) for c, column in columns.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote good; voters are fitted on these documents and ``labels``."""
    voters = fit_voters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(score_quality(docs, voters, keep=COLUMNS).where("predicted = 1"), "kept_")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere already; those of which nothing is left go, empty ones stay."""
    left = dedup_lines(docs.select(*COLUMNS)).where("n_kept > 0 OR n_lines = 0")
    return _documents(left, "document.", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return without_near_duplicates(docs.select(*COLUMNS), percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that stand at an earlier place already."""
    docs = docs.select(*COLUMNS)
    return _documents(marked(docs, repeated_passages(docs)), "document.", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    path = public_tokenizers.path
    return pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]
# a classifier, MinHash and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next one reads it."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
