"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest, compared with the index by a
sort-merge anti-join (the index side is read in bucket order, without a shuffle) and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BLANK, prepare, staged, text_of, with_row_key


class DigestIndex:
    """A stored set of text digests with the id that was kept for each.

    ``path``    folder of the index; the same folder can be opened again by a later session.
    ``buckets`` fixed when the index is made, and stored with it; by default the session's shuffle partitions, so that batches line up
                with it. Opening an index with another number is refused.
    ``id_type`` SQL type of the document id.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.name = f"digest_index_{uuid.uuid4().hex}"
        about = f"{path}/_buckets"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(about)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            stored = int(spark.read.text(about).first()[0])
            if buckets not in (None, stored):
                raise ValueError(f"this index has {stored} buckets")
            buckets = stored
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(str(buckets)).alias("value")).coalesce(1).write.text(about)
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the rows (digest, keep_id) whose digest is not stored yet. Repeating a batch adds nothing."""
        fresh = groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, digest and code points per row; blanks (space, tab to carriage return) do not count for the digest."""
    text = text_of(text_col)
    return with_row_key(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.encode(F.regexp_replace(text, f"{BLANK}+", ""), "UTF-8"), 256).alias("digest"),
        F.length(text).alias("n_points"),
    ))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts in the batch the row with the most code points stays, then the smallest id (null last), then the first of repeated
    rows. A text the index held before the batch keeps the index's id and no row of the batch stays. ``group_size`` counts the
    batch's rows. Null texts count as empty and are equal to blank ones. An empty batch gives no rows and leaves the index alone.
    """
    prepare(docs.sparkSession)
    rows = staged(digests(docs, id_col, text_col), "digests")
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid")))
    groups = staged(
        rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")),
        "digest-groups",
    )
    index.append(groups, batch)
    stored = index.read().select("digest", F.col("keep_id").alias("stored_id"), "batch")
    settled = staged(
        groups.hint("merge").join(stored.hint("merge"), "digest")
        .select("digest", "group_size", F.col("stored_id").alias("keep_id"), F.when(F.col("batch") == batch, F.col("keep_rid")).alias("keep_rid")),
        "digest-settled",
    )
    # a hot digest is split by the skew join: both sides are shuffled here
    return rows.join(settled, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), id_type=docs.schema["doc_id"].dataType.simpleString())
    return exact_dedup(docs, index, "first")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
