"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row r of n stands at the fraction (2r - 1) / 2n. Sorted by that fraction,
every stretch of the whole holds each source in its share, so equal cuts give shards that match the mixture.

Ranks are taken without ordering a whole source in one task: rows fall into cells of the hash (then of the fraction), rows before a
cell come from the cells' counts, and only a cell is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, prepare, staged, text_of, with_row_key

MIN_CELLS, MAX_CELLS = 256, 65536


def interleave_shards(docs: DataFrame, shards: int = 16, seed: int = 42, rows_per_cell: int = 100_000, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard per input row, under the law ``rows``.

    Shard sizes differ by one row at most. Null sources are one source of their own; a null id is shuffled as the empty text; rows with
    the same id are ordered by their place in the input. An empty table gives no rows. The number of cells follows the row count
    (``rows_per_cell``) between fixed ends and only spreads the work: it never changes a rank.
    """
    prepare(docs.sparkSession)
    text = F.encode(text_of(text_col), "UTF-8")
    mixed = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8"))
    rows = staged(with_row_key(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), mixed.alias("mixed"),
    )), "shard-rows")
    total = rows.count()
    cells = min(MAX_CELLS, max(MIN_CELLS, parts_for(total, rows_per_cell)))
    cell = F.floor(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("bigint") * cells / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("cell", cell).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))

    of_source = Window.partitionBy("key")
    counted = (
        rows.groupBy("key", "cell").agg(F.count("*").alias("n"))
        .select("key", "cell", F.sum("n").over(of_source).alias("n_source"),
                (F.sum("n").over(of_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    )
    in_cell = Window.partitionBy("key", "cell").orderBy("mixed", F.col("doc_id").asc_nulls_last(), "rid")
    ranked = staged(
        rows.join(counted, ["key", "cell"])
        .withColumn("rank", F.col("before") + F.row_number().over(in_cell))
        .withColumn("place", (F.col("rank") * 2 - 1).cast("double") / (F.col("n_source") * 2).cast("double"))
        .select("doc_id", "source", "key", "size", "text_crc32", "rank", "place", F.floor(F.col("place") * cells).cast("int").alias("stretch")),
        "shard-ranked",
    )
    # at most MAX_CELLS counts meet in this one window
    ahead = ranked.groupBy("stretch").agg(F.count("*").alias("n")).select(
        "stretch", (F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    in_stretch = Window.partitionBy("stretch").orderBy("place", "key", "rank")
    at = ranked.join(ahead, "stretch").withColumn("at", F.col("ahead") + F.row_number().over(in_stretch) - 1)
    n = F.lit(max(total, 1)).cast("bigint")
    shard = F.expr(f"at * {shards} div {max(total, 1)}")
    first = F.ceil((F.col("shard") * n).cast("decimal(38,0)") / F.lit(shards))
    return at.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - first.cast("bigint")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents into 16 shards."""
    return interleave_shards(spark.read.parquet(f"{folder}/documents.parquet"), 16)


# DuckDB has no crc32: the checksum is folded over the bytes with the usual table of the reflected polynomial
SQL = """
WITH RECURSIVE poly(i, k, c) AS (
  SELECT range::bigint, 0, range::bigint FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
hexed AS (SELECT doc_id, source, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT doc_id, source, (strlen(x) + 1)::bigint AS size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, tab),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || coalesce(doc_id::varchar, '')), doc_id) AS r,
                  count(*) OVER (PARTITION BY source) AS n FROM summed),
ordered AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::double / (2 * n)::double, coalesce('s' || source, ''), r) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, (p * 16 // total)::int AS shard,
       p - (((p * 16 // total) * total + 15) // 16) AS slot, NULL::int AS grown_shard FROM ordered
"""
