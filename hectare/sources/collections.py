"""FeatureCollection documents read by many tasks.

A document is one JSON value, often on one line. Spark's text reader cuts it at opening braces, so a file is dealt by byte ranges
like any other text. Whether a range begins inside a string, and how deep, is known from the ranges before it: each is scanned
under both assumptions, the few results per range are chained per file, and a second scan cuts the features out. A feature that runs over
the border of two ranges leaves one piece in each; the pieces are put together by a small join of borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .places import feature_json, features_from_text

# an escaped character, or a sign that changes the state
SIGNS = re.compile(r'\\.|["{}]', re.DOTALL)
FEATURE_DEPTH = 2


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), value: the text between two opening braces, in order within a range."""
    return spark.read.option("lineSep", "{").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _texts(batch: pa.RecordBatch, last: tuple | None) -> Iterator[tuple[tuple, bool, str]]:
    """(range, whether it begins here, text with its brace); the text before a file's first brace is only a byte-order mark or blanks."""
    for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
        here = (file, start)
        yield here, here != last, "" if here != last and start == 0 else "{" + value
        last = here


def _after(text: str, quoted: bool, depth: int) -> tuple[bool, int]:
    for m in SIGNS.finditer(text):
        sign = m.group()
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in "{}":
            depth += 1 if sign == "{" else -1
    return quoted, depth


def _states(ranges: DataFrame) -> DataFrame:
    """file, start, quoted, depth: the state in which each range begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = None, [(False, 0), (True, 0)]
        rows: list[tuple] = []
        for batch in batches:
            for here, begins, text in _texts(batch, last):
                if begins:
                    if last:
                        rows.append((*last, *ends[0], *ends[1]))
                    ends = [(False, 0), (True, 0)]
                ends, last = [_after(text, *e) for e in ends], here
        if last:
            rows.append((*last, *ends[0], *ends[1]))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "q0", "d0", "q1", "d1"), r)) for r in rows], pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("q0", pa.bool_()), ("d0", pa.int64()), ("q1", pa.bool_()), ("d1", pa.int64())]))

    ends = ranges.mapInArrow(run, "file string, start bigint, q0 boolean, d0 bigint, q1 boolean, d1 bigint")
    # one row per byte range: a few hundred for a file of tens of gigabytes
    before = F.collect_list(F.struct("q0", "d0", "q1", "d1")).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    state = F.aggregate(before, F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("bigint").alias("depth")), lambda s, r: F.struct(
        F.when(s["quoted"], r["q1"]).otherwise(r["q0"]).alias("quoted"), (s["depth"] + F.when(s["quoted"], r["d1"]).otherwise(r["d0"])).alias("depth")))
    return ends.select("file", "start", state.alias("s")).select("file", "start", "s.quoted", "s.depth")


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """Features (column ``feature``) of FeatureCollection documents, each file read by as many tasks as it has byte ranges.

    Objects of the document's second level whose type is Feature are features; others (a reference system, say) are not. A null
    geometry stays null. Files without features, and empty files, give no rows. Compressed files are one range each. One feature
    must fit a task.
    """
    ranges = _ranges(spark, path)
    # one small row per byte range of 128 MB or so: some 10 MB for 10 TB
    states = {(r.file, r.start): (r.quoted, r.depth) for r in _states(ranges).collect()}
    shared = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, piece, quoted, depth, cut, opened, order = None, [], [], False, 0, False, False, 0

        def leave() -> None:
            # the range ends inside a feature: what it holds of it is a piece
            if piece:
                found.append((*last, order, "".join(piece), opened, False))

        for batch in batches:
            for here, begins, text in _texts(batch, last):
                if begins:
                    leave()
                    quoted, depth = shared.value[here]
                    piece, order, opened, last = [], 0, False, here
                at = 0
                inside = depth >= FEATURE_DEPTH
                for m in SIGNS.finditer(text):
                    sign = m.group()
                    if sign == '"':
                        quoted = not quoted
                    elif not quoted and sign == "{":
                        depth += 1
                        if depth == FEATURE_DEPTH:
                            at, inside, opened = m.start(), True, True
                    elif not quoted and sign == "}":
                        depth -= 1
                        if depth == FEATURE_DEPTH - 1:
                            piece.append(text[at : m.end()])
                            found.append((*here, order, "".join(piece), opened, True))
                            piece, order, inside, opened = [], order + 1, False, False
                if inside:
                    piece.append(text[at:])
            yield rows(found)
            found = []
        leave()
        yield rows(found)

    fields = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("value", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(fields)], schema=fields)

    cut = ranges.mapInArrow(run, "file string, start bigint, place bigint, value string, opens boolean, closes boolean")
    whole = cut.filter("opens AND closes").select("value")
    # two pieces per range at most
    number = F.count_if("opens").over(Window.partitionBy("file").orderBy("start", "place"))
    pieces = cut.filter("NOT (opens AND closes)").withColumn("number", number)
    ordered = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    joined = pieces.groupBy("file", "number").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("value")).select("value")
    return features_from_text(whole.unionByName(joined).filter(F.get_json_object("value", "$.type") == "Feature"), "value")


def write_collections(df: DataFrame, geometry: Column, props: dict[str, Column], path: str, files: int = 16, by: list[str] | None = None) -> None:
    """Layer as ``files`` FeatureCollection documents (``path/file=<n>``), rows dealt by a hash of ``by`` (all columns).

    Each begins with a feature without geometry and properties. A task writes line by line and holds none of its documents.
    """
    file = F.pmod(F.xxhash64(*(by or df.columns)), F.lit(files)).cast("int")
    spark = df.sparkSession
    empty = feature_json(F.lit(None).cast("string"), {"none": F.lit(None).cast("string")})
    lines = df.select(file.alias("file"), F.lit(1).alias("k"), F.concat(F.lit(","), feature_json(geometry, props)).alias("value"))
    ends = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit('{"type":"FeatureCollection","features":['), empty).alias("value")),
        F.struct(F.lit(2).alias("k"), F.lit("]}").alias("value")))).alias("x")).select("file", "x.*")
    ordered = lines.unionByName(ends).repartition(files, "file").sortWithinPartitions("file", "k")
    ordered.select("file", "value").write.mode("errorifexists").partitionBy("file").text(path)
