"""Repeated passages by sparse suffix arrays.

A passage of ``least`` words is a window. Its minimiser is the smallest hash of a block of words in it, the first of equals, so equal windows
have the same one, wherever they stand. One suffix per minimiser position is kept, with the words that the windows of that minimiser can
reach: ``left`` of it and ``right`` of its block. Suffixes whose block stands once go no further; of suffixes with equal surroundings all but
the first are repeats as a whole.

The others are sorted twice: by the words that follow and by the words that precede. Neighbours in the first order are extended to the right
and to the left; what both sides cover together is a repeat if it has ``least`` words. A suffix shares its longest stretch of words in an order
with a neighbour, so two suffixes with one block are decided by this. Where more share a block, a suffix whose two longest stretches make less
than a passage is done; only the windows of the others are compared with each other by their hashes. Every repeat is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KeyBits, discard, key_bits, prepare, release, rows_among, staged, text_of
from .hashing import chunks, ranges_hashed, running, words
from .order import neighbours_in_order


def minimisers(blocks: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest block hash of some window, the first of equals; of all blocks if there are fewer than a window."""
    if not len(blocks):
        return np.zeros(0, np.int64)
    window = min(window, len(blocks))
    least = np.lib.stride_tricks.sliding_window_view(blocks, window).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


PLACE = ["no_id", "doc_id", "row_key", "pos"]


class Suffixes:
    """The suffixes at minimiser positions of some texts: ``text``, ``pos`` (first window of the minimiser), ``n`` (windows), ``back`` (words from
    there to the suffix), ``own`` (hash of its block) and ``whole`` (hash of all words of its windows)."""

    def __init__(self, texts: list[bytes], least: int, block: int, window: int):
        self.hashes, _, _, bounds = words(texts)
        self.least, self.block, self.run = least, block, running(self.hashes)
        place, wide = np.arange(max(0, len(self.hashes) - block + 1)), 1
        low = ranges_hashed(self.run, place, place + block)
        while wide < window:
            step = min(wide, window - wide)
            less = low[step:] < low[:-step]
            low, place = np.where(less, low[step:], low[:-step]), np.where(less, place[step:], place[:-step])
            wide += step
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        start = np.arange(max(0, len(self.hashes) - least + 1))
        start = start[start + least <= bounds[text[: len(start)] + 1]]
        text, low, place = text[start], low[start], place[start]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(start) else start
        self.begin, self.n, self.at = start[first], np.diff(np.append(first, len(start))), place[first]
        self.text, self.own = text[first], low[first].view(np.int64)
        self.pos, self.back = self.begin - bounds[self.text], self.at - self.begin
        self.whole = ranges_hashed(self.run, self.begin, self.begin + self.n + least - 1).view(np.int64)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, position and hash of every window of the suffixes ``of``."""
        n = self.n[of]
        away = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(self.begin[of], n) + away
        return np.repeat(self.text[of], n), np.repeat(self.pos[of], n) + away, ranges_hashed(self.run, begin, begin + self.least).view(np.int64)

    def contexts(self, of: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Words before the suffixes ``of``, the nearest first, and words after their blocks: four bytes of a word's hash each."""
        code = (self.hashes >> np.uint64(32)).astype(">u4")
        ahead, behind, total = code.tobytes(), code[::-1].tobytes(), len(code)
        begin, at = self.begin[of], self.at[of]
        left = [behind[4 * (total - b) : 4 * (total - a)] for a, b in zip(begin.tolist(), at.tolist())]
        right = [ahead[4 * a : 4 * b] for a, b in zip((at + self.block).tolist(), (begin + self.n[of] + self.least - 1).tolist())]
        return left, right


def common_words(one: bytes, other: bytes) -> int:
    """Length of the longest common prefix, in words of four bytes."""
    n = min(len(one), len(other))
    return (8 * n - (int.from_bytes(one[:n]) ^ int.from_bytes(other[:n])).bit_length()) // 32


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open stretches."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _place_key(row_key, pos):
    """A number for a place, the same in SQL and in numpy; it need not be unique."""
    return row_key ^ (pos.astype(np.int64) << 32) if isinstance(pos, np.ndarray) else row_key.bitwiseXOR(F.shiftleft(pos.cast("bigint"), 32))


def _minimised(body: DataFrame, id_kind: str, least: int, block: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(2).cast(pa.binary()).to_pylist()):
                own = Suffixes(part, least, block, window)
                source = pa.array(own.text + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(source), batch.column(1).take(source), pa.array(own.pos.astype(np.int32)), pa.array(own.n.astype(np.int32)), pa.array(own.own), pa.array(own.whole)],
                    names=["doc_id", "row_key", "pos", "n", "own", "whole"])

    return body.mapInArrow(run, f"doc_id {id_kind}, row_key bigint, pos int, n int, own bigint, whole bigint")


def _suffixes(body: DataFrame, id_kind: str, heads: KeyBits, least: int, block: int, window: int) -> DataFrame:
    """The suffixes of ``heads`` with the words around them; the few others that the bitmap lets through do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_key = batch.column(1).to_numpy()
            for first, part in chunks(batch.column(2).cast(pa.binary()).to_pylist()):
                own = Suffixes(part, least, block, window)
                wanted = np.flatnonzero(heads.among(_place_key(row_key[own.text + first], own.pos)))
                left, right = own.contexts(wanted)
                source = pa.array(own.text[wanted] + first)
                doc_id = batch.column(0).take(source)
                numbers = [pa.array(x[wanted].astype(np.int32)) for x in (own.pos, own.back)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.own[wanted]), doc_id.is_null(), doc_id, batch.column(1).take(source), *numbers, pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["own", *PLACE, "back", "left", "right"])

    return body.mapInArrow(run, f"own bigint, no_id boolean, doc_id {id_kind}, row_key bigint, pos int, back int, left binary, right binary")


def _compared(suffixes: DataFrame, by: str, block: int, least: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours with the same block in the order of the words ``by``, two rows each: own, row_key, pos, back, ``l`` and ``r`` (common words
    before and from the suffix on; 0 if not in ``suffixes``) and ``code`` of the repeat where they make ``least`` words;
    and the stored table behind it.

    Rows are spread by their words too: no task gets all suffixes of a frequent block.
    """
    names = suffixes.columns
    keys = ["own", by, *PLACE]
    ordered = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    side = "own bigint, row_key bigint, pos int, back int, l int, r int, code bigint"
    kind = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in suffixes.schema.fields)

    def place(x: dict) -> tuple:
        return x["no_id"], x["doc_id"], x["row_key"], x["pos"] + x["back"]

    def sides(one: dict, other: dict) -> list[dict]:
        if place(one) == place(other):  # equal rows are one document
            return []
        l = common_words(one["left"], other["left"])
        r = block + common_words(one["right"], other["right"]) if "right" in one else 0
        earlier = one if place(one) < place(other) else other
        out = []
        for x in (one, other):
            code = ((x["pos"] + x["back"] - l) << 32) + 2 * (l + r - least + 1) + (x is not earlier) if l + r >= least else None
            out.append({"own": x["own"], "row_key": x["row_key"], "pos": x["pos"], "back": x["back"], "l": l, "r": r, "code": code})
        return out

    fields = [pa.field("own", pa.int64()), pa.field("row_key", pa.int64()), *[pa.field(x, pa.int32()) for x in ("pos", "back", "l", "r")], pa.field("code", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if last is not None and last["own"] == row["own"]:
                    found += sides(last, row)
                first, last = first or row, row
            yield rows(batch.schema, found, [])
        if first is not None:
            yield rows(batch.schema, [], [first, last])

    def rows(schema: pa.Schema, found: list[dict], ends: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([x[f.name] for x in found] + [None] * len(ends), f.type) for f in fields]
        return pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(found) + ends, pa.struct(list(schema)))], names=[*[f.name for f in fields], "border"])

    found = staged(ordered.mapInArrow(run, f"{side}, border struct<{kind}>"), label)
    # a few rows per partition
    near = Window.partitionBy("own").orderBy(*keys[1:])
    row = F.struct(*names)
    borders = found.where("border IS NOT NULL").select("border.*").distinct().select(row.alias("other"), F.lag(row).over(near).alias("one")).where("one IS NOT NULL")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x for pair in batch.to_pylist() for x in sides(pair["one"], pair["other"])]
            yield pa.RecordBatch.from_pylist(both, pa.schema(fields))

    return found.where("border IS NULL").drop("border").unionByName(borders.mapInArrow(across, side)), found


def _windows(body: DataFrame, id_kind: str, suffixes: KeyBits, least: int, block: int, window: int) -> DataFrame:
    """key and place of the windows of the suffixes among ``suffixes``; the few others that the bitmap lets through do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_key = batch.column(1).to_numpy()
            for first, part in chunks(batch.column(2).cast(pa.binary()).to_pylist()):
                own = Suffixes(part, least, block, window)
                text, pos, key = own.windows(np.flatnonzero(suffixes.among(_place_key(row_key[own.text + first], own.pos))))
                source = pa.array(text + first)
                doc_id = batch.column(0).take(source)
                yield pa.RecordBatch.from_arrays([pa.array(key), doc_id.is_null(), doc_id, batch.column(1).take(source), pa.array(pos.astype(np.int32))], names=["key", *PLACE])

    return body.mapInArrow(run, f"key bigint, no_id boolean, doc_id {id_kind}, row_key bigint, pos int")


def _marks(rows: DataFrame, label: str) -> DataFrame:
    """row_key and code (first window, number of windows, whether later) of both rows of each pair of neighbours with the same key."""
    pairs = neighbours_in_order(rows, ["key", *PLACE], 1, label)
    # equal rows are one document
    pairs = pairs.where("NOT (one.row_key = other.row_key AND one.pos = other.pos)")
    n = "{}.n" if "n" in rows.columns else "1"

    def side(of: str, later: int) -> DataFrame:
        return pairs.selectExpr(f"{of}.row_key", f"shiftleft(cast({of}.pos AS bigint), 32) + 2L * {n.format(of)} + {later} AS code")

    return side("one", 0).union(side("other", 1))


def _spans_of(codes: np.ndarray, least: int) -> list[dict]:
    """Stretches of words of a document from the codes of its repeated windows; a window that is later anywhere is not a first one."""
    start, n, later = codes >> 32, (codes & 0xFFFFFFFF) >> 1, codes & 1 == 1
    end = int((start + n).max())
    marks = np.zeros((2, end + 1), np.int64)
    for row in (0, 1):
        np.add.at(marks[row], start[later == row], 1)
        np.add.at(marks[row], (start + n)[later == row], -1)
    first, again = np.cumsum(marks, axis=1) > 0
    out = []
    for kind, windows in ((False, first & ~again), (True, again)):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], windows, [False]]).astype(np.int8)))
        out += [{"start": a, "end": b, "later": kind} for a, b in merged_spans([(int(a), int(b) + least - 1) for a, b in zip(edges[::2], edges[1::2])])]
    return out


def repeated_passages(docs: DataFrame, least: int = 50, block: int = 16, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, spans (start, end in words; later), one row per document that takes part in a repeat of ``least`` words or more.

    ``later``: the passage stands at an earlier place too (smaller id, null last, then smaller row hash, then position) and is the one to
    remove; where it is false the passage is the first of its kind. Passages are compared by words, so blanks do not count. Repeats inside
    one document count. Rows that agree in id and text are one document. Null and short texts give nothing, an empty table no rows.

    A minimiser is the smallest of ``window`` hashes of ``block`` words; ``window + block - 1`` may not exceed ``least``, so that it lies
    inside a passage. Every repeat is found. Neighbours are extended by 32-bit hashes of words (a border is a word too far out with a chance
    of 2^-32), windows are compared by 64-bit hashes.
    """
    if window + block - 1 > least:
        raise ValueError("window + block - 1 may not exceed least")
    prepare(docs.sparkSession)
    text, shape = text_of(text_col), (least, block, window)
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("text"))
    every = staged(_minimised(body, kind, *shape), "minimised")
    # blocks that stand once go no further
    repeated = key_bits(every.groupBy("own").agg(F.count("*").alias("n")).where("n > 1"), "own")
    kept = rows_among(every, repeated, "own").select(F.col("whole").alias("key"), "own", F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "pos", "n")
    kept = staged(kept, "repeated-blocks")
    discard(every)
    first = kept.groupBy("key").agg(F.min(F.struct(*PLACE, "own")).alias("first"))
    heads = staged(first.select("first.own", _place_key(F.col("first.row_key"), F.col("first.pos")).alias("place")), "heads")
    # a block with one surrounding only is done
    shared = heads.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select("own")
    places = key_bits(heads.join(shared, "own", "left_semi"), "place")
    suffixes = staged(_suffixes(body, kind, places, *shape), "suffixes")
    release(repeated, places)
    forward, one = _compared(suffixes, "right", block, least, "by-following-words")
    backward, other = _compared(suffixes.drop("right"), "left", block, least, "by-preceding-words")
    # more than two suffixes with one block: neighbours are not all pairs
    crowded = suffixes.groupBy("own").agg(F.count("*").alias("n")).where("n > 2").select("own")
    reach = forward.drop("code").union(backward.drop("code")).groupBy("own", "row_key", "pos", "back").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    reach = reach.where(f"l + r >= {least}").join(crowded, "own", "left_semi")
    undecided = key_bits(reach.select(_place_key(F.col("row_key"), F.col("pos")).alias("place")), "place")
    windows = staged(_windows(body, kind, undecided, *shape), "windows")
    release(undecided)
    extended = forward.where("code IS NOT NULL").select("row_key", "code")
    codes = extended.union(_marks(kept.drop("own"), "equal-surroundings")).union(_marks(windows, "equal-windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_spans_of(x.values.to_numpy(), least) for x in batch.column(1)]
            struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("later", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(struct))], names=["row_key", "spans"])

    # what one document takes part in is bounded by its own windows
    spans = codes.groupBy("row_key").agg(F.collect_set("code").alias("codes")).mapInArrow(run, "row_key bigint, spans array<struct<start:int,end:int,later:boolean>>")
    spans = staged(spans, "spans")
    discard(kept, heads, suffixes, one, other, windows)
    return spans


def marked(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its columns as the struct ``document``, its ``text`` without the later occurrences, and ``passages``:
    structs (start, end in code points, n_words, later) of merged stretches."""
    text = text_of(text_col)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    bits = key_bits(spans, "row_key")
    whole = docs.select(columns, F.xxhash64(F.col(id_col), text).alias("row_key"))
    # most documents have no passages and stay out of the join
    own_text = text_of(F.col("document").getField(text_col)).alias("text")
    # merge: see the texts of near-duplicates; one Python step per stage
    joined = rows_among(whole, bits, "row_key").join(spans.hint("merge"), "row_key", "left").select("document", own_text, "spans")
    apart = rows_among(whole, bits, "row_key", among=False).select("document", own_text)
    passage = "struct<start:int,end:int,n_words:int,later:boolean>"
    nothing = F.lit(None).cast(f"array<{passage}>").alias("passages")
    plain = apart.select("document", "text", nothing).unionByName(joined.where("spans IS NULL").select("document", "text", nothing))
    cut = joined.where("spans IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, passages = [], []
            for body, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                _, starts, ends, _ = words([body])
                out, left, rows = [], 0, []
                for later in (True, False):
                    for a, b in merged_spans([(s["start"], s["end"]) for s in own if s["later"] == later]):
                        begin, end = int(starts[a]), int(ends[b - 1])
                        first = len(body[:begin].decode("utf-8", "replace"))
                        rows.append({"start": first, "end": first + len(body[begin:end].decode("utf-8", "replace")), "n_words": b - a, "later": later})
                        if later:
                            out.append(body[left:begin])
                            left = end
                out.append(body[left:])
                texts.append(b"".join(out).decode("utf-8", "replace"))
                passages.append(rows)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("later", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(passages, kind)], names=["document", "text", "passages"])

    schema = f"document {docs.select(columns).schema['document'].dataType.simpleString()}, text string, passages array<{passage}>"
    return plain.unionByName(cut.select("document", "text", "spans").mapInArrow(run, schema))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All passages of 50 words or more that stand in the documents more than once: every occurrence, ``later`` for those to remove."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = marked(docs, repeated_passages(docs)).where("passages IS NOT NULL")
    return found.select(F.col("document.doc_id").alias("doc_id"), F.explode("passages").alias("p")).select(
        "doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.n_words").alias("n_words"), F.col("p.later").alias("later"))
