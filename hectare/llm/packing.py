"""Packing of tokenised documents into sequences of bounded length by a grouping genetic algorithm.

A gene is a whole bin. Crossover puts well-filled bins of one parent into the other, removes the bins that now hold an item twice, and
places what was displaced by best fit; mutation empties a few of the least filled bins and places their items again. Pieces are dealt
into regions; every region is bred on several islands, whose best bins move to the next island between the epochs.

Pieces of equal length are alike, so breeding works on how many pieces of each length a region has; rows are put in place afterwards.
"""

from __future__ import annotations

import base64
import pickle
import random
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, prepare, staged, text_of, with_row_key

STABLE_BELOW = "ɐ"
SPECIAL = "<|endoftext|>"


class Tokens:
    """Ids of the byte-level vocabulary as the ``tokenizers`` library gives them.

    Texts of Latin letters go through the faster library over the same ranks; other texts, whose character classes the two libraries
    may take from different Unicode versions, go through ``tokenizers`` itself.
    """

    _open: dict[tuple, Tokens] = {}

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.json_path = json_path
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, *paths: str) -> Tokens:
        if paths not in cls._open:
            cls._open[paths] = cls(*paths)
        return cls._open[paths]

    @cached_property
    def exact(self):
        """Loaded with the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text or (not text.isascii() and max(text) >= STABLE_BELOW):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole up to the limit, else pieces of the limit of which the first may be shorter."""
    if n <= limit:
        return [(0, n)]
    head = n % limit
    return ([(0, head)] if head else []) + [(at, limit) for at in range(head, n, limit)]


def tokenised_pieces(docs: DataFrame, json_path: str, rank_path: str, pattern: str, end_id: int = 2, limit: int = 1024, id_col: str = "doc_id",
                     text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, the ids (binary, little-endian 32-bit) per piece.

    Null texts count as empty: one piece that holds the end id alone. Rows that repeat an id give pieces of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(json_path, rank_path, pattern)
        for batch in batches:
            source, rows, blobs = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array(tokens.ids(text) + [end_id], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), limit)):
                    blob = ids[start : start + length].tobytes()
                    source.append(i)
                    rows.append((piece, start, length, zlib.crc32(blob)))
                    blobs += [blob] * keep_ids
            piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 4).T
            columns = {"doc_id": batch.column(0).take(pa.array(source, pa.int64())), "piece": pa.array(piece.astype(np.int32)),
                       "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc)}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(blobs, pa.binary())} if keep_ids else {}))

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


# --- breeding: a packing is a list of bins, a bin a tuple of lengths in falling order


def best_fit(bins: list[tuple[int, ...]], items: list[int], limit: int) -> list[tuple[int, ...]]:
    """Put each item, in the given order, into the open bin it fits best; a new bin if there is none."""
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    filled = [list(b) for b in bins]
    mask = 0
    for at, b in enumerate(filled):
        if (room := limit - sum(b)) > 0:
            rooms[room].append(at)
            mask |= 1 << room
    for item in items:
        fitting = mask >> item
        if fitting:
            room = item + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            filled[at].append(item)
        else:
            room, at = limit, len(filled)
            filled.append([item])
        if room > item:
            rooms[room - item].append(at)
            mask |= 1 << (room - item)
    return [tuple(sorted(b, reverse=True)) for b in filled]


def worth(bins: list[tuple[int, ...]], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return len(bins), -sum((sum(b) / limit) ** 2 for b in bins)


def crossed(one: list, other: list, have: Counter, limit: int, rng: random.Random) -> list:
    full = [b for b in other if sum(b) >= limit - limit // 64]
    taken = rng.sample(full, rng.randint(0, min(len(full), max(1, len(other) // 3)))) if full else []
    over = Counter(x for b in taken for x in b)
    over.update(x for b in one for x in b)
    over.subtract(have)
    over = +over
    kept, loose = [], []
    order = list(range(len(one)))
    rng.shuffle(order)
    for at in order:
        twice = [x for x in one[at] if over.get(x, 0) > 0] if over else []
        if not twice:
            kept.append(one[at])
            continue
        for x in one[at]:
            if over.get(x, 0) > 0:
                over[x] -= 1
                if not over[x]:
                    del over[x]
            else:
                insort(loose, x)
    return best_fit(kept + taken, loose[::-1], limit)


def mutated(bins: list, limit: int, rng: random.Random) -> list:
    """Empty some of the emptiest bins and a few others, and place their items anew."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    out = set(order[: rng.randint(1, 3)]) | set(rng.sample(order, min(len(order), rng.randint(1, 8))))
    return best_fit([b for i, b in enumerate(bins) if i not in out], sorted((x for i in out for x in bins[i]), reverse=True), limit)


def bred(counts: list[tuple[int, int]], guests: list[list], seed: int, limit: int, size: int, generations: int) -> list[list]:
    """The population after some generations, best first. ``guests``: packings that start with it."""
    rng, have = random.Random(seed), Counter(dict(counts))
    items = sorted(have.elements(), reverse=True)
    least = -(-sum(items) // limit)
    people = list(guests)
    while len(people) < size:
        order = items if not people else sorted(items, key=lambda x: -x * rng.uniform(0.9, 1.1))
        people.append(best_fit([], order, limit))
    ranked = sorted(((worth(p, limit), p) for p in people), key=lambda x: x[0])
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break
        for _ in range(max(1, size // 2)):
            one, other = sorted(rng.sample(range(len(ranked)), min(2, len(ranked)))) if len(ranked) > 1 else (0, 0)
            child = mutated(crossed(ranked[one][1], ranked[other][1], have, limit, rng), limit, rng)
            insort(ranked, (worth(child, limit), child), key=lambda x: x[0])
        del ranked[size:]
    return [p for _, p in ranked]


def assign_sequences(pieces: DataFrame, limit: int = 1024, region_pieces: int = 4000, islands: int = 2, epochs: int = 2, size: int = 4,
                     generations: int = 5, seed: int = 11) -> DataFrame:
    """``pieces`` (columns rid, a key per row, and length, 1 to limit) with sequence_id and offset.

    Every piece is in one sequence, no sequence exceeds the limit. Pieces of the full length have a sequence to themselves. A region
    holds about ``region_pieces`` others, chosen by a hash of rid, so a common length is dealt over all regions. The result for the same
    rows is always the same. No pieces give no rows.
    """
    short = pieces.where(F.col("length") < limit)
    regions = parts_for(short.count(), region_pieces)
    short = short.withColumn("region", F.pmod(F.xxhash64("rid"), F.lit(regions)).cast("int"))
    # at most limit - 1 lengths per region
    counts = short.groupBy("region", "length").agg(F.count("*").alias("n")).groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct("length", "n"))).alias("counts"))
    people = staged(counts.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("guests", F.lit(None).cast("binary")), "islands")
    bred_schema = "region int, island int, counts array<struct<length bigint,n bigint>>, people binary"

    for epoch in range(epochs):

        def epoch_of(frames: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                blobs = []
                for row in pdf.itertuples(index=False):
                    have = [(int(x["length"]), int(x["n"])) for x in row.counts]
                    guests = [] if row.guests is None else pickle.loads(zlib.decompress(row.guests))
                    blobs.append(zlib.compress(pickle.dumps(bred(have, guests, hash((seed, row.region, row.island, epoch)), limit, size, generations)), 1))
                yield pdf[["region", "island", "counts"]].assign(people=blobs)

        # a fixed number of islands per task: their rows are small, the work on them is not
        lands = people.select("region", "island", "counts", "guests").repartition(parts_for(regions * islands, 8), F.col("region"), F.col("island"))
        grown = staged(lands.mapInPandas(epoch_of, bred_schema), "bred")
        if epoch + 1 < epochs:
            # the best packing of each island goes to the next one; its own people stay
            there = grown.select("region", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people").alias("visiting"))

            def welcome(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in frames:
                    own = [pickle.loads(zlib.decompress(x)) for x in pdf["people"]]
                    from_next = [pickle.loads(zlib.decompress(x))[0] for x in pdf["visiting"]]
                    yield pdf[["region", "island", "counts"]].assign(guests=[zlib.compress(pickle.dumps([x, *p[: size - 1]]), 1) for x, p in zip(from_next, own)])

            people = grown.join(there, ["region", "island"]).mapInPandas(welcome, bred_schema.replace("people binary", "guests binary"))

    def layout(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                best = min((pickle.loads(zlib.decompress(x))[0] for x in row.people), key=lambda p: worth(p, limit))
                nth, rows = Counter(), []
                for bin_no, b in enumerate(best):
                    offset = 0
                    for x in b:
                        nth[x] += 1
                        rows.append((row.region, x, nth[x], bin_no, offset))
                        offset += x
                yield pd.DataFrame(rows, columns=["region", "length", "nth", "bin", "offset"])

    # one row per island
    places = grown.groupBy("region").agg(F.collect_list("people").alias("people")).mapInPandas(layout, "region int, length bigint, nth int, bin int, offset bigint")
    nth = F.row_number().over(Window.partitionBy("region", "length").orderBy("rid"))
    packed = short.withColumn("nth", nth).join(places, ["region", "length", "nth"]).drop("nth")
    packed = packed.withColumn("sequence_id", F.col("region").cast("bigint") * F.lit(1 << 24) + F.col("bin")).drop("region", "bin")
    alone = pieces.where(F.col("length") >= limit).withColumns({"offset": F.lit(0).cast("bigint"), "sequence_id": -F.col("rid") - 1})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, json_path: str, rank_path: str, pattern: str, end_id: int = 2, limit: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = True, **breeding) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``keep_ids``, its ids.

    Null and empty texts are one piece with the end id; long texts are cut, never shortened; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    pieces = staged(with_row_key(tokenised_pieces(docs, json_path, rank_path, pattern, end_id, limit, id_col, text_col, keep_ids)), "pieces")
    placed = assign_sequences(pieces.select("rid", "length") if keep_ids else pieces, limit, **breeding)
    if keep_ids:
        placed = pieces.join(placed.drop("length"), "rid")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and the joined ids of every sequence; ``packed`` comes with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"])).alias("ids"))


def op9_packing(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents into sequences of 1024 tokens."""
    import public_tokenizers as files

    docs = spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    return pack_documents(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, keep_ids=False)
