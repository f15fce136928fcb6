"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the table holds the one token with which the prefix's encoding ends. A token may end a prefix if the last
token of what precedes it may stand before it, and two tokens may stand side by side exactly if merging their joined bytes gives the
two again. Appending bytes only adds entries; after an edit the entries before it stay and the rest is filled again only until the
table has come back into step with the old one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_of

CACHED = 1_000_000
PAIRS = 1_600_000
CHUNK = 1 << 20
SHORT = (2, 1)


class Vocabulary:
    """Ranks of byte strings, as read from a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        # lengths of the tokens to try for the last three bytes, longest first
        self.lengths = {last: (*sorted(x, reverse=True), 2, 1) for last, x in lengths.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a short byte string by its merges; used on one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.bytes_of) + 1_000_000_000), i) for i in range(len(parts) - 1))
            if rank not in self.bytes_of:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start); known pairs are looked up under ``left << 32 | right``."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        joined = (self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[right]
        found = self.pairs[left << 32 | right] = self.merged(joined) == ([left, right] if left >= 0 else [right])
        return found


class Prefixes:
    """The encoding of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _endings(self, start: int, end: int) -> Iterator[int]:
        """The last token of every prefix that ends after ``start`` and up to ``end``; each must be stored before the next is asked for."""
        data, last, vocabulary = self.data, self.last, self.vocabulary
        lengths, rank_of, pair_of = vocabulary.lengths.get, vocabulary.ranks.get, vocabulary.pairs.get
        for at in range(start + 1, end + 1):
            for length in lengths(data[at - 3 if at > 3 else 0 : at], SHORT):
                first = at - length
                if first < 0:
                    continue
                token = rank_of(data[first:at])
                if token is None:
                    continue
                left = last[first - 1] if first else -1
                fits = pair_of(left << 32 | token)
                if vocabulary.beside(left, token) if fits is None else fits:
                    yield token
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        store = self.last.append
        for token in self._endings(start, len(self.data)):
            store(token)

    def change_to(self, data: bytes) -> Prefixes:
        """Go over to other bytes; entries of the common start stay."""
        same = len(commonprefix((self.data, data)))
        self.data = self.data[:same]
        del self.last[same:]
        self.append(data[same:])
        return self

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to end; returns how many entries were filled anew."""
        tail, moved = self.last[end:], len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start:]
        alike = 0
        for at, token in enumerate(self._endings(start, len(self.data)), start):
            self.last.append(token)
            old = at - moved - end
            alike = alike + 1 if at >= start + len(data) and tail[old] == self.last[-1] else 0
            if alike >= self.vocabulary.longest:
                self.last += tail[old + 1 :]
                return at + 1 - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class _Encoded(dict):
    """Piece to its ids as little-endian 32-bit integers; emptied when it has grown too large."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def fill(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet; in sorted order most share their first entries with the one before."""
        new = sorted(pieces.difference(self))
        if len(self) + len(new) > CACHED:
            self.clear()
            new = sorted(pieces)
        table = Prefixes(self.vocabulary)
        for piece in new:
            self[piece] = array("I", table.change_to(piece.encode()).tokens()).tobytes()


_OPEN: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Splits a text by the pattern, encodes every match apart, and turns ids back into bytes."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.read(path)
        self.pieces = regex.compile(pattern).findall
        self.encoded = _Encoded(self.vocabulary)
        self.decoded = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(self.vocabulary.bytes_of, default=-1) + 1)]

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """One per worker."""
        if (path, pattern) not in _OPEN:
            _OPEN[path, pattern] = cls(path, pattern)
        return _OPEN[path, pattern]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, a bounded number of texts at a time."""
        split, size = [], 0
        for at, text in enumerate(texts):
            split.append(self.pieces(text))
            size += len(text)
            if size >= CHUNK or at + 1 == len(texts):
                self.encoded.fill(set(chain.from_iterable(split)))
                for pieces in split:
                    yield b"".join(map(self.encoded.__getitem__, pieces))
                split, size = [], 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids (binary, little-endian 32-bit) per input row.

    Null texts count as empty and give no tokens; rows that repeat an id stay rows of their own; long texts are encoded whole. ``path``
    is a rank file that every worker can open. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, pattern)
        for batch in batches:
            ids = list(encoder.encode(batch.column(1).to_pylist()))
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
            } | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows that hold ids (binary); null ids give a null text."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Encoder.of(path, pattern).decode
        for batch in batches:
            texts = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document by the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
