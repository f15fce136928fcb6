"""Periodic runs of words by grammar compression.

Word ids are compressed by Re-Pair: the most frequent pair becomes a rule, until no pair repeats; what is left is closed by a balanced
tree of further rules. Every run crosses the boundary between the two sides of exactly one lowest rule in the derivation, so runs
across each rule's boundary are found once, on the rule's own expansion (longest common extensions to both sides for every period), and
then translated to all places where the rule is derived; intervals of one period that meet are merged into maximal ones.

A run at least three periods and 24 words long holds no group of eight words that stands only once in the text. Stretches between such
groups are the only input of the grammar; a text without them has no run. Work grows as n log n with the words of a text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat as again

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_of

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
GROUP = 8  # words: every group of so many inside a run repeats, see least_length
CHUNK_BYTES = 1 << 22


class Grammar:
    """Rules (left, right) over terminals 0 … n_terminals - 1; ``root`` derives the whole sequence."""

    def __init__(self, sequence: list[int]):
        self.text = sequence
        self.first_rule = max(sequence) + 1
        self.rules: list[tuple[int, int]] = []
        self.root = self._close(self._pair(sequence))
        self._measure()

    def _pair(self, sequence: list[int]) -> list[int]:
        """Re-Pair; returns what is left of the sequence when no pair repeats."""
        n = len(sequence)
        symbol, after, before = list(sequence), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
        count = {pair: len(at) for pair, at in places.items()}
        heap = [(-c, at[0], pair) for (pair, at), c in zip(places.items(), count.values()) if c > 1]
        heapq.heapify(heap)
        while heap:
            c, first, pair = heapq.heappop(heap)
            now = count.get(pair, 0)
            if now < 2:
                continue
            if now != -c:
                heapq.heappush(heap, (-now, first, pair))
                continue
            left, right = pair
            # overlapping places of a pair of equals count as one
            at, end = [], -1
            for i in sorted(places.pop(pair)):
                if i >= end and symbol[i] == left and after[i] < n and symbol[after[i]] == right:
                    at.append(i)
                    end = after[after[i]] if left == right else after[i]
            del count[pair]
            if len(at) < 2:
                continue
            rule = self.first_rule + len(self.rules)
            self.rules.append(pair)
            fresh = set()
            for i in at:
                j = after[i]
                k, h = after[j], before[i]
                if h >= 0:
                    old = (symbol[h], left)
                    if old in count:
                        count[old] -= 1
                    new = (symbol[h], rule)
                    places.setdefault(new, []).append(h)
                    count[new] = count.get(new, 0) + 1
                    fresh.add(new)
                if k < n:
                    old = (right, symbol[k])
                    if old in count:
                        count[old] -= 1
                    new = (rule, symbol[k])
                    places.setdefault(new, []).append(i)
                    count[new] = count.get(new, 0) + 1
                    fresh.add(new)
                    before[k] = i
                symbol[i], symbol[j], after[i] = rule, -1, k
            for new in fresh:
                if count[new] > 1:
                    heapq.heappush(heap, (-count[new], places[new][0], new))
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = after[i]
        return out

    def _close(self, level: list[int]) -> int:
        while len(level) > 1:
            above = []
            for i in range(0, len(level) - 1, 2):
                above.append(self.first_rule + len(self.rules))
                self.rules.append((level[i], level[i + 1]))
            level = above + level[len(level) & ~1:]
        return level[0]

    def _measure(self) -> None:
        """Length of every rule's expansion and one place where it stands."""
        base, self.length = self.first_rule, []
        size = lambda s: 1 if s < base else self.length[s - base]
        for left, right in self.rules:
            self.length.append(size(left) + size(right))
        self.place = [-1] * len(self.rules)
        if self.root >= base:
            self.place[self.root - base] = 0
        # a rule is made after its sides, so from the last rule down every place is known when it is needed
        for r in range(len(self.rules) - 1, -1, -1):
            left, right = self.rules[r]
            for side, at in ((left, self.place[r]), (right, self.place[r] + size(left))):
                if side >= base:
                    self.place[side - base] = at

    def split(self, rule: int) -> int:
        left = self.rules[rule][0]
        return 1 if left < self.first_rule else self.length[left - self.first_rule]


def _prefixes(s: list[int], upto: int) -> list[int]:
    """Length of the longest common prefix of s and s[i:], for i below ``upto`` (entry 0: all of s)."""
    n = len(s)
    z = [0] * upto
    z[0] = n
    low = high = 0
    for i in range(1, upto):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def across(left: list[int], right: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period), relative to left + right: all maximal intervals across the boundary whose smallest period fits ``times`` times."""
    a, b, found = len(left), len(right), []
    whole = left + right
    for mirrored in (False, True):
        # mirrored, the period is laid to the left of the boundary instead of to its right
        u, v = (left, right) if not mirrored else (right[::-1], left[::-1])
        m = len(v)
        top = min(m, len(whole) // times)
        if top < 1:
            continue
        onward = _prefixes(v, min(m, top + 1))
        reach = np.array(onward[1:] + [0] * (top + 1 - len(onward)), np.int64)
        # longest common suffix of u and u + v[:q]
        back = _prefixes(u[::-1] + [-1] + (u + v[:top])[::-1], len(u) + 1 + top)
        joined = np.array(back[:len(u):-1], np.int64)
        q = np.arange(1, top + 1)
        hit = np.nonzero((reach + joined + q >= np.maximum(least, times * q)))[0]
        for x in hit.tolist():
            begin, end = a - int(joined[x]), a + x + 1 + int(reach[x])
            if mirrored:
                begin, end = len(whole) - (b + x + 1 + int(reach[x])), len(whole) - (b - int(joined[x]))
            found.append((x + 1, begin, end))
    out: list[tuple[int, int, int]] = []
    for q, begin, end in sorted(set(found)):
        # an interval inside another one with a shorter period has that period
        if not any(s <= begin and end <= e for s, e, _ in out):
            out.append((begin, end, q))
    return out


def _may_cross(grams: np.ndarray, start: int, split: int, end: int) -> bool:
    """Whether the four words after the boundary, or those before it, stand again on their side: else no run crosses it."""
    at = start + split
    if at + 4 < end and (grams[at + 1:end - 3] == grams[at]).any():
        return True
    return split > 4 and bool((grams[start:at - 4] == grams[at - 4]).any())


def runs_of(ids: list[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in a sequence of ids, by start, then period: see the module's text."""
    if len(ids) < least:
        return []
    grammar = Grammar(ids)
    text, base = grammar.text, grammar.first_rule
    x = np.array(text, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        two = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
        grams = two[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]
    own: list[list[tuple[int, int, int]]] = []
    below: list[bool] = []  # whether the rule derives a run
    for r, (left, right) in enumerate(grammar.rules):
        found = []
        if grammar.length[r] >= least:
            start, split = grammar.place[r], grammar.split(r)
            end = start + grammar.length[r]
            if _may_cross(grams, start, split, end):
                found = across(text[start:start + split], text[start + split:end], least, times)
        own.append(found)
        below.append(bool(found) or (left >= base and below[left - base]) or (right >= base and below[right - base]))
    pieces: dict[int, list[tuple[int, int]]] = {}
    stack = [(grammar.root, 0)] if grammar.root >= base else []
    while stack:
        symbol, at = stack.pop()
        r = symbol - base
        if symbol < base or not below[r]:
            continue
        for start, end, q in own[r]:
            pieces.setdefault(q, []).append((at + start, at + end))
        left, right = grammar.rules[r]
        stack += [(right, at + grammar.split(r)), (left, at)]
    out = []
    for q, spans in pieces.items():
        spans.sort(key=lambda s: (s[0], -s[1]))
        start, end = spans[0]
        for s, e in spans[1:]:
            if e <= end:
                continue
            if end - s >= q:
                end = e
            else:
                out.append((start, end, q))
                start, end = s, e
        out.append((start, end, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which every group of words repeats somewhere in the text and that are long enough."""
    n = len(ids)
    if n < least:
        return []
    key, width = ids.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while width < GROUP:
            key = (key[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ (key[width:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + key[width:] * np.uint64(0x94D049BB133111EB)
            width *= 2
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(counts) == len(key):
        return []
    twice = np.concatenate(([False], counts[at] > 1, [False]))
    edge = np.nonzero(twice[1:] != twice[:-1])[0]
    return [(s, e + GROUP - 1) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s + GROUP - 1 >= least]


def word_runs(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a list of words, by start, then period."""
    if len(words) < least:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    kept = stretches(ids, least)
    if not kept:
        return []
    # a number of its own between stretches: no pair and no run reaches across it
    sequence: list[int] = []
    starts = []
    for i, (s, e) in enumerate(kept):
        starts.append((len(sequence), s))
        sequence += ids[s:e].tolist() + [len(number) + i]
    out, at = [], 0
    for start, end, q in runs_of(sequence, least, times):
        while at + 1 < len(starts) and starts[at + 1][0] <= start:
            at += 1
        out.append((start - starts[at][0] + starts[at][1], end - start, q))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > at:
            out += words[at:max(start, at)]
            at = end
    return out + words[at:]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text",
                  reword: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the text without repeats, words joined by one space) per row.

    A run is a maximal stretch of words with smallest period q, at least max(``least``, ``times`` * q) words long; ``least`` must be 24 or
    more and ``times`` 3 or more, so that groups of eight words repeat inside a run. Null and empty texts have no words. Repeated rows and
    ids are rows of their own; null ids stay null. ``reword`` may change the words of a text (given its id as text, empty for null) before
    the search. An empty table gives no rows. A task holds one text and its grammar at a time beside an Arrow batch of texts.
    """
    if least < 24 or times < 3:
        raise ValueError("least must be 24 or more and times 3 or more")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_of(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, held, done = ([], [], []), 0, 0
            for i, (name, text) in enumerate(zip(batch.column(1), batch.column(2))):
                words = text.as_buffer().to_pybytes().split()
                if reword:
                    words = reword(name.as_py(), words)
                runs = word_runs(words, least, times)
                columns[0].append(len(words))
                columns[1].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                columns[2].append(b" ".join(collapsed(words, runs)))
                held += len(columns[2][-1])
                if held > CHUNK_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done, i + 1 - done), pa.array(columns[0], pa.int64()), pa.array(columns[1], RUNS), pa.array(columns[2], pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed"])
                    columns, held, done = ([], [], []), 0, i + 1

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def echoed(name: str, words: list[bytes]) -> list[bytes]:
    """Every tenth text, by the checksum of its id, ends in repeats of one stretch of its own words: the stated input of the query."""
    h, n = zlib.crc32(name.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + [w for part in again(unit, -(-(n - a) // p)) for w in part][:n - a]


def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of all documents' texts, a tenth of which end in repeats."""
    found = periodic_runs(spark.read.parquet(f"{folder}/documents.parquet"), reword=echoed)
    # lengths over periods are compared as whole numbers: 128 bits hold length * other period
    ahead = lambda x, y: (x["length"].cast("decimal(19,0)") * y["period"]) > (y["length"].cast("decimal(19,0)") * x["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(ahead(x, acc), x).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(F.array_join(line, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
