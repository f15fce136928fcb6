"""Vectorised hashing of words, shingles and substrings inside tasks (numpy; one call per chunk of texts)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# texts are hashed about so many bytes at a time: what that takes stays in the cache
CHUNK = 1 << 18
U64 = np.uint64
_rng = np.random.default_rng(20_011)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
FACTORS = _rng.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_powers = {"up": powers(BASE, CHUNK), "down": powers(INVERSE, CHUNK)}


def _powers_of(kind: str, n: int) -> np.ndarray:
    if n > len(_powers[kind]):
        return powers(BASE if kind == "up" else INVERSE, n)
    return _powers[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; different values stay different."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def running(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers_of("up", len(values)), out=out[1:])
    return out


def ranges_hashed(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values start to end; equal values give equal hashes wherever they stand."""
    return mixed((run[end] - run[start]) * _powers_of("down", len(run))[start] + (end - start).astype(U64) * FACTORS[-1])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first position, texts) of about CHUNK bytes, at least one text each."""
    at, size, first = 0, 0, 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > CHUNK:
            yield first, texts[first:at]
            first, size = at, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: hash, first byte and end within their text; and where each text's words begin (one more entry)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    blank = IS_BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    hashes = ranges_hashed(running(LETTER[data]), start, end)
    bounds = np.searchsorted(start, begins)
    base = np.repeat(begins[:-1], np.diff(bounds))
    return hashes, start - base, end - base, bounds


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row."""
    total = len(hashes) - n + 1
    out = np.full(total, U64(n), U64) * FACTORS[-2]
    for i in range(n):
        out += hashes[i : i + total] * FACTORS[i]
    return mixed(out)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; all words as one shingle if there are fewer; empty without words."""
    for _, part in chunks(texts):
        hashes, _, _, bounds = words(part)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = hashes[lo:hi]
            yield distinct(shingles(own, min(n, len(own)))) if len(own) else own


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    new = values[1:] != values[:-1]
    return values if new.all() else np.concatenate([values[:1], values[1:][new]])


def common_size(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    both = np.concatenate([one, other])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class MinHash:
    """Minima of ``count`` permutations of 32-bit values, for many segments at once."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.by = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, count, dtype=np.uint32)

    def of(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(segments, count) minima; ``starts`` are the segments' first positions, none of them empty."""
        out, room, short = np.empty((len(starts), len(self.by)), np.uint32), np.empty(len(values), np.uint32), values.astype(np.uint32)
        for k, (a, b) in enumerate(zip(self.by, self.plus)):
            np.multiply(short, a, out=room)
            np.add(room, b, out=room)
            out[:, k] = np.minimum.reduceat(room, starts)
        return out
