"""Context-tree weighting of bytes: the counting and mixing, on arrays.

A byte is eight binary decisions. Each decision (node 1 to 255 of the byte's binary tree) has its own context tree over the preceding
bytes; every context keeps how often 0 and 1 followed, its Krichevsky-Trofimov estimate, and the weight that the estimate has against
the mixture of its longer contexts.

A key holds the context and the byte that followed it: nearest context byte first (most significant), the byte itself last.
"""

from __future__ import annotations

import numpy as np

HALF = np.log(0.5)
_small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4095) + 0.5))])
_steps = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _log_rising(n: np.ndarray, base: float, table: np.ndarray) -> np.ndarray:
    """log of base (base + 1) ... (base + n - 1)."""
    x = np.maximum(n, 1) + base
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    start = 0.5 * np.log(np.pi) if base == 0.5 else 0.0
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], far - start)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the estimate's probability of a sequence with so many zeros and ones."""
    return _log_rising(zeros, 0.5, _small) + _log_rising(ones, 0.5, _small) - _log_rising(zeros + ones, 1.0, _steps)


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of the values over each."""
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], [v[order] for v in values]
    if not len(keys):
        return [keys, *values]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[starts], *(np.add.reduceat(v, starts) for v in values)]


def keys_of(data: np.ndarray, depth: int) -> np.ndarray:
    """Keys of every byte from position ``depth`` on."""
    x, n = data.astype(np.uint64), len(data)
    out = x[depth:].copy()
    for back in range(1, depth + 1):
        out |= x[depth - back : n - back] << np.uint64(8 * (depth - back + 1))
    return out


class Level:
    """All decisions of the contexts of one depth: sorted (context, node) with counts, and what mixing them needs."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: sum of the log weighted probabilities of the longer contexts; None at full depth."""
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log_weighted, self.trust = own, np.ones(len(nodes))
        else:
            self.log_weighted = np.logaddexp(HALF + own, HALF + below)
            self.trust = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    @classmethod
    def of_counts(cls, keys: np.ndarray, counts: np.ndarray, below: Level | None) -> Level:
        """From sorted (context, byte) keys."""
        nodes, zeros, ones = [], [], []
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        for bit in range(8):
            node = context << np.uint64(8) | np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
            one = (byte >> np.uint64(7 - bit)) & np.uint64(1)
            own, n0, n1 = summed(node, np.where(one == 0, counts, 0), np.where(one == 1, counts, 0))
            nodes.append(own)
            zeros.append(n0)
            ones.append(n1)
        nodes, zeros, ones = summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))
        return cls(nodes, zeros, ones, None if below is None else below.up(nodes))

    def up(self, nodes: np.ndarray) -> np.ndarray:
        """Sums of the log weighted probabilities by the next shorter context, in the order of its ``nodes``."""
        shorter = (self.nodes >> np.uint64(16) << np.uint64(8)) | (self.nodes & np.uint64(255))
        found, sums = summed(shorter, self.log_weighted)
        out = np.zeros(len(nodes))
        out[np.searchsorted(nodes, found)] = sums
        return out

    def mix(self, node: np.ndarray, one: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bit ``one`` at each ``node``; nan where training never came to it. ``deeper``: that of the longer context."""
        if not len(self.nodes):
            return np.full(len(node), np.nan)
        at = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
        zeros, ones = self.zeros[at], self.ones[at]
        seen = (self.nodes[at] == node) & (zeros + ones > 0)
        own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if deeper is not None:
            own = np.where(np.isnan(deeper), own, self.trust[at] * own + (1 - self.trust[at]) * deeper)
        return np.where(seen, own, np.nan)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels of depth ``least`` to ``depth`` from sorted keys of full depth."""
    out: list[Level] = []
    for d in range(depth, least - 1, -1):
        if d < depth:
            shorter = (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))
            keys, counts = summed(shorter, counts)
        out.insert(0, Level.of_counts(keys, counts, out[0] if out else None))
    return out


def log10_of(keys: np.ndarray, tree: list[Level], depth: int) -> np.ndarray:
    """log10 of the mixed probability of each key's byte in its context; ``tree``: levels of depth 0 to ``depth``."""
    total, byte = np.zeros(len(keys)), keys & np.uint64(255)
    for bit in range(8):
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        node = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
        deeper = None
        for d in range(depth, -1, -1):
            context = keys >> np.uint64(8 * (depth - d + 1)) if depth - d + 1 < 8 else np.zeros(len(keys), np.uint64)
            deeper = tree[d].mix(context << np.uint64(8) | node, one, deeper)
        total += np.log10(np.where(np.isnan(deeper), 0.5, deeper))
    return total
