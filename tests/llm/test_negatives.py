"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectare.llm.negatives import angles_to, hard_negatives, score_bounds

SCHEMA = "vec_id bigint, embedding array<double>, label int, v int, rid string"


def table(seed=7, n=360, dims=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims)) * 2
    x = np.round(centres[r.integers(0, 5, n)] + r.normal(size=(n, dims)), 1)
    x[60:180] = x[60]  # a third of all rows are one vector, with several labels
    labels = r.integers(0, 3, n)
    rows = [(i, x[i].tolist(), int(labels[i]), 1, "x") for i in range(n)]
    rows += [(n, None, 1, 1, "x"), (n + 1, [1.0, None] + [0.0] * (dims - 2), 1, 1, "x"), (n + 2, [float("nan")] * dims, 1, 1, "x"), (n + 3, [1.0] * dims, None, 1, "x"),
             (None, [1.0] * dims, 1, 1, "x"), (400, [5.0, 5.0], 1, 1, "x"), (401, [4.0, 5.0], 1, 1, "x"), (402, [5.0, 4.9], 2, 1, "x"), (403, [], 2, 1, "x"), (60, x[60].tolist(), 2, 1, "x"),
             (405, [0.0] * dims, 0, 1, "x"), (420, [0.0] * dims, 0, 1, "x")]
    return rows


def brute(rows, every, positives, negatives, low, high, scale):
    good = [(i, [int(np.floor(scale * c)) for c in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for at, (i, v, y) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, k, z) for k, (j, w, z) in enumerate(good) if k != at and len(w) == len(v))
        for p, pid, _, _ in [s for s in scored if s[3] == y][:positives]:
            found = [(s, j) for s, j, _, z in scored if z != y and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("numbers,parts,regions,scale", [(1 << 18, 4096, 16384, 256), (120, 3, 16384, 256), (120, 3, 4, 256), (120, 5, 9, 2**27)])
def test_equals_all_pairs(spark, numbers, parts, regions, scale):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives(df, F.col("vec_id") % 20 == 0, block_numbers=numbers, anchors_per_part=parts, max_regions=regions, scale=scale).collect()
    want = brute(rows, 20, 5, 5, 80, 100, scale)
    assert len(want) > 200 and sorted(tuple(x) for x in got) == want


def test_other_windows(spark):
    rows = table(8, 150, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=7, low=33, high=121, block_numbers=90).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 10, 2, 7, 33, 121, 256)


def test_edges(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    none = F.col("vec_id") % 20 == 0
    assert hard_negatives(df.where("vec_id < 0"), none).count() == 0
    assert hard_negatives(df.where("vec_id = 20"), none).count() == 0
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives(df.where("label = 1"), none).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    for spread in (1.0, 1e-4, 0.0):
        x = np.concatenate([r.normal(size=(200, 8)), 3 + spread * r.normal(size=(200, 8)), np.zeros((1, 8))]) * 100
        norms = np.linalg.norm(x, axis=1)
        angles = angles_to(x, norms, r.normal(size=(5, 8)))
        least, most = score_bounds(norms[:50], angles[:50], norms, norms, angles, angles)
        scores = x[:50] @ x.T
        assert (least <= scores).all() and (scores <= most).all()
        boxes = score_bounds(norms[:50], angles[:50], norms[None, 50:].min(1), norms[None, 50:].max(1), angles[None, 50:].min(1), angles[None, 50:].max(1))
        assert (boxes[0][:, 0] <= scores[:, 50:].min(1)).all() and (boxes[1][:, 0] >= scores[:, 50:].max(1)).all()
