"""Sharding, top-k search and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from hectare.llm import queries
from hectare.llm.sharding import interleave_shards
from hectare.llm.topk import Tree, exact_topk


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_query_matches_its_sql(spark, small, name):
    result = compare(spark, connect(small), queries.QUERIES[name], queries.ORACLE.get(name), small)
    assert result.startswith("ok" if name in queries.ORACLE else "ran"), result


def test_shards(docs, rows, nothing):
    got = interleave_shards(docs, 7).collect()
    assert len(got) == len(rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    sizes = [len(v) for v in slots.values()]
    assert set(slots) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mixture = Counter(x.source for x in got)
    for source, n in mixture.items():
        per = [sum(x.source == source and x.shard == s for x in got) for s in range(7)]
        assert max(abs(p - n / 7) for p in per) <= 2
    assert interleave_shards(nothing, 7).count() == 0


def test_shards_do_not_depend_on_the_layout(docs):
    key = lambda df: sorted(map(str, interleave_shards(df, 5, rows_per_cell=1).select("doc_id", "text_crc32", "shard").where("doc_id <> 3").collect()))
    distinct = docs.dropDuplicates(["doc_id"])
    assert key(distinct.repartition(1)) == key(distinct.repartition(6, "text"))


@pytest.mark.parametrize("shard_rows,parts,scale", [(10_000, 1000, 256), (60, 5, 256), (60, 5, 2**27)])
def test_topk_equals_brute_force(spark, shard_rows, parts, scale):
    r = np.random.default_rng(3)
    vectors = np.round(r.normal(size=(400, 6)), 1)
    vectors[50:120] = vectors[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (404, [5.0, 5.0]), (405, []), (50, vectors[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for x in exact_topk(df, F.col("vec_id") % 50 == 0, scale=scale, shard_rows=shard_rows, queries_per_part=parts, leaf=8).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for at, (i, v) in enumerate(good):
        if i % 50 == 0 and i != 50 and len(v) == 6:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for k, (j, w) in enumerate(good) if k != at and len(w) == 6)[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert len(got[50]) == 10 and 400 not in got
    assert exact_topk(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_topk(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).count() == 2


def test_tree_boxes_are_tight():
    r = np.random.default_rng(5)
    points = r.integers(-9, 9, (300, 4))
    tree = Tree.build(np.arange(300), np.arange(300), points, 16)
    for (start, end, left, right), low, high in zip(tree.spans, tree.low, tree.high):
        own = tree.points[start:end]
        assert (own.min(axis=0) == low).all() and (own.max(axis=0) == high).all()
        assert (left < 0) == (right < 0) and (left >= 0 or end - start <= 16 or (low == high).all())


def test_pipeline(spark, small):
    """Every stage keeps rows of the one before, and takes effect; the last one packs all that is left."""
    from hectare.llm.common import staged

    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes, texts = [docs.count()], []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "passages", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, small), name)
        assert docs.dtypes == before.dtypes
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
        texts.append(docs.agg(F.sum("n_chars")).first()[0])
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] > 0.5 * sizes[0]
    assert texts == sorted(texts, reverse=True)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == {x.doc_id for x in docs.collect()}
    again = corpus_pipeline.run(spark, small)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert packed.select(columns).exceptAll(again.select(columns)).count() == 0 and again.count() == packed.count()


def test_pipeline_edges(spark, docs, nothing, small):
    from hectare.llm.common import staged

    for start in (docs, nothing):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            frame = staged(stage(spark, frame, small), name)
        assert (frame.count() > 0) == (start is docs)


def test_only_the_entry_knows_the_folder():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in [*(root / "hectare").rglob("*.py"), *root.glob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b|corpus_pipeline", path.read_text()), path


