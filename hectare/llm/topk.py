"""Exact top-k by inner product with KD-trees per shard.

Vectors are cut into shards of bounded size; each shard becomes one KD-tree (median splits on the widest component, tight boxes). A
query walks a tree best node first: the largest inner product a box allows is the node's bound, and nodes whose bound is below the
k-th score found so far are left out. The k-th score of the first shard a query visits is carried to all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, prepare, staged, with_row_key

TREE_SCHEMA = "shard int, dims int, rids binary, ids binary, points binary, spans binary, low binary, high binary"
HIT_SCHEMA = "query_rid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"
EXACT_FLOAT = 2.0**53


class Tree:
    """Nodes in heap order of discovery: row ranges, children and tight boxes over points sorted by leaf."""

    def __init__(self, rids, ids, points, spans, low, high):
        self.rids, self.ids, self.points, self.spans, self.low, self.high = rids, ids, points, spans, low, high

    @classmethod
    def build(cls, rids: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int) -> Tree:
        order, spans, low, high = np.arange(len(rids)), [[0, len(rids), -1, -1]], [], []
        at = 0
        while at < len(spans):
            start, end = spans[at][:2]
            own = points[order[start:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            wide = (high[-1].astype(np.float64) - low[-1]).argmax()
            if end - start > leaf and high[-1][wide] > low[-1][wide]:
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, wide], half, kind="introselect")]
                spans[at][2:] = len(spans), len(spans) + 1
                spans += [[start, start + half, -1, -1], [start + half, end, -1, -1]]
            at += 1
        return cls(rids[order], ids[order], points[order], np.array(spans), np.array(low), np.array(high))

    def row(self, shard: int) -> dict:
        return {"shard": shard, "dims": self.points.shape[1], "rids": self.rids.tobytes(), "ids": self.ids.tobytes(), "points": self.points.tobytes(),
                "spans": self.spans.astype(np.int64).tobytes(), "low": self.low.tobytes(), "high": self.high.tobytes()}

    @classmethod
    def load(cls, row) -> Tree:
        ints = lambda x, *shape: np.frombuffer(x, np.int64).reshape(*shape)
        return cls(ints(row.rids, -1), ints(row.ids, -1), ints(row.points, -1, row.dims), ints(row.spans, -1, 4), ints(row.low, -1, row.dims), ints(row.high, -1, row.dims))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """Yields (query, positions, scores) of every row that can be among the k best and scores at least ``floor``."""
        reach = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if reach < EXACT_FLOAT else np.int64 if reach < 2.0**62 else object
        points, asked, low, high = (x.astype(kind) for x in (self.points, queries, self.low, self.high))
        bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
        for q in range(len(asked)):
            bound, best, kept = bounds[q], [], []
            kth = floor[q]
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heapq.heappop(heap)
                start, end, left, right = self.spans[node]
                if left < 0:
                    scores = points[start:end] @ asked[q]
                    for i in np.nonzero(scores >= kth)[0]:
                        if self.rids[start + i] != own[q]:
                            kept.append((scores[i], start + i))
                            (heapq.heappush if len(best) < k else heapq.heappushpop)(best, scores[i])
                    if len(best) == k:
                        kth = max(kth, best[0])
                else:
                    for child in (left, right):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
            kept = sorted((x for x in kept if x[0] >= kth), key=lambda x: (-x[0], self.ids[x[1]], self.rids[x[1]]))[:k]
            yield q, [x[1] for x in kept], [int(x[0]) for x in kept]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """rid, vec_id and floor(scale * x) per component; vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return with_row_key(vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
    )).withColumn("dims", F.size("v"))


def _hits(tree: Tree, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = []
    queries = np.array(asked["v"].tolist(), np.int64).reshape(len(asked), -1)
    rids, ids, floors = asked["rid"].to_numpy(), asked["vec_id"].to_numpy(), asked["kth"].to_numpy()
    for q, at, scores in tree.search(queries, rids, k, floors):
        rows += [(rids[q], ids[q], tree.rids[p], tree.ids[p], s) for p, s in zip(at, scores)]
    return pd.DataFrame(rows, columns=["query_rid", "query_id", "rid", "vec_id", "score"])


def search_trees(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of every (shard, part of the queries) that ``asked`` names: columns shard, part, dims, rid, vec_id, v, kth."""

    def walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_rid", "query_id", "rid", "vec_id", "score"])
        return _hits(Tree.load(left.iloc[0]), right, k)

    return trees.groupBy("shard", "dims", "part").cogroup(asked.groupBy("shard", "dims", "part")).applyInPandas(walk, HIT_SCHEMA)


def exact_topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = 8192, queries_per_part: int = 16384, leaf: int = 64,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets ``is_query`` the k best other rows by inner product of floor(scale * x).

    Ties go to the smaller vec_id, then to the earlier row. Fewer rows than k: all of them. Rows that repeat an id are rows of their
    own; null ids are dropped, as are null vectors and vectors with null or non-finite components. Vectors of another length than the
    query's are no candidates; empty vectors take no part. An empty table gives no rows. Scores must fit 64 bits. ``shard_rows`` and ``queries_per_part`` bound what
    one task holds and do not change the result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = staged(quantised(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col, scale), "vectors").where("dims > 0")
    shards = parts_for(rows.count(), shard_rows)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))

    def plant(key, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
        return pd.DataFrame([Tree.build(pdf["rid"].to_numpy(), pdf["vec_id"].to_numpy(), points, leaf).row(int(key[0]))])

    trees = staged(rows.groupBy("shard", "dims").applyInPandas(plant, TREE_SCHEMA), "trees")
    asked = rows.where(is_query)
    parts = parts_for(asked.count(), queries_per_part)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(parts)).cast("int"))
    spread = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    # first the query's own shard, for a k-th score to start from; then all the others
    home = staged(search_trees(spread, asked.withColumn("kth", F.lit(float("-inf"))), k), "home-hits")
    kth = home.groupBy("query_rid").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    others = (
        asked.join(kth, asked.rid == kth.query_rid, "left").withColumn("home", F.col("shard"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        .select("shard", "dims", "part", "rid", "vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    )
    hits = home.unionByName(search_trees(spread, others, k))
    first = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return (
        hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best for every vector whose id is divisible by 50."""
    return exact_topk(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
