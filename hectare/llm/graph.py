"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, parts_for, staged


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition: at most one edge per node remains."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame, edges_per_task: int = 250_000) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): for every node that has an edge to another one the smallest node it reaches.

    Edges are first contracted in parts of about ``edges_per_task``, whatever nodes they join; if there is more than one part, the
    large-star and small-star steps then alternate until nothing changes (the rounds grow with the logarithm of the longest chain).
    Self-loops, repeated edges and an empty table are fine.
    """
    first = staged(edges.select("a", "b").where("a <> b").mapInPandas(_local, "a bigint, b bigint"), "edges")
    parts = parts_for(first.count(), edges_per_task)
    edges = staged(first.repartition(parts).mapInPandas(_local, "a bigint, b bigint"), "contracted")
    discard(first)
    if parts == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        # a: any node, b: smaller neighbour. Large star: every larger neighbour goes to the smallest node next to the centre.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = staged(large.distinct(), "large-star")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        old, edges = edges, staged(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        discard(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
