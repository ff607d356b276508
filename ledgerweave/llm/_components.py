"""Connected components, within a task by numpy and over the cluster by alternating star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._store import Stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't the smallest of its component.

    Alternates large-star and small-star steps; each round's edges are at most
    one per old edge and are written to the shared folder, and the rounds end
    when a star step changes nothing.
    """
    spark = edges.sparkSession

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.bit_xor(F.xxhash64("b", "a"))).first()

    def star(df: DataFrame, large: bool) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        to = df.join(least, "a")
        if large:
            out = to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = to.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        return out.where("a > b").distinct()

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = Stored(down, "edges")
    mark = signature(now.df)
    while mark[0]:
        both = now.df.unionAll(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nxt = Stored(star(star(both, True), False), "edges")
        now.drop()
        now, old = nxt, mark
        mark = signature(now.df)
        if mark == old:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
