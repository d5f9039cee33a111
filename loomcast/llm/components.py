"""Connected components by distributed union-find: links are contracted inside partitions, round by round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcast.llm.storage import stored
from loomcast.shipping import shipped

ONE_TASK = 1 << 17  # links

def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: (node, smallest node of its component) for all nodes but the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[:len(a)].tolist(), index[len(a):].tolist()
    parent = list(range(len(nodes)))
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # a parent is never larger, so it is final by now
        parent[i] = parent[parent[i]]
    root = np.array(parent, np.int64)
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def contract(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The links of a partition replaced by a forest; kept links are contracted again when they are many."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list = []
    held = 0

    def fold():
        x = np.concatenate([a, *(w[0] for w in waiting)])
        y = np.concatenate([b, *(w[1] for w in waiting)])
        return local_forest(x, y)

    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > most:
            a, b = fold()
            waiting, held = [], 0
            if len(a) > most:  # links of different components only: pass them on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    a, b = fold()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b: long), for every linked node but the
    smallest. Large and small stars alternate (Kiveris et al. 2014) until all links are stars, each round
    after contracting the links inside partitions; a hub's neighbours are first reduced to their minimum."""
    spark = links.sparkSession
    edges = stored(links.select("a", "b").filter("a <> b").transform(shipped).mapInArrow(contract, "a long, b long"))
    if edges.count() <= ONE_TASK:  # few links are left: the same contraction, in one partition
        edges = stored(edges.repartition(1).transform(shipped).mapInArrow(contract, "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node to the smallest of its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small star: a node and its smaller neighbours to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("u"), "m").filter("u <> m") \
            .union(least.select(F.col("a").alias("u"), "m")).distinct()
        forest = stored(small.select(F.col("u").alias("a"), F.col("m").alias("b")).transform(shipped).mapInArrow(contract, "a long, b long"))
        edges = forest
        # done when no node has two roots and no root has one
        check = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        twice = check.filter("n > 1").limit(1).count()
        chained = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not twice and not chained:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
