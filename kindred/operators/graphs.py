"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.tables import cut, drop

#: Edges that one task may join by itself; more are joined in rounds.
SMALL = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    names = list(parent)
    for at in range(0, len(names), 10_000):
        own = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], ["x", "c"])


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(x, c) for every end x of a link (a, b): c is the smallest id that x reaches. A link of an id to itself names it.

    Up to ``small`` links are one task's work. Else each round a node takes the least label among its neighbours', then its
    label's label, so rounds grow with the logarithm of a component's width; adaptive execution splits the joins of a node
    with very many links, and tables of earlier rounds are deleted."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if small and edges.limit(2 * small + 1).count() <= 2 * small:
        return edges.filter("a <= b").repartition(1).mapInArrow(_joined, "x long, c long")
    labels = before = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("c")))
    while True:
        offered = edges.join(labels.select(F.col("x").alias("b"), F.col("c").alias("o")), "b").groupBy("a").agg(F.min("o").alias("m")).select(F.col("a").alias("x"), "m")
        lower = labels.join(offered, "x").select("x", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        short = labels.select(F.col("x").alias("c"), F.col("c").alias("cc"))
        after = cut(lower.join(short, "c", "left").select("x", "was", F.least("c", F.coalesce("cc", "c")).alias("c")))
        done = after.filter("c <> was").isEmpty()
        drop(before)
        labels, before = after.select("x", "c"), after
        if done:
            drop(edges)
            return labels
