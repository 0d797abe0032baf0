"""Connected components of links between integer nodes, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import cut

EDGES = "u long, v long"


#: So many links at most are put together in one task instead of in rounds.
ONE_TASK = 1 << 19


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of some batches as stars around their smallest nodes."""
    for b in batches:
        yield stars_of([b])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all batches as stars around their smallest nodes."""
    yield stars_of(batches)


def stars_of(batches: Iterable[pa.RecordBatch]) -> pa.RecordBatch:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                root[max(a, c)] = min(a, c)
    rows = [(x, r) for x in list(root) if (r := find(x)) != x]
    cols = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v) that is not itself the smallest of its component.

    Few links are put together in one task, and their roots are marked for broadcast.  Else each round joins a node's
    neighbours to the smallest of them, first the larger neighbours, then the smaller
    ones; rounds are logarithmic in the longest chain.
    """
    stars = cut(edges.select("u", "v").mapInArrow(contracted, EDGES))
    while True:
        if stars.count() <= ONE_TASK:
            stars = F.broadcast(cut(stars.coalesce(1).mapInArrow(merged, EDGES)))
            break
        if finished(stars):
            break
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def finished(stars: DataFrame) -> bool:
    """Whether every node has one root, and no root has one itself."""
    rows, nodes = stars.agg(F.count("*"), F.count_distinct("u")).first()
    if rows != nodes or not rows:
        return not rows
    return stars.join(stars.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
