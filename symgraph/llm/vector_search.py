"""Approximate nearest neighbours by collision counting.

Vectors are projected on PROJECTIONS fixed random lines.  The rows are dealt into
blocks of bounded size, each with one sorted array per line.  A query opens a window
around its own projection in each array; the radius grows step by step (virtual
rehashing), and a vector that lies in the windows of at least COLLISIONS lines is
verified: its distance is computed on the original vectors.  Every block gives its
best k; per query the best of all blocks are kept.

The search of a block ends when the radius is REACH times the k-th smallest distance
verified so far.  The projections of two vectors at distance d differ by a normal
deviate of scale d, so a vector at least as near lies in a window with probability
0.75 or more, and in COLLISIONS of PROJECTIONS windows with 0.95 or more, whatever
the dimension and the data.  How many rows are verified follows from the data: few
where the near ones stand out, most where all distances are alike.

Queries are dealt into blocks too, so a task holds one block of rows and one of
queries, whatever the size of the tables.  Rows of one id and one vector are one row
with a number, so a row that is repeated very often fills no block, and blocks hang
on ids and vectors alone, not on files.

Defined results: vectors that are null, zero, of another length than most, or hold
a null or a non-finite component take no part.  A query's own id is no candidate;
fewer candidates than k give fewer rows.  Equal distances go to the smaller id.
Repeated rows are candidates each; a query id that occurs twice is searched once,
with the first of its vectors in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, COLLISIONS = 40, 26
#: The radius that ends a search, in k-th smallest distances: P(|N(0, 1)| <= REACH) = 0.75.
REACH = 1.1503
#: Rows of a block and queries of a block, about, and tasks that there are at least.
BLOCK, QUERY_BLOCK, TASKS = 8192, 4096, 16
GROWTH = 1.3

SCHEMA = "query_id long, vec_id long, times long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(
        x.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0)
    )


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query the places of the k nearest of the verified rows, their distances, and how many were verified."""
    lines = np.random.default_rng(7).standard_normal((x.shape[1], PROJECTIONS))
    proj, at = x @ lines, q @ lines
    order = np.argsort(proj, axis=0, kind="stable")
    values = np.take_along_axis(proj, order, axis=0)
    spread = float(np.median(proj.std(axis=0))) or 1.0
    for i in range(len(q)):
        radius = 0.25 * spread
        count = np.zeros(len(x), np.int64)
        waiting = ids != own[i]  # neither verified nor the query itself
        place, dist, verified = np.zeros(0, np.int64), np.zeros(0), 0
        low = [int(np.searchsorted(values[:, j], at[i, j])) for j in range(PROJECTIONS)]
        high = list(low)
        while True:
            new = []
            for j in range(PROJECTIONS):
                a, b = np.searchsorted(values[:, j], (at[i, j] - radius, np.nextafter(at[i, j] + radius, np.inf)))
                a, b = min(a, low[j]), max(b, high[j])
                new += [order[a : low[j], j], order[high[j] : b, j]]
                low[j], high[j] = a, b
            count += np.bincount(np.concatenate(new), minlength=len(x))
            found = np.flatnonzero((count >= COLLISIONS) & waiting)
            waiting[found] = False
            verified += len(found)
            place = np.concatenate([place, found])
            dist = np.concatenate([dist, np.sqrt(((x[found] - q[i]) ** 2).sum(axis=1))])
            top = np.lexsort((ids[place], dist))[:k]
            place, dist = place[top], dist[top]
            if len(dist) == k and radius >= REACH * dist[-1] or all(a == 0 and b == len(x) for a, b in zip(low, high, strict=True)):
                break
            radius = REACH * dist[-1] if len(dist) == k else radius * GROWTH
        yield i, place, dist, verified


def search(vectors: DataFrame, query_mod: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for every vec_id divisible by query_mod."""
    v = usable(vectors)
    is_query = F.col("vec_id") % query_mod == 0
    sizes = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()
    size = max(sizes, key=lambda r: (r["n"], r["dim"]), default=None)
    dim, n, n_queries = (size["dim"], size["n"], size["q"]) if size else (0, 0, 0)
    n_blocks = max(1, -(-n // BLOCK))
    n_sets = max(1, -(-n_queries // QUERY_BLOCK), min(n_queries, -(-TASKS // n_blocks)))
    v = v.filter(F.size("embedding") == dim).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_blocks)).cast("int")
    rows = v.withColumn("block", block).withColumn("part", every(n_sets)).withColumn("query", F.lit(False))
    asked = v.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.lit(1).cast("long").alias("times"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_sets)).cast("int")).withColumn("block", every(n_blocks)).withColumn("query", F.lit(True))

    def run(t: pa.Table) -> pa.Table:
        x = np.stack(t.column("embedding").to_numpy())
        ids, times, query = (t.column(c).to_numpy() for c in ("vec_id", "times", "query"))
        out: list[tuple] = []
        if query.any() and not query.all():
            own, row_ids, row_times = ids[query], ids[~query], times[~query]
            for i, place, d, _ in best(x[~query], row_ids, x[query], own, k):
                out += zip([int(own[i])] * len(place), row_ids[place].tolist(), row_times[place].tolist(), d.tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=["query_id", "vec_id", "times", "score"])

    found = rows.unionByName(asked).groupBy("block", "part").applyInArrow(run, SCHEMA)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
