"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents.  A source owns a share of the slots in
proportion to its weight; when it is used up, the others go on in proportion, so that
all documents stay.  That fluid share gives each block its times: it is released at
the slot in which its share begins, and due by the end of the slot in which it ends;
among the released blocks the earliest deadline goes first.  The number of blocks a
source has had by any slot then differs from its share by less than one.

With virtual time v, in which a source of weight w is served w * v blocks until it is
used up, the slot at v is the sum over all sources of min(blocks, w * v).  Weights are
taken as exact fractions, so nothing is rounded and nothing adds up.

The driver plans blocks, not documents: blocks are of BLOCK_ROWS documents, or as many
more as make them BLOCKS at most, beside one for each source, of any number of
sources.  Every document finds its block from the row counts of hashed buckets.

Defined results: a null source is a source of its own.  A weight that is missing, zero
or negative counts as the smallest one given, divided by the number of documents, so
the source comes last.  Repeated rows each get a place.  Equal deadlines go to the
source first by name, null first.  Rows with a null id come first in their bucket.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import sized

#: Documents of a block, at least, and blocks that are planned, about.
BLOCK_ROWS, BLOCKS = 64, 1 << 18
#: Rows that one window partition ranks at most, about.
BUCKET_ROWS = 2_000


def windows(blocks: list[int], weights: list[Fraction]) -> list[list[tuple[int, int]]]:
    """Release and deadline of the blocks of each source."""
    ends = sorted((Fraction(b) / w, b, w) for b, w in zip(blocks, weights, strict=True))
    until = [e[0] for e in ends]  # virtual times at which sources are used up
    done = [0, *accumulate(e[1] for e in ends)]
    total = sum(weights)
    rest = [total, *(total - x for x in accumulate(e[2] for e in ends))]
    out = []
    for b, w in zip(blocks, weights, strict=True):
        at, times = 0, []
        for k in range(b + 1):
            v = k / w
            at = bisect_right(until, v, at)
            times.append(done[at] + v * rest[at])
        out.append([(math.floor(t), math.ceil(u)) for t, u in pairwise(times)])
    return out


def plan(blocks: list[int], weights: list[Fraction]) -> list[np.ndarray]:
    """For each source the slots, releases and deadlines of its blocks, earliest deadline first."""
    times = windows(blocks, weights)
    coming = sorted((release, s, k) for s, rows in enumerate(times) for k, (release, _) in enumerate(rows))[::-1]
    out = [np.array([(0, *t) for t in rows], np.int64).reshape(-1, 3) for rows in times]
    ready: list[tuple[int, int, int]] = []
    for t in range(sum(blocks)):
        while coming and coming[-1][0] <= t:
            _, s, k = coming.pop()
            heapq.heappush(ready, (times[s][k][1], s, k))
        _, s, k = heapq.heappop(ready)
        out[s][k, 0] = t
    return out


def ranked(docs: DataFrame, n_max: int, block_rows: int) -> DataFrame:
    """docs with _block and _row, their place within their source.

    Sources are ranked in hashed buckets; only the bucket sizes are summed per source.
    """
    key = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_max // BUCKET_ROWS))))
    d = docs.withColumns({"_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), "_bucket": key})
    sizes = d.groupBy("_source", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("doc_id"))
    d = d.withColumn("_rank", row).join(sizes, ["_source", "_bucket"])
    place = F.col("_before") + F.col("_rank") - 1
    return d.withColumns({"_block": F.floor(place / block_rows), "_row": place % block_rows, "_first": F.lit(block_rows)}).drop("_rank", "_before", "_bucket")


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """docs with _source, _block, _row and _slot (slot, release, deadline).

    weights: target weight by source; else each source weighs its size to the power
    of temperature.
    """
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    total = sum(sizes.values())
    block_rows = max(BLOCK_ROWS, -(-total // BLOCKS))
    names = sorted(sizes, key=lambda x: (x is not None, x or ""))
    share = [Fraction(weights.get(x, 0) if weights else sizes[x] ** temperature) for x in names]
    last = min((x for x in share if x > 0), default=Fraction(1)) / max(1, total)
    phases = plan([-(-sizes[x] // block_rows) for x in names], [x if x > 0 else last for x in share])
    keys = ["" if x is None else "s" + x for x in names]
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(keys, phases, strict=True)))

    @F.pandas_udf("slot long, release long, deadline long")
    def slot(source: pd.Series, block: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(source), 3), np.int64)
        for name, at in source.groupby(source).indices.items():
            out[at] = shared.value[name][block.to_numpy()[at]]
        return pd.DataFrame(out, columns=["slot", "release", "deadline"])

    d = ranked(docs, max(sizes.values(), default=0), block_rows)
    return d.withColumn("_slot", slot("_source", "_block"))


def position() -> Column:
    """Place in the mixture; a source's last block may leave places free."""
    return F.col("_slot.slot") * F.col("_first") + F.col("_row")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """doc_id, source, block, slot, release, deadline and position in the mixture."""
    d = scheduled(docs.select("doc_id", "source"), weights, temperature)
    return d.select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_slot.slot").alias("slot"), F.col("_slot.release").alias("release"),
        F.col("_slot.deadline").alias("deadline"), position().alias("position"),
    )


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """All rows of docs, in the order of the mixture.  Rows travel as one value, so no column of theirs can clash."""
    row = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    return scheduled(row, weights, temperature).orderBy(position(), "doc_id").select("_all.*")


def stored_order(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from Parquet files, with their place in the order in which they were written.

    Files are numbered in the order of the rows, and rows within them; only the number
    of rows of each file is summed up.
    """
    file = F.col("_metadata.file_path")
    part = lambda c: F.struct(*(F.regexp_extract(c, p, 1).cast("int") for p in (r"part-(\d+)", r"-c(\d+)[^/]*$")), c)
    sizes = docs.groupBy(file.alias("_file")).count()
    before = F.sum("count").over(Window.orderBy(part(F.col("_file"))).rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    sizes = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return row.join(sized(sizes), "_file").select("_all.*", (F.col("_before") + F.col("_row")).alias(name))
