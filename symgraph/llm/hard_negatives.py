"""Hard negatives of anchors by inner product, mined with cover trees.

Rows are dealt into blocks of bounded size.  A block's task puts the rows of each label
into a cover tree over vectors that one more component makes equally long, so that a
smaller distance means a larger inner product.  Every level of a tree has a smaller
radius; its nodes know the distance of their farthest descendant, which bounds the
inner products below them from both sides.  An anchor descends best node first, skips
the nodes whose bounds lie outside of all its windows or below what it has found, and
scores the rows of the leaves that are left exactly, on integers.

The first descent, in the tree of the anchor's own label, finds its positives.  Each
positive opens a window of scores; the second descent, in all other trees, fills these
windows.  Anchors are dealt into sets too, so a task holds one block of rows and one
set of anchors, whatever the size of the tables; each block gives its best rows only.

Defined results: rows without an id, a label or a vector, with a null or non-finite
component, of another length than most, or with a squared norm of 2^62 or more after
scaling (no long would hold their scores) take no part.  Repeated rows are one row.
An anchor's own id is no candidate; of an anchor id that occurs with several vectors or
labels the first in their order asks.  Equal scores go to the smaller id.  Fewer
candidates than asked for give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import cut

#: Components of a block and anchors of a set, about; rows of a block at least; tasks that there are at least.
BLOCK_NUMBERS, ANCHOR_SET, LEAST_ROWS, TASKS = 1 << 19, 4096, 1024, 48
#: The radius of a level in radii of the one above, and rows that a node is not split below.
SHRINK, LEAF = 0.8, 64
#: Nodes taken at once: one at first, twice as many each time, at most so many.
MOST_AT_ONCE = 64
LOWEST, HIGHEST = -(1 << 62), 1 << 62

FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


class Win(NamedTuple):
    """Asks for the k best rows with scores from low to high."""

    positive_id: int | None
    positive_score: int | None
    low: int
    high: int
    k: int


class CoverTree:
    """Nodes as arrays: the centre (a row), the covering radius, children, or the leaf's rows as a range of order."""

    def __init__(self, x: np.ndarray, places: np.ndarray, top: float):
        """x: vectors of the block; places: this tree's rows; top: the largest squared norm of the block."""
        self.top = top
        part = x[places]
        self.y = np.column_stack([part, np.sqrt(np.maximum(0.0, top - (part * part).sum(axis=1)))])
        centre, radius, kids, spans, order = [], [], [], [], []
        away = self.far(0, np.arange(len(places)))
        waiting = [(0, np.arange(len(places)), away, -1)]
        at = 0
        while at < len(waiting):
            c, members, d, parent = waiting[at]
            centre.append(c)
            radius.append(float(d.max()))
            kids.append([])
            if parent >= 0:
                kids[parent].append(at)
            if len(members) <= LEAF or radius[-1] == 0.0:
                spans.append((len(order), len(order) + len(members)))
                order.extend(members.tolist())
            else:
                spans.append((0, 0))
                waiting += [(*child, at) for child in self.covered(c, members, d, SHRINK * radius[-1])]
            at += 1
        self.radius, self.spans = np.array(radius), np.array(spans)
        self.order = places[np.array(order, np.int64)]
        self.centre = places[np.array(centre, np.int64)]
        self.kids = [np.array(k, np.int64) for k in kids]
        del self.y

    def far(self, c: int, members: np.ndarray) -> np.ndarray:
        step = self.y[members] - self.y[c]
        return np.sqrt((step * step).sum(axis=1))

    def covered(self, c: int, members: np.ndarray, d: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Centres more than radius apart, the parent's first, with the members nearest to each and their distances."""
        nearest, owner, centres = d.copy(), np.zeros(len(members), np.int64), [c]
        while (i := int(nearest.argmax())) >= 0 and nearest[i] > radius:
            centres.append(int(members[i]))
            away = self.far(centres[-1], members)
            closer = away < nearest
            nearest[closer], owner[closer] = away[closer], len(centres) - 1
        groups = (np.flatnonzero(owner == k) for k in range(len(centres)))
        return [(centres[k], members[g], nearest[g]) for k, g in enumerate(groups) if len(g)]


class Forest:
    """A block's rows: a cover tree for each label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        norms = (x * x).sum(axis=1)
        self.top = float(norms.max()) if len(x) else 0.0
        # Sums of products are exact in doubles up to 2^53, in longs up to 2^63.
        self.whole = x if self.top < 1 << 52 else x.astype(np.int64)
        self.trees = {int(v): CoverTree(x, np.flatnonzero(labels == v), self.top) for v in np.unique(labels)}
        self.visited = 0

    def scores(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.whole is self.x and float(q @ q) < 1 << 52:
            return (self.x[places] @ q).astype(np.int64)
        return self.whole[places].astype(np.int64) @ q.astype(np.int64)

    def bounds(self, tree: CoverTree, nodes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with any row below the nodes, with room for rounding."""
        both = float(q @ q) + self.top
        near = np.sqrt(np.maximum(0.0, both - 2 * (self.x[tree.centre[nodes]] @ q)))
        slack = 1e-9 * both + 1e-6
        r = tree.radius[nodes] + 1e-9 * both**0.5
        return (both - (near + r) ** 2) / 2 - slack, (both - np.maximum(0.0, near - r) ** 2) / 2 + slack

    def search(self, q: np.ndarray, own: int, trees: list[CoverTree], windows: list[Win]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and scores of the best rows of each window, best first."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        low, high = (np.array([w[i] for w in windows], np.float64) for i in (2, 3))
        which = np.repeat(np.arange(len(trees)), 1)
        nodes = np.zeros(len(trees), np.int64)
        edges = [self.bounds(t, nodes[:1], q) for t in trees]
        least, most = (np.array([e[i][0] for e in edges]) for i in (0, 1))
        at_once = 1
        while len(nodes):
            open_ = ((most[:, None] >= low) & (least[:, None] <= high)).any(axis=1)
            which, nodes, least, most = which[open_], nodes[open_], least[open_], most[open_]
            first = np.argsort(-np.minimum(most, high.max()), kind="stable")
            now, later = first[:at_once], first[at_once:]
            at_once = min(2 * at_once, MOST_AT_ONCE)
            rows, grown = [], [(which[later], nodes[later], least[later], most[later])]
            for t, node in zip(which[now].tolist(), nodes[now].tolist(), strict=True):
                kids = trees[t].kids[node]
                if len(kids):
                    grown.append((np.full(len(kids), t), kids, *self.bounds(trees[t], kids, q)))
                else:
                    a, b = trees[t].spans[node]
                    rows.append(trees[t].order[a:b])
            which, nodes, least, most = (np.concatenate(c) for c in zip(*grown, strict=True))
            if not rows:
                continue
            places = np.concatenate(rows)
            self.visited += len(places)
            ids, score = self.ids[places], self.scores(places, q)
            for i, w in enumerate(windows):
                fits = (score >= max(w.low, int(low[i]))) & (score <= w.high) & (ids != own)
                if not fits.any():
                    continue
                some_ids, some = np.concatenate([best[i][0], ids[fits]]), np.concatenate([best[i][1], score[fits]])
                top = np.lexsort((some_ids, -some))[: w.k]
                best[i] = some_ids[top], some[top]
                if len(top) == w.k:
                    low[i] = max(low[i], np.nextafter(float(best[i][1][-1]), -np.inf) if abs(best[i][1][-1]) > 1 << 52 else best[i][1][-1])
        return best


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, x (the scaled components, rounded down) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    short = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v * scale) * (v * scale)) < 2.0**62
    there = x.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.filter(there & finite & short)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def descend(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_sets: int, same_label: bool) -> DataFrame:
    """The best rows of every block for the windows of every anchor (vec_id, label, x, windows)."""
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kind = anchors.schema["windows"].dataType.simpleString()
    block = F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("part", every(n_sets)).withColumn("windows", F.lit(None).cast(kind))
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_sets)).cast("int")).withColumn("block", every(n_blocks))

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("windows").is_valid().to_numpy()
        out: list[tuple] = []
        if asks.any() and not asks.all():
            x = np.stack(t.column("x").to_numpy())
            ids, labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
            windows = t.column("windows").filter(pa.array(asks)).to_pylist()
            forest = Forest(ids[~asks], labels[~asks], x[~asks])
            for own, label, q, mine in zip(ids[asks].tolist(), labels[asks].tolist(), x[asks], windows, strict=True):
                mine = [Win(**w) for w in mine]
                trees = [tree for v, tree in forest.trees.items() if (v == label) == same_label]
                for w, (other, score) in zip(mine, forest.search(q, own, trees, mine), strict=True):
                    out += [(own, w.positive_id, w.positive_score, i, s) for i, s in zip(other.tolist(), score.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    return dealt.unionByName(asked.select(*dealt.columns)).groupBy("block", "part").applyInArrow(run, FOUND)


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives of an anchor and a positive are the best rows of other labels that score
    from least to most percent of the positive.
    """
    v = usable(vectors, scale).distinct()
    sizes = v.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_anchor(F.col("vec_id"))).alias("asked")).collect()
    size = max(sizes, key=lambda r: (r["n"], r["dim"]), default=None)
    dim, n, n_anchors = (size["dim"], size["n"], size["asked"]) if size else (0, 0, 0)
    v = v.filter(F.size("x") == dim)
    block_rows = max(64, BLOCK_NUMBERS // max(1, dim))
    n_blocks = max(1, -(-n // block_rows), min(16, n // LEAST_ROWS))
    n_sets = max(1, -(-n_anchors // ANCHOR_SET), min(n_anchors, -(-TASKS // n_blocks)))
    first = v.filter(is_anchor(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("a")).select("vec_id", "a.label", "a.x")

    def window(low: Column, high: Column, k: int, ident: Column, score: Column) -> Column:
        values = {"positive_id": ident.cast("long"), "positive_score": score.cast("long"), "low": low.cast("long"), "high": high.cast("long"), "k": F.lit(k)}
        return F.struct(*(c.alias(name) for name, c in values.items()))

    anything = window(F.lit(LOWEST), F.lit(HIGHEST), positives, F.lit(None), F.lit(None))
    found = best(descend(v, first.withColumn("windows", F.array(anything)), n_blocks, n_sets, True), ["anchor_id"], positives)
    found = cut(found.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))  # a few rows an anchor
    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100), F.floor(score * most / 100)
    opened = found.select(F.col("anchor_id").alias("vec_id"), window(low, high, negatives, F.col("positive_id"), F.col("positive_score")).alias("w")).filter("w.low <= w.high")
    asking = first.join(opened.groupBy("vec_id").agg(F.array_sort(F.collect_list("w")).alias("windows")), "vec_id")
    out = best(descend(v, asking, n_blocks, n_sets, False), ["anchor_id", "positive_id", "positive_score"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
