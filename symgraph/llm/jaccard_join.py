"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

A document's set are the hashes of its distinct 5-word shingles.  Documents with
equal sets are one node from the start.  All tokens have one global order: those
found to be common come last, the rarest of them first; else the hash decides.  Two sets
of Jaccard similarity 3/4 or more share k of the first n - ceil(3n/4) + k tokens of
each, whatever the order, so

* sets of at most x tokens are filed under all pairs (fixed-size subsets, k = 2) of
  that beginning: pairs of tokens are far rarer than tokens, so lists are short;
* larger sets are filed under each of its tokens (k = 1), and so are small sets that
  are still within 3/4 of x, as they may match larger ones.

The boundary x is where, by the sizes and list lengths counted, enumerating pairs
stops to be cheaper than scanning lists.

Common tokens are counted over all documents in ROUNDS passes, each on the tokens
that then come first; the most frequent (HEAVY at most, a bound of what is
broadcast) move to the end of the order, by their counts.  So what sets of a group
of near copies have alone comes first, then what few of them have in common.  The
order only decides which lists are scanned, never which pairs match.

Two sets that match also share enough of these first tokens: with c in common, and r
tokens of a set behind its first ones, the overlap is at most c plus the larger r.
Pairs whose c cannot reach the overlap their sizes ask for are never compared.  A
member of a list whose own number of common tokens is under what any size on that
list asks for leaves the list; and each looks for others only on as many of its
shortest lists as one of those that a pair must share is among.

Links are not listed within a group that is connected already.  First, in STARS
rounds, every long list (of a common token) compares its members with one of them,
first of all the one that has most in common with others, and the components of
these links are found; then only pairs in different components are counted and, if c
allows, compared.  Long lists are cut into parts of about PART members, which meet
in tasks of their own.  Every comparison is exact, on whole sets.

Defined results: texts without words (null, empty) have an empty set and stay alone.
Fewer than five words are one shingle.  Rows with a null id are grouped by their
set only and never name a component.  Rows of one id are judged one by one.  Sets
and shingles are told apart by 64-bit hashes.  Columns other than id and text are
not read, so their names have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import cut, frequent, sized, written, unused
from symgraph.llm.components import components
from symgraph.llm.tokens import R1, R2, Sums, Words, mixed, packed, runs, slices, unpacked

SHINGLE, PERCENT = 5, 75
#: Tokens in more than COMMON places are moved back, at most HEAVY per round.  A round
#: sees a quarter of a set, so after four all tokens of a group of near copies are known.
ROUNDS, COMMON, HEAVY = 4, 16, 1 << 19
#: Rounds in which long lists compare their members with one of them.
STARS = 3
#: Members of one part of a long list, about.
PART = 512
BUCKET_CHARS, MIN_BUCKETS = 6 << 20, 48
PAIR = np.uint64(0x9FB21C651E98DF25)

COUNT = np.dtype([("token", "<u8"), ("n", "<u4")])
ITEM = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4"), ("sure", "u1")])
PACKED = "bucket int, items binary"


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Sets:
    """The shingle sets of some texts: tokens by row and value, sizes and nodes by row."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        count = np.where(w.sizes < SHINGLE, w.sizes > 0, w.sizes - SHINGLE + 1)
        stop = np.cumsum(count)
        row = np.repeat(np.arange(len(texts)), count)
        begin = w.starts[row] + np.arange(len(row)) - (stop - count)[row]
        token = Sums(w.codes, R1).of(begin, begin + np.minimum(w.sizes, SHINGLE)[row])
        for a, b in zip((stop - count).tolist(), stop.tolist(), strict=True):
            token[a:b].sort()
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.token, self.row = token[new], row[new]
        self.sizes = np.bincount(self.row, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.nodes = signed(Sums(self.token, R2).of(self.starts, self.starts + self.sizes))

    def of(self, row: int) -> np.ndarray:
        return self.token[self.starts[row] : self.starts[row] + self.sizes[row]]


def least_overlap(size: np.ndarray) -> np.ndarray:
    return -(-size * PERCENT // 100)


class Known:
    """Counts of common tokens; most others are told from them by a few bits."""

    BITS = np.uint64(64 - 22)

    def __init__(self, common: np.ndarray):
        self.tokens, self.n = common["token"], common["n"]  # sorted by token
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.tokens >> self.BITS] = True

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How often each token was counted; 0 if it isn't common."""
        out = np.zeros(len(x), np.int64)
        at = np.flatnonzero(self.maybe[x >> self.BITS])
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, x[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[place] == x[at], self.n[place], 0)
        return out


def filed(s: Sets, known: Known, small: int) -> np.ndarray:
    """Where the sets are filed: tokens, and for sets of at most small tokens pairs of tokens."""
    counts = known.counts(s.token)
    common = counts > 0
    n_before = np.cumsum(~common) - ~common  # uncommon tokens before each, of its row below
    n_before -= np.append(n_before, 0)[np.minimum(s.starts, len(common))][s.row]
    rank = n_before  # of the uncommon ones, by value; the common ones follow by their counts
    at = np.flatnonzero(common)
    at = at[np.lexsort((counts[at], s.row[at]))]
    uncommon, n_common = np.bincount(s.row[~common], minlength=len(s.sizes)), np.bincount(s.row[at], minlength=len(s.sizes))
    rank[at] = uncommon[s.row[at]] + np.arange(len(at)) - (np.cumsum(n_common) - n_common)[s.row[at]]
    once = np.zeros(len(s.sizes), bool)  # equal sets of this batch are filed once
    once[np.unique(s.nodes, return_index=True)[1]] = True
    first = s.sizes - least_overlap(s.sizes) + 1  # how many tokens one common token needs
    keep = once[s.row] & (rank < first[s.row] + 1)
    token, row, common, rank = s.token[keep], s.row[keep], common[keep], rank[keep]
    single = (rank < first[row]) & (s.sizes[row] * 100 > small * PERCENT)
    out = [(token[single], row[single], common[single])]
    last = np.flatnonzero(s.sizes[row] <= small)  # one more for two common tokens
    last = last[np.lexsort((rank[last], row[last]))]
    token, row, rank, common = token[last], row[last], rank[last], common[last]
    for back in range(1, small + 1):  # pairs of a token with the one so many places before it
        at = np.flatnonzero(rank >= back)
        if not len(at):
            break
        pair = mixed(token[at - back] * PAIR + token[at])
        out.append((pair, row[at], common[at - back]))  # as common as its rarer token
    token, row, common = (np.concatenate(x) for x in zip(*out, strict=True))
    items = np.zeros(len(token), ITEM)
    items["token"], items["node"], items["size"], items["sure"] = token, s.nodes[row], s.sizes[row], common
    return items


def unique(items: np.ndarray) -> np.ndarray:
    items = items[np.lexsort((items["node"], items["token"]))]
    new = np.ones(len(items), bool)
    new[1:] = (items["token"][1:] != items["token"][:-1]) | (items["node"][1:] != items["node"][:-1])
    return items[new]


def batch(buckets: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    if "node" in rows.dtype.names:
        order = np.argsort(rows["node"], kind="stable")
        buckets, rows = buckets[order], rows[order]
    ids, blobs = packed(buckets.astype(np.int64), rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "items"])


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node per row; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(1).to_pylist()):
                s = Sets(texts)
                nodes = pa.array(s.nodes, pa.int64(), mask=s.sizes == 0)
                kept = [b.column(i).slice(at, len(texts)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s.sizes, pa.int64()), nodes], names=["doc_id", "text_hash", "n_shingles", "node"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long")


def common_tokens(docs: DataFrame, heavy: np.ndarray, n_buckets: int) -> tuple[np.ndarray, float]:
    """Common tokens among those that come first, and by how many others one is shared on average."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Known(known.value)
        for b in batches:
            for _, texts in slices(b.column(1).to_pylist()):
                items = filed(Sets(texts), common, 0)
                items = items[np.argsort(items["token"], kind="stable")]
                first = runs(items["token"])
                out = np.zeros(len(first), COUNT)
                out["token"] = items["token"][first]
                out["n"] = np.diff(np.concatenate([first, [len(items)]]))
                out = out[common.counts(out["token"]) == 0]
                yield batch(out["token"] % np.uint64(n_buckets), out)

    def total(t: pa.Table) -> pa.Table:
        rows = unpacked(t.column("items").to_pylist(), COUNT)
        rows = rows[np.argsort(rows["token"], kind="stable")]
        first = runs(rows["token"])
        n = np.add.reduceat(rows["n"].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        often = n > COMMON
        # One row with a null token has the sums that tell how long the lists are.
        token = pa.array([None, *signed(rows["token"][first][often]).tolist()], pa.int64())
        return pa.table([token, pa.array([int(n[~often].sum()), *n[often].tolist()], pa.int64()), pa.array([int((n[~often] * (n[~often] - 1)).sum()), *[0] * int(often.sum())], pa.int64())], names=["token", "n", "pairs"])

    found = written(docs.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(total, "token long, n long, pairs long"), "common-tokens")
    places, pairs = found.filter("token is null").agg(F.sum("n"), F.sum("pairs")).first()
    rows = frequent(found.filter("token is not null"), "n", HEAVY).select("token", "n").toArrow()
    more = np.zeros(len(rows), COUNT)
    more["token"], more["n"] = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), np.minimum(rows.column(1).to_numpy(), 0xFFFFFFFF)
    return np.sort(np.concatenate([heavy, more]), order="token"), (pairs or 0) / max(places or 0, 1)


def boundary(shared: float, longest: int = 64) -> int:
    """The largest set size for which pairs of tokens cost no more than lists of tokens.

    A pair costs a row; a token costs a row and its comparisons with the others on
    its list.
    """
    best = 0
    for n in range(3, longest + 1):
        first = n - int(least_overlap(np.int64(n))) + 1
        if (first + 1) * first / 2 > first * (1 + shared):
            break
        best = n
    return best


LISTS = "token long, u long, v long, n long, size_u long, size_v long"


def counted_pairs(items: np.ndarray) -> np.ndarray:
    """(u, v, size_u, size_v, n) for the pairs of members of lists, n by how many lists."""
    first = runs(items["token"])
    count = np.diff(np.concatenate([first, [len(items)]]))
    left = np.repeat(count, count) - 1 - (np.arange(len(items)) - np.repeat(first, count))  # members after each
    a = np.repeat(np.arange(len(items)), left)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    small = np.minimum(items["size"][a], items["size"][b]).astype(np.int64)
    ok = small * 100 >= np.maximum(items["size"][a], items["size"][b]).astype(np.int64) * PERCENT
    a, b = a[ok], b[ok]  # items of a list are in the order of their nodes, so u < v
    pairs = np.zeros(len(a), np.dtype([("u", "<i8"), ("v", "<i8"), ("size_u", "<i8"), ("size_v", "<i8")]))
    pairs["u"], pairs["v"], pairs["size_u"], pairs["size_v"] = items["node"][a], items["node"][b], items["size"][a], items["size"][b]
    order = np.lexsort((pairs["v"], pairs["u"]))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["u"][1:] != pairs["u"][:-1]) | (pairs["v"][1:] != pairs["v"][:-1])
    first = np.flatnonzero(new)
    return pairs[first], np.diff(np.concatenate([first, [len(pairs)]]))


def filings(docs: DataFrame, heavy: np.ndarray, small: int, n_buckets: int) -> DataFrame:
    """Pairs filed together on short lists (u, v, n lists, sizes), and the members of long lists (token, u, size_u)."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Known(known.value)
        for b in batches:
            for _, texts in slices(b.column(1).to_pylist()):
                items = filed(Sets(texts), common, small)
                # Common tokens need no bucket: they are shared, and their lists are long.
                bucket = np.where(items["sure"] == 1, mixed(items["node"].astype(np.uint64)), items["token"])
                yield batch(bucket % np.uint64(n_buckets), items)

    def shared(t: pa.Table) -> pa.Table:
        items = unique(unpacked(t.column("items").to_pylist(), ITEM))
        first = runs(items["token"])
        count = np.diff(np.concatenate([first, [len(items)]]))
        count = np.repeat(count, count)
        long = items[(items["sure"] == 1) | (count > COMMON)]
        pairs, n = counted_pairs(items[(items["sure"] == 0) & (count > 1) & (count <= COMMON)])
        zeros = np.zeros(len(long), np.int64)
        token = pa.array(np.concatenate([signed(long["token"]), np.zeros(len(pairs), np.int64)]), mask=np.arange(len(long) + len(pairs)) >= len(long))
        columns = [np.concatenate(x) for x in ((long["node"], pairs["u"]), (zeros, pairs["v"]), (zeros, n), (long["size"].astype(np.int64), pairs["size_u"]), (zeros, pairs["size_v"]))]
        return pa.table([token, *(pa.array(c, pa.int64()) for c in columns)], names=["token", "u", "v", "n", "size_u", "size_v"])

    return docs.mapInArrow(file, PACKED).groupBy("bucket").applyInArrow(shared, LISTS)


def node_sets(docs: DataFrame, nodes: DataFrame, all_sets: DataFrame) -> DataFrame:
    """node, tokens (sorted, as bytes) of the given nodes, each from one document."""
    ids = all_sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = docs.join(sized(ids), "doc_id").select("doc_id", "text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(2).to_numpy()
            for at, texts in slices(b.column(1).to_pylist()):
                s = Sets(texts)
                rows = [i for i in range(len(texts)) if s.nodes[i] == want[at + i]]
                yield pa.RecordBatch.from_arrays([pa.array(s.nodes[rows], pa.int64()), pa.array([s.of(i).tobytes() for i in rows], pa.binary())], names=["node", "tokens"])

    return chosen.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= PERCENT * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("x")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("y")), "v")
    return two.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def fewest_common(a, b, small: int):
    """How many first tokens two sets of sizes a and b that match have in common, at least.

    Small sets are filed under pairs of tokens; they have one pair in common.
    """
    behind = lambda n: F.ceil(n * PERCENT / 100) - 1
    overlap = F.ceil((a + b) * PERCENT / (100 + PERCENT))
    return F.when((a <= small) & (b <= small), 1).otherwise(F.greatest(F.lit(1), overlap - F.greatest(behind(a), behind(b))))


def near(a, b):
    """Whether two sizes allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def least_needed(size, lo, hi, small: int):
    """What fewest_common() asks for, at least, of a set and any one of a size from lo to hi that is near."""
    lo = F.least(size, F.greatest(lo, F.ceil(size * PERCENT / 100)))
    hi = F.greatest(size, F.least(hi, F.floor(size * 100 / PERCENT)))
    # It rises with the other size up to its own, then falls, but for steps of one.
    return F.least(fewest_common(size, lo, small), fewest_common(size, hi, small) - 1)


def rooted(df: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """df with the root of a node; a node without links is its own."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return df.join(named, node, "left").withColumn(root, F.coalesce(root, node))


def still_open(members: DataFrame, small: int) -> DataFrame:
    """The members of lists that join components, without those that have too little in common with any.

    Pairs of different components share no other lists, so the second round, which
    counts those left only, leaves out more.
    """
    for _ in range(2):
        by_token = F.min("root").alias("a"), F.max("root").alias("b"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.count("*").alias("n")
        lists = members.groupBy("token").agg(*by_token).filter("a < b").select("token", "lo", "hi", "n")
        members = members.drop("lo", "hi", "n", "long", "need").join(lists, "token")
        members = members.withColumn("long", F.count("*").over(Window.partitionBy("node")))
        members = members.withColumn("need", least_needed(F.col("size"), F.col("lo"), F.col("hi"), small)).filter("long >= need")
    return cut(members)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, root, component_id per row of docs (doc_id, text).

    root is the group's own key: an id that occurs with several texts may be in several groups.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, -(-chars // BUCKET_CHARS))
    sets = cut(sets_of(docs))
    heavy, shared = np.zeros(0, COUNT), 0.0
    for _ in range(ROUNDS):
        heavy, shared = common_tokens(docs, heavy, n_buckets)
    small = boundary(shared)
    lists = written(filings(docs, heavy, small, n_buckets), "lists")
    members = lists.filter("token is not null").select("token", F.col("u").alias("node"), F.col("size_u").alias("size")).distinct()
    several = members.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("token")
    members = members.join(several, "token")
    on_long = cut(members.groupBy("node").agg(F.count("*").alias("long")))
    members = cut(members.join(on_long, "node"))

    # What short lists have in common may be all that is needed, with the long lists' help.
    pairs = lists.filter("token is null").groupBy("u", "v").agg(F.sum("n").alias("n"), F.first("size_u").alias("size_u"), F.first("size_v").alias("size_v"))
    for end in ("u", "v"):
        pairs = pairs.join(on_long.select(F.col("node").alias(end), F.col("long").alias(f"long_{end}")), end, "left")
    help_ = F.coalesce(F.least("long_u", "long_v"), F.lit(0)) * F.when(F.col("long_u").isNull() | F.col("long_v").isNull(), 0).otherwise(1)
    needed = fewest_common(F.col("size_u"), F.col("size_v"), small)
    pairs = cut(pairs.filter(F.col("n") + help_ >= needed).select("u", "v", "n", "size_u", "size_v"))
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(members.select("node")).distinct()
    tokens = cut(node_sets(docs.filter(F.col("doc_id").isNotNull()), nodes, sets))

    def ends(df: DataFrame, end: str, *more: str, rank: bool = False) -> DataFrame:
        return df.select("token", *more, F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("size", "root", "long", *["rank"] * rank)))

    able = F.least("long_u", "long_v") >= needed  # without any help from short lists
    apart = (F.col("root_u") != F.col("root_v")) & near(F.col("size_u"), F.col("size_v"))
    pair = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")

    # First, members of long lists with one of them, another one in each round.
    found = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "node long, root long")
    share = F.col("long") / (F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1)
    for i in range(STARS):
        placed = still_open(rooted(members, roots), small)
        chance = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / (1 << 20) * i
        middle = placed.groupBy("token").agg(F.max_by(F.struct("node", "size", "root", "long"), F.struct(share + chance, "node")).alias("end"))
        star = ends(placed, "u").join(ends(middle.select("token", "end.*"), "v"), "token").filter(apart & able)
        star = cut(star.select(*pair).distinct())
        if star.isEmpty():  # all that share a long list are connected, or too different
            break
        new = cut(links(star, tokens))
        if i and new.isEmpty():  # what is left hardly links
            break
        found = found.union(new)
        roots = components(found)

    # Then pairs that are not connected yet, with all that they have in common.
    placed = still_open(rooted(members, roots), small)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "token"))
    left = placed.withColumns({"rank": rank, "parts": F.ceil(F.col("n") / PART).cast("int")})
    one = ends(left.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "u", "part", rank=True)
    two = ends(left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "v", "part", rank=True)
    # Of as many lists as a pair must share, one is among the first long - needed + 1 of either, in the order of lists by length.
    early = (F.col("rank_u") <= F.col("long_u") - needed + 1) & (F.col("rank_v") <= F.col("long_v") - needed + 1)
    alone = one.join(two, ["token", "part"]).filter((F.col("u") < F.col("v")) & apart & early)
    alone = alone.groupBy("u", "v").agg(F.first("size_u").alias("size_u"), F.first("size_v").alias("size_v"))
    own = placed.groupBy("node").agg(F.collect_list("token").alias("tokens"))  # as many as a set has first tokens, at most
    for end in ("u", "v"):
        alone = alone.join(own.select(F.col("node").alias(end), F.col("tokens").alias(f"tokens_{end}")), end)
    alone = alone.withColumn("n", F.size(F.array_intersect("tokens_u", "tokens_v"))).filter(F.col("n") >= needed)
    # Pairs that short lists know get what long lists add to them.
    pairs = rooted(rooted(pairs, roots, "u", "root_u"), roots, "v", "root_v").filter("root_u <> root_v")
    helped = pairs.select("u", "v").join(members.select(F.col("node").alias("u"), "token"), "u").join(members.select(F.col("node").alias("v"), "token"), ["v", "token"])
    added = helped.groupBy("u", "v").agg(F.count("*").alias("extra"))
    pairs = pairs.join(added, ["u", "v"], "left").withColumn("n", F.col("n") + F.coalesce("extra", F.lit(0))).select("u", "v", "n", "size_u", "size_v")
    every = pairs.filter(F.col("n") >= needed).select("u", "v").union(alone.select("u", "v")).distinct()
    roots = components(found.union(cut(links(every, tokens))))

    by_node = rooted(sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), roots)
    names = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(names, "root").select("node", "root", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return sets.join(by_node, "node", "left").select("doc_id", "text_hash", "n_shingles", "node", "root", F.coalesce(component, F.col("doc_id")).alias("component_id"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs per group: that of the smallest id, and of that id's texts one.

    Rows of empty sets and rows with a null id all stay.  An id with several texts may
    stand for several groups; of rows with one id and text one stays, whichever it is.
    """
    ident, hashed = unused(docs, "id", "hash")
    text_hash = F.xxhash64("text")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(classes(known).filter("node is not null and doc_id is not null").select("doc_id", "text_hash", "root"))
    own = F.struct("doc_id", "text_hash")
    first = rows.groupBy("root").agg(F.min(own).alias("first"))
    gone = rows.join(first, "root").filter(own != F.col("first")).select("doc_id", "text_hash").distinct()
    gone = sized(gone).withColumnsRenamed({"doc_id": ident, "text_hash": hashed})
    same = (F.col("doc_id").cast("long") == F.col(ident)) & (text_hash == F.col(hashed))
    kept = docs.join(gone, same, "left_anti")
    twice = rows.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias(ident), F.col("text_hash").alias(hashed))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # Rows that occur several times are few, or the corpus repeats itself; one of each stays.
    single = kept.join(twice, same, "left_anti").select(*docs.columns)
    return single.union(kept.join(twice, same, "left_semi").withColumn(hashed, text_hash).dropDuplicates(["doc_id", hashed]).select(*docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (WITH RECURSIVE t(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.node, l.v FROM t JOIN l ON l.u = t.other) SELECT node, min(other) AS m FROM t GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.m AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id
"""
