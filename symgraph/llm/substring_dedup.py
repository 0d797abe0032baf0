"""Substring dedup by recompression: removes long word sequences seen in a smaller document.

Words are the first symbols.  Each of LEVELS rounds puts symbols together in pairs:
a hash deals all symbols into left and right ones, and a left symbol followed by a
right one becomes a new symbol, named by a 64-bit hash of the two names.  Names are
functions of content, so all tasks give equal pairs equal names without a shared
dictionary.  A run of one symbol is never paired (its symbols are all left or all
right): a window may begin anywhere in a run, and only unpaired symbols look the
same from every beginning.

A round changes at most one symbol at either border of a repeated stretch, so of two
equal windows of WINDOW = 50 words at least 44 words have the same symbols of at most
four words.  Following symbols of together SPAN = 9 words or more (12 at most) get one
high-level name; at least nine such names begin in the common 44 words.  Of every
NEAR = 8 neighbouring names the one with the smallest hash is an anchor, so two equal
windows share an anchor.

Spark groups the anchors by name.  Documents that share one with another document
hash their windows around it (96 bits of two hashes of the 50 words); Spark groups these
by hash, and a window is removed if the same window starts in a document with a
smaller id.  Anchors only choose what is compared; equality is that of the windows.

Rows travel packed, many to a record, in buckets of names or hashes of bounded size.
What a batch of documents can settle alone it settles at once: of a window that it
holds many times, only the document with the smallest id goes to the bucket, so a
passage that a third of all documents share costs a row per batch.

Defined results: null and empty texts have no words.  Rows with a null id lose
nothing and take nothing from others.  Repeated rows (same id) give equal results
and take nothing from each other.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.tokens import R1, R2, Sums, Words, mixed, packed, runs, slices, unpacked

WINDOW, LEVELS, SPAN, NEAR = 50, 2, 9, 8
#: Characters of text per bucket, and buckets there are at least.
BUCKET_CHARS, MIN_BUCKETS = 6 << 20, 48
SALTS = [np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D)]
PAIR = np.uint64(0x9FB21C651E98DF25)

#: An anchor or window on its way: name or hash (96 bits), id, key and place of the row.
ITEM = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4"), ("sure", "u1")])
PACKED = "bucket int, items binary"
PLACES = "key long, places binary"


def symbols(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after LEVELS rounds of pairing."""
    name, start = w.codes, np.arange(len(w.codes))
    for level in range(LEVELS):
        right = (mixed(name ^ SALTS[level]) >> np.uint64(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (w.row[start[:-1]] == w.row[start[1:]]))
        new = mixed(name[pair] * PAIR + name[pair + 1])
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name = name.copy()
        name[pair] = new
        name, start = name[keep], start[keep]
    return name, start


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words (in the whole sequence) of the anchors."""
    if len(w.codes) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    name, start = symbols(w)
    end = np.concatenate([start[1:], [len(w.codes)]])
    last = np.searchsorted(end, start + SPAN)  # the symbol in which the SPAN-th word ends
    ok = last < len(end)
    ok[ok] = w.row[start[ok]] == w.row[end[last[ok]] - 1]
    begin = np.flatnonzero(ok)
    span = np.full(len(name), np.iinfo(np.uint64).max)
    if len(begin):
        span[begin] = Sums(name, R1).of(begin, last[begin] + 1)
    if len(span) <= NEAR:
        chosen = begin
    else:
        view = np.lib.stride_tricks.sliding_window_view(span, NEAR)
        chosen = np.unique(np.arange(len(view)) + view.argmin(axis=1))
        # A short document has fewer names than a neighbourhood; all of them stay.
        small = w.sizes[w.row[start[begin]]] < WINDOW + NEAR
        chosen = np.union1d(chosen[ok[chosen]], begin[small])
    return span[chosen], start[chosen]


def windows(w: Words, row: int, places: np.ndarray) -> np.ndarray:
    """First words, in its text, of the row's windows around shared anchors."""
    n = int(w.sizes[row])
    if n < WINDOW:
        return np.zeros(0, np.int64)
    near = np.zeros(n + 1, np.int32)
    np.add.at(near, np.maximum(places - (WINDOW - SPAN), 0), 1)
    np.add.at(near, places + 1, -1)
    return np.flatnonzero(np.cumsum(near)[: n - WINDOW + 1] > 0)


def items_of(a: np.ndarray, b: np.ndarray, row: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), ITEM)
    out["a"], out["b"], out["doc"], out["key"], out["at"] = a, b, ids[row], keys[row], at
    return out


def grouped(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items in the order of their hashes; of each the smallest and the largest id of its group."""
    items = items[np.lexsort((items["doc"], items["b"], items["a"]))]
    if not len(items):
        return items, items["doc"], items["doc"]
    new = np.concatenate([[True], (items["a"][1:] != items["a"][:-1]) | (items["b"][1:] != items["b"][:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(items)]]) - 1
    group = np.cumsum(new) - 1
    return items, items["doc"][first][group], items["doc"][last][group]


def settled_anchors(items: np.ndarray) -> np.ndarray:
    """What has to travel: items known to be shared are sure; of these, one more asks for others."""
    items, low, high = grouped(items)
    sure = low != high
    ask = items[sure]
    if len(ask):
        ask = ask[np.concatenate([[True], ask["a"][1:] != ask["a"][:-1]])]
        ask["sure"] = 2  # only tells others that the name is shared
    items["sure"] = sure
    return np.concatenate([items, ask])


def shared_anchors(items: np.ndarray) -> np.ndarray:
    """The items whose name occurs in two documents."""
    done, rest = items[items["sure"] == 1], items[items["sure"] != 1]
    rest, low, high = grouped(rest)
    known = np.isin(rest["a"], rest["a"][rest["sure"] == 2])
    return np.concatenate([done, rest[((low != high) | known) & (rest["sure"] == 0)]])


def settled_windows(items: np.ndarray) -> np.ndarray:
    items, low, _ = grouped(items)
    items["sure"] = items["doc"] > low
    return items


def removed_windows(items: np.ndarray) -> np.ndarray:
    """The items of which a smaller document has an equal one."""
    done, rest = items[items["sure"] == 1], items[items["sure"] == 0]
    rest, low, _ = grouped(rest)
    return np.concatenate([done, rest[rest["doc"] > low]])


def sent(items: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Items by bucket: of the name or, if it is sure already, of the row."""
    items = items[np.lexsort((items["at"], items["key"]))]
    settled = items["sure"] == 1
    place = items["key"].astype(np.uint64)
    bucket = np.where(settled, mixed(place), items["a"]) % np.uint64(n_buckets)
    items["a"][settled] = items["b"][settled] = items["doc"][settled] = 0  # no longer needed
    buckets, blobs = packed(bucket.astype(np.int64), items)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "items"])


def met(df: DataFrame, judge: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, places: for every row all places that judge leaves, over all buckets."""

    def run(t: pa.Table) -> pa.Table:
        items = judge(unpacked(t.column("items").to_pylist(), ITEM))
        items = items[np.lexsort((items["at"], items["key"]))]
        first = runs(items["key"])
        ends = [*first[1:], len(items)]
        places = [items["at"][a:b].tobytes() for a, b in zip(first, ends, strict=False)]
        return pa.table([pa.array(items["key"][first], pa.int64()), pa.array(places, pa.binary())], names=["key", "places"])

    found = df.groupBy("bucket").applyInArrow(run, PLACES)
    return found.groupBy("key").agg(F.collect_list("places").alias("places"))


def places_of(blobs: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs or []), "<u4")).astype(np.int64)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by spaces) per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, -(-chars // BUCKET_CHARS))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, texts in slices(b.column(1).to_pylist()):
                w = Words(texts)
                name, start = anchors(w)
                row = w.row[start]
                yield sent(settled_anchors(items_of(name, np.zeros_like(name), at + row, start - w.starts[row], ids, keys)), n_buckets)

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, places = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            for at, texts in slices(b.column(1).to_pylist()):
                w = Words(texts)
                begin = [windows(w, i, places_of(places[at + i])) + w.starts[i] for i in range(len(texts))]
                begin = np.concatenate(begin)
                a, c = (Sums(w.codes, r).of(begin, begin + WINDOW) for r in (R1, R2))
                row = w.row[begin]
                yield sent(settled_windows(items_of(a, c, at + row, begin - w.starts[row], ids, keys)), n_buckets)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, blobs in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if blobs:
                    begin = places_of(blobs)
                    cover = np.zeros(len(words) + 1, np.int32)
                    cover[begin] += 1
                    np.add.at(cover, begin + WINDOW, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover)[: len(words)] == 0)]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_words", "n_removed", "kept"])

    known = docs.filter(F.col("doc_id").isNotNull())
    shared = met(known.select("doc_id", "text", "key").mapInArrow(find_anchors, PACKED), shared_anchors)
    near = docs.join(shared, "key").select("doc_id", "text", "key", "places")
    removed = met(near.mapInArrow(find_windows, PACKED), removed_windows)
    final = docs.join(removed, "key", "left").select("doc_id", "text", "key", "places")
    return final.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN m USING (h) WHERE least < doc_id),
k AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN bad USING (doc_id, i)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
