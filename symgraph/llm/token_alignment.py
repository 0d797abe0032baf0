"""Alignment of two tokenizers by interval coalescing.

Both tokenizations of a text are byte ranges over the same bytes.  All ranges are
sorted by start, the running maximum of their ends is taken, and a group breaks where
a start reaches it; within a group the A and B ranges that overlap are links.

No token of either tokenizer crosses from a character that is no white space to a
space or a line feed, so a text is cut there into chunks (checked on both models;
where it does not hold, a text is one chunk).  A task aligns the chunks it has not met
yet together, as one long axis of bytes, and puts texts together from them.  Spark
counts in how many documents each pair of ids is linked; the most frequent pairs go to
all tasks as sorted arrays of bounded size (HEAD), the others are joined by their key.

Defined results: a text that is null, empty, or not given back byte by byte by both
tokenizers has no tokens: zeros and an empty string.  Rows are aligned one by one, so
repeated rows repeat their result and count as documents each; other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import written
from symgraph.llm.sentencepiece_codec import MARK, Codec

#: Pairs of ids that every task gets.
HEAD = 1 << 20
#: Aligned chunks, and characters of them, after which a worker begins to forget those not met since.
MEMO, MEMO_CHARS = 1 << 17, 1 << 22
#: Documents whose chunks are lists at a time, and characters of new chunks aligned together.
SLICE, AXIS = 100, 1 << 21
#: Fixed value: how byte-level models split a text before they merge bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space, then all up to a space or a line feed behind a character that is none.
CHUNK = re.compile(r"\s*(?:\S+(?:[^\S \n]\s*)?)*")
WHOLE = re.compile(r"(?s).+")
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in their order, have the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A: ids of texts and the bytes of each id, from the file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        for x in spec["added_tokens"]:
            self.bytes_of.setdefault(x["id"], x["content"].encode())
        pre = spec["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        first = len(vocab) - len(merges)
        ranked = all(vocab.get(m) == first + i for i, m in enumerate(merges)) and not spec["model"].get("ignore_merges")
        if self.cuts and ranked:  # an id is its merge's rank: the same merges by a quicker library
            import tiktoken

            ranks = {self.bytes_of[i]: i for i in vocab.values()}
            quick = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [quick.encode_ordinary(x) for x in texts]
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.encode = lambda texts: [slow.encode(x, add_special_tokens=False).ids for x in texts]


def coalesced(start: np.ndarray, end: np.ndarray, n_a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges, the first n_a of them of A: order, group of each in that order, and the links as places in A and in B."""
    order = np.lexsort((np.arange(len(start)) >= n_a, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(start), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    low = np.searchsorted(end[n_a:], start[:n_a], "right")
    n = np.searchsorted(start[n_a:], end[:n_a], "left") - low
    a = np.repeat(np.arange(n_a), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return order, np.cumsum(opens) - 1, a, b


class Aligner:
    """Aligns texts chunk by chunk.  A chunk's entry: its groups, the keys of its links, and its counts packed in one number."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Codec(b_path)
        size = self.b.sp.get_piece_size()
        piece = self.b.sp.id_to_piece
        b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.sp.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.bytes_of = [[self.a.bytes_of.get(i, b"") for i in range(max(self.a.bytes_of) + 1)], b_bytes]
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in self.bytes_of]
        # Each id in decimal with what may follow it: a comma within its side of a group, else the mark that ends the side.
        self.texts = [f"{i}{mark}" for x, end in zip(self.bytes_of, "|;", strict=True) for i in range(len(x)) for mark in ("," + end)]
        self.base = size
        self.pattern = CHUNK if self.a.cuts and not self.b.whole else WHOLE
        self.new: dict[str, tuple[str, bytes, int] | None] = {}
        self.old: dict[str, tuple[str, bytes, int] | None] = {}
        self.chars = 0

    def segments(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks; each begins with the space that B would put before a text.

        A line feed before a chunk stands for what precedes it in a text: no piece
        crosses it.  It and the mark before it are two ids.
        """
        if self.pattern is WHOLE:
            return self.b.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [x[2:] for x in self.b.sp.encode(["\n" + c for c in chunks], num_threads=1)]

    def fits(self, chunks: list[str], sides: list[list[list[int]]]) -> list[bool]:
        """Whether both tokenizations give a chunk's bytes back; all at once, and one by one only if some do not."""
        raw = [c.encode() for c in chunks]
        whole = b"".join(raw)
        for ids, table in zip(sides, self.bytes_of, strict=True):
            parts = list(map(table.__getitem__, chain.from_iterable(ids)))
            upto = np.cumsum([0, *map(len, parts)])[np.cumsum(list(map(len, ids)))]
            if b"".join(parts) != whole or not np.array_equal(upto, np.cumsum(list(map(len, raw)))):
                return [all(b"".join(map(t.__getitem__, x[i])) == r for x, t in zip(sides, self.bytes_of, strict=True)) for i, r in enumerate(raw)]
        return [True] * len(chunks)

    def align(self, chunks: list[str]) -> None:
        sides = [self.a.encode(chunks), self.segments(chunks)]
        fits = self.fits(chunks, sides)
        if not all(fits):
            self.new.update((c, None) for c, ok in zip(chunks, fits, strict=True) if not ok)
            chunks, *sides = [[x for x, ok in zip(c, fits, strict=True) if ok] for c in (chunks, *sides)]
            if not chunks:
                return
        sizes = [np.array(list(map(len, x)), np.int64) for x in sides]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(sides, sizes, strict=True)]
        lengths = [t[i] for t, i in zip(self.lengths, ids, strict=True)]
        end = np.concatenate([np.cumsum(n) for n in lengths])
        n_a = len(ids[0])
        order, group, at_a, at_b = coalesced(end - np.concatenate(lengths), end, n_a)
        side = order >= n_a
        again = np.argsort(2 * group + side, kind="stable")  # a group's A tokens, then its B tokens
        order, group, side = order[again], group[again], side[again]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        numbers = np.concatenate([ids[0], ids[1] + len(self.lengths[0])])[order]
        texts = list(map(self.texts.__getitem__, (2 * numbers + last).tolist()))
        keys = (ids[0][at_a] * self.base + ids[1][at_b]).tobytes()
        # Chunks are whole groups, so their tokens, links and groups follow one another.
        upto = np.cumsum(sizes[0] + sizes[1])
        upto_link = 8 * np.searchsorted(at_a, np.cumsum(sizes[0]), "left")
        n_groups = np.diff(group[upto - 1], prepend=-1)
        at = link = 0
        for c, to, to_link, n, m, k in zip(chunks, upto.tolist(), upto_link.tolist(), sizes[0].tolist(), sizes[1].tolist(), n_groups.tolist(), strict=True):
            self.new[c] = ("".join(texts[at:to]), keys[link:to_link], n | m << 40 | k << 80)
            at, link = to, to_link

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.new) > MEMO or self.chars > MEMO_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0
        need = set().union(*lists).difference(self.new)
        self.chars += sum(map(len, need))
        again = need & self.old.keys()
        self.new.update((c, self.old[c]) for c in again)
        part, length = [], 0
        for c in need - again:
            part.append(c)
            length += len(c)
            if length > AXIS:
                self.align(part)
                part, length = [], 0
        if part:
            self.align(part)

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups, keys of the linked pairs of ids and how often each is linked, per text."""
        lists = [[c for c in self.pattern.findall(" " + t) if c] if t else [] for t in texts]
        self.learn(lists)
        for x in lists:
            parts = list(map(self.new.__getitem__, x))
            if not parts or None in parts:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            counts = sum(p[2] for p in parts)
            keys = np.frombuffer(b"".join([p[1] for p in parts]), np.int64)
            few = (1 << 40) - 1
            yield counts & few, counts >> 40 & few, counts >> 80, len(keys), "".join([p[0] for p in parts])[:-1], *np.unique(keys, return_counts=True)


#: One aligner a worker and pair of models: what it remembers of chunks serves all tasks of the worker.
ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """Counts, the groups (empty without groups=True) and their digest, and the linked pairs of ids (as a * size of B + b) with how often, per row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = ALIGNERS.get((a_path, b_path)) or ALIGNERS.setdefault((a_path, b_path), Aligner(a_path, b_path))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                found = list(aligner.rows(part.column(1).to_pylist()))
                columns = [pa.array(list(c), pa.int64()) for c in list(zip(*found, strict=True))[:4]]
                digest = [hashlib.sha256(f[4].encode()).hexdigest() if f[0] else "" for f in found]
                offsets = pa.array(np.cumsum([0, *(len(f[5]) for f in found)]), pa.int32())
                keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[5] for f in found])))
                times = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[6] for f in found]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, pa.array(digest), pa.array([f[4] if groups else "" for f in found]), keys, times],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
                )

    return docs.mapInArrow(run, COUNTS)


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """pair, n, best: in how many rows two ids are linked, and whether no other pair of the A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pair-counts").withColumn("a", F.expr(f"pair div {base}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids, at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame, base: int) -> DataFrame:
    """found with n_best and count_sum in place of the pairs."""
    spark = found.sparkSession
    counts = pair_counts(found, base)
    # The pairs from some count upwards, HEAD at most: a histogram of the counts' logarithms tells from which.
    step, least, total = F.floor(F.log2("n") * 8), 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > HEAD:
            break
        least = r["step"]
    head = counts.filter(step >= least).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    table = spark.sparkContext.broadcast([head.column(c).to_numpy()[order] for c in ("pair", "n", "best")])
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for b in batches:
            keys, times = (b.column(b.schema.names.index(c)) for c in ("pairs", "times"))
            upto = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
            rest_upto, arrays = upto, [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
            keys, times = keys.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            known = np.zeros(len(keys), bool)
            if len(pair) and len(keys):
                at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
                known = pair[at] == keys
                for i, w in enumerate((best[at], n[at])):
                    total = np.concatenate([[0], np.cumsum(np.where(known, times * w, 0))])
                    arrays[i] = total[upto[1:]] - total[upto[:-1]]
            rest_upto = np.concatenate([[0], np.cumsum(~known)])[upto].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(rest_upto), pa.array(c[~known])) for c in (keys, times)]
            columns = [b.column(b.schema.names.index(c)) for c in ("row", *kept)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in arrays), *rest], names=["row", *kept, "n_best", "count_sum", "pairs", "times"])

    types = dict(found.dtypes)
    schema = ", ".join(["row long", *(f"{c} {types[c]}" for c in kept), "n_best long, count_sum long, pairs array<long>, times array<long>"])
    met = found.select("row", *kept, "pairs", "times").mapInArrow(run, schema)
    if total <= HEAD:  # all pairs were sent
        return met.select(*kept, "n_best", "count_sum")
    met = written(met, "alignment-scores")
    loose = met.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = loose.join(counts.filter(step < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return met.join(rest, "row", "left").select(*kept, more("n_best", "more_best"), more("count_sum", "more_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of docs."""
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = aligned(docs, a_path, b_path, id_col, text_col, groups=False).drop("groups")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "alignment")
    return scored(found, base).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
