"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary crosses a white-space marker or a line feed, a
text's segmentation is the segmentation of its marked words one after the other.
Spark counts the distinct marked words of the whole corpus; the most frequent
ones are segmented once, by executors, and their ids go to all tasks as a table of
bounded size (HEAD words of at most MAX_CHUNK characters).  A task then joins the
ids back by position.  Words beyond the table are segmented where they occur, once
per task, so the result never depends on the bound.

Defined results: a null or empty text has the begin and end ids only and decodes
to an empty string.  Rows are encoded one by one, so repeated rows repeat their
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import frequent, written

#: Size bounds of the table that every task gets.
HEAD, MAX_CHUNK = 1 << 18, 32
#: Entries of the counts a task gathers, and rare chunks it remembers besides the table.
MEMO, RARE = 1 << 19, 1 << 16
#: Documents whose chunks are lists at a time.
SLICE = 100
MARK = "▁"
CHUNK = re.compile(f"\n+|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")
WHOLE = re.compile(r"(?s).+")


class Codec:
    """Segments chunks with a model and puts texts together from them."""

    def __init__(self, model: str, table: pa.Table | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = "\nﬁ  Ａ\u3000½ x "  # comes back unchanged if the model's normalisation changes nothing
        plain = self.sp.decode(self.sp.encode(probe)) == probe
        crosses = any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in pieces)
        guard = self.sp.encode("\n")
        self.whole = crosses or not plain or len(guard) != 2 or self.sp.id_to_piece(guard[0]) != MARK
        self.ids: dict[str, bytes] = {}
        self.text: dict[bytes, str] = {}
        self.rare: tuple[list[str], list[bytes]] = [], []  # what is known besides the table
        for b in table.to_batches(max_chunksize=10_000) if table else ():
            chunks, ids, decoded = (c.to_pylist() for c in b.columns)
            self.ids.update(zip(chunks, ids, strict=True))
            self.text.update(zip(ids, decoded, strict=True))

    def forget(self) -> None:
        """Knows the chunks of the table only."""
        for known, new in zip((self.ids, self.text), self.rare, strict=True):
            for key in new:
                del known[key]
            new.clear()

    def chunks(self, text: str) -> list[str]:
        return (WHOLE if self.whole else CHUNK).findall(text if self.whole or not text else " " + text)

    def segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """ids as little-endian 32-bit numbers, and what they decode to.

        A line feed before the chunk stands for what precedes it in a text: no
        piece crosses it, and no dummy mark goes between.
        """
        if self.whole:
            found = self.sp.encode(chunks, num_threads=1)
            return [(np.array(x, "<u4").tobytes(), y) for x, y in zip(found, self.sp.decode(found), strict=True)]
        found = self.sp.encode(["\n" + c for c in chunks], num_threads=1)
        texts = self.sp.decode(found, num_threads=1)
        return [(np.array(x[2:], "<u4").tobytes(), y[1:]) for x, y in zip(found, texts, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Segments chunks that are not known yet."""
        for c, (ids, text) in zip(chunks, self.segment(chunks), strict=True):
            self.ids[c] = ids
            self.rare[0].append(c)
            if ids not in self.text:
                self.text[ids] = text
                self.rare[1].append(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        bos, eos = (np.array([x], "<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))
        if len(self.rare[0]) > RARE:
            self.forget()
        chunks, ends = [], [0]
        for t in texts:
            chunks += self.chunks(t)
            ends.append(len(chunks))
        found = list(map(self.ids.get, chunks))
        late = [i for i, x in enumerate(found) if x is None]
        if late:
            self.learn(list({chunks[i] for i in late}))
            for i in late:
                found[i] = self.ids[chunks[i]]
        self.parts = [found[a:b] for a, b in pairwise(ends)]
        return [bos + b"".join(x) + eos for x in self.parts]

    def decode_last(self) -> list[str]:
        """Texts of the last encode(), by the ids of their chunks."""
        skip = 0 if self.whole else 1  # the mark that encoding put before the text
        return ["".join(map(self.text.__getitem__, x))[skip:] for x in self.parts]


def chunk_counts(docs: DataFrame, model: str) -> DataFrame:
    """chunk, n: in how many batches of documents each marked word of at most MAX_CHUNK characters occurs, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = Codec(model), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(codec.chunks(text))
            if len(seen) > MEMO:
                yield out()
                seen.clear()
        yield out()

    counted = docs.select("text").mapInArrow(run, "chunk string, n long")
    return counted.filter(F.length("chunk") <= MAX_CHUNK).groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: str) -> DataFrame:
    """chunk, ids, decoded for the HEAD most frequent chunks, each segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in batches:
            found = codec.segment(b.column(0).to_pylist())
            ids, texts = pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, texts], names=["chunk", "ids", "decoded"])

    counts = written(chunk_counts(docs, model), "chunks")
    return frequent(counts, "n", HEAD).select("chunk").mapInArrow(run, "chunk string, ids binary, decoded string")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers with begin and end ids), decoded and the columns to keep, per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    head = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model).toArrow())  # at most HEAD rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, head.value)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                arrays = [part.column(0), pa.array(ids, pa.binary()), pa.array(codec.decode_last(), pa.string()), *(part.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded", *keep])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, f"doc_id long, ids binary, decoded string{kept}")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *keep,
    )
