"""Word codes and sliced batches for the operators on word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
R1, R2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(32)


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in UTF-8 (null: empty), some MB at a time, with the index of the first."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size > SLICE_BYTES:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-mixed number for each number."""
    h = (h ^ (h >> SHIFT)) * M1
    h = (h ^ (h >> SHIFT)) * M2
    return h ^ (h >> SHIFT)


@lru_cache(maxsize=4)
def powers(r: int, n: int) -> np.ndarray:
    """The first n powers of r modulo 2 ** 64."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, r, np.uint64)]))


class Sums:
    """Hashes of any stretches of one sequence of codes, all at once."""

    def __init__(self, codes: np.ndarray, r: np.uint64):
        n = len(codes)
        size = 1 << max(16, n.bit_length())  # few different sizes, so the powers are there already
        self.up = powers(int(r), size)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(pow(int(r), -1, 1 << 64), size)[:n], out=self.sum[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - begin).astype(np.uint64)
        return mixed((self.sum[end] - self.sum[begin]) * self.up[begin] + size)


#: The lowest n bytes of a number, by n.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SEED, STEP = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFA0A5A73)


def word_codes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; data goes on for eight bytes behind the last."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * STEP + SEED
    live, k = np.arange(len(begin)), 0
    while len(live):
        rest = np.minimum(size[live] - k, 8)
        h[live] = mixed((h[live] ^ (eight[begin[live] + k] & MASKS[rest])) * STEP)
        k += 8
        live = live[size[live] > k]
    return h


class Words:
    """The words of some texts in one sequence: codes, rows, and sizes and starts by row.

    Words are what ASCII white space separates; a word's code is a 64-bit hash of
    its bytes, with A-Z as a-z on demand.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n" + b"\n".join(texts) + b"\n" * 8
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # lower() of bytes changes A-Z only
        blank = (data == 0x20) | (data - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        self.codes = word_codes(data, begin, end - begin)
        first = np.cumsum([1, *(len(t) + 1 for t in texts)])  # where each text begins
        at = np.searchsorted(begin, first)
        self.starts, self.sizes = at[:-1], np.diff(at)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)


def packed(bucket: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows put together by bucket, as (bucket, bytes).

    The fields follow one another, each for all rows: what is alike in neighbouring
    rows (ids, sizes) then nearly vanishes when Spark compresses its shuffle files.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = runs(bucket)
    ends = [*cuts[1:], len(bucket)]
    fields = [np.ascontiguousarray(rows[name]) for name in rows.dtype.names]
    return bucket[cuts].tolist(), [b"".join(f[a:b].tobytes() for f in fields) for a, b in zip(cuts, ends, strict=False)]


def unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = np.zeros(sum(map(len, blobs)) // dtype.itemsize, dtype)
    at = 0
    for blob in blobs:
        n, offset = len(blob) // dtype.itemsize, 0
        for name in dtype.names:
            out[name][at : at + n] = np.frombuffer(blob, dtype[name], n, offset)
            offset += n * dtype[name].itemsize
        at += n
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
