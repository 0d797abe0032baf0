"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at the hits, checksums.

An automaton finds the keywords in one pass over a text; a pattern is only tried
where a keyword begins.  Long runs of hexadecimal digits have no keyword and are
found by one run pattern.  Tokens that carry a checksum (CRC-32 in base 62 at the
end) only count if it is right.

Defined results: a null text is empty and has no spans.  Rows are scanned one by
one, so repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: Fixed keywords and patterns.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS = 6, 20

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def checksum(body: str) -> str:
    """CRC-32 of the token's body as six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in GITHUB_WORDS:
        found.add_word(word, ("github", len(word)))
    found.add_word("npm_", ("npm", 4))
    found.make_automaton()
    return found


def scan(text: str, words) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    spans = []
    free = {"assign": 0, "access": 0}  # where the last match of the kind ended, failing ones too
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    for last, (kind, size) in words.iter(lower):
        at = last + 1 - size
        if kind in free:
            if at < free[kind]:
                continue
            if m := (ASSIGN if kind == "assign" else ACCESS).match(text, at):
                free[kind] = m.end()
                if len(m[1]) >= MIN_ASSIGN if kind == "assign" else m.end() - at >= MIN_ACCESS:
                    spans.append((kind, at, m.end()))
        elif (m := CHECKED.match(text, at)) and checksum(m[1]) == m[2]:
            spans.append((kind, at, m.end()))
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the counts of the base kinds, their digest and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = scan(text or "", words)
                base = [x for x in spans if x[0] in BASE]
                n = [sum(x[0] == kind for x in base) for kind in BASE]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by [SECRET]; no document goes."""
    cols = docs.columns
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := scan(text, words)):
                    out, end = [], 0
                    for _, start, stop in spans:
                        if start >= end:
                            out += [text[end:start], "[SECRET]"]
                        end = max(end, stop)
                    texts[i] = "".join([*out, text[end:]])
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out
