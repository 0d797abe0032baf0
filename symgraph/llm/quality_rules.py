"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself (end punctuation, navigation separators, symbol
noise, shouting, boilerplate phrases).  Failing lines are removed; a document
that loses too much of its text with them is rejected, as is one that fails the
document rules (too few words, too much repetition).

Defined results: null and empty texts have no words, so they fail the base rule.
Repeated rows are judged one by one.  Only the id and text columns are read, so
other columns, whatever their names, have no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import SPACE

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document must keep so many percent of its word characters.
MIN_KEPT_PERCENT = 50
#: A shorter line needs punctuation at its end.
FRAGMENT_CHARS = 60
#: Boilerplate phrases count in lines of at most so many characters.
BOILERPLATE_CHARS = 150
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
LINE_END = r"[.!?…:;)\]\"'”’»][\x20\x09-\x0D]*\z"
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|is licensed|released under|terms of (use|service)|privacy policy|"
    r"cookie|javascript|subscribe|newsletter|click here|sign (in|up)|log in|read more|share this|back to top"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_matches(text: Column, pattern: str) -> Column:
    """How many characters a one-character pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def n_word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def line_fails(line: Column) -> Column:
    """Whether the line is to be removed; a line without words stays.

    The cheap tests come first: most lines need no counting.
    """
    size = F.length(line)
    seps = n_matches(line, SEPARATORS)
    shouts = (size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    fragment = (size < FRAGMENT_CHARS) & ~line.rlike(LINE_END)
    boilerplate = (size <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    noise = line.rlike(SYMBOLS) & (n_matches(line, SYMBOLS) * 10 >= size)
    navigation = line.rlike(SEPARATORS) & (seps >= 2) & (seps * 24 >= size)
    shouting = line.contains("!!") & (shouts >= 2) & (shouts * 24 >= size)
    return (fragment | boilerplate | noise | navigation | shouting) & line.rlike(WORD)


def in_runs(items: Column, same: Column) -> Column:
    """The items that equal the one before or after them; same tells whether each equals the one after it.  Null if there are none."""
    before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(same) - 1))
    return F.when(F.array_contains(same, True), F.filter(F.arrays_zip(items.alias("at"), same.alias("x"), before.alias("y")), lambda p: p["x"] | p["y"])["at"])


#: Prefix of the columns that judged() adds.
P = "_line_first_"


def col(name: str) -> Column:
    return F.col(P + name)


def added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({P + k: v for k, v in columns.items()})


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the figures, the verdict and the cleaned text in columns of prefix P.

    Each step is a projection of its own: what several later expressions read is
    a column by then and computed once.
    """
    d = added(docs, {"t": F.coalesce(F.col(text_col), F.lit(""))})
    t = col("t")
    d = added(d, {"w": words_of(t), "lines": F.split(t, "\n")})
    d = added(d, {"n_words": F.size(col("w")), "bits": F.length(F.bin(F.size(col("w"))))})
    w, lines, n = col("w"), col("lines"), col("n_words")
    # One number for each 3-word window: its hash above, its position below.  What this
    # shorter hash takes for equal is compared again by a full one of another seed.
    keys = F.when(
        n >= 3,
        F.expr(f"transform(sequence(0, size({P}w) - 3), i -> shiftleft(xxhash64({P}w[i], {P}w[i + 1], {P}w[i + 2]), {P}bits) | i)"),
    )
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    d = added(
        d,
        {
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": n_matches(t, SYMBOLS),
            "worded": worded,
            "n_lines": F.size(lines),
            "s": F.sort_array(keys),
            "good": F.filter(lines, lambda x: ~line_fails(x)),
        },
    ).drop(P + "t", P + "lines")
    # The windows are sorted by their words' hash, so equal ones are neighbours.
    d = added(
        d,
        {
            "same": F.expr(f"zip_with({P}s, slice({P}s, 2, size({P}s)), (x, y) -> shiftright(x, {P}bits) <=> shiftright(y, {P}bits))"),
            "clean": F.array_join(col("good"), "\n"),
            "n_dup_lines": F.size(col("worded")) - F.size(F.array_distinct(col("worded"))),
            "n_failed_lines": col("n_lines") - F.size(col("good")),
        },
    ).drop(P + "worded", P + "good", P + "n_lines")
    # A window counts if it equals the one before or after it in that order.
    d = added(d, {"maybe": in_runs(col("s"), col("same"))}).drop(P + "same", P + "s")
    place = f"cast(p & (shiftleft(1L, {P}bits) - 1) as int)"
    again = F.expr(f"transform({P}maybe, p -> named_struct('h', xxhash64(7, {P}w[{place}], {P}w[{place} + 1], {P}w[{place} + 2]), 'i', {place}))")
    d = added(d, {"r": F.sort_array(again)})
    d = added(d, {"same": F.expr(f"zip_with({P}r, slice({P}r, 2, size({P}r)), (x, y) -> x.h <=> y.h)")}).drop(P + "maybe", P + "w", P + "bits")
    d = added(d, {"rep": in_runs(col("r"), col("same")), "left": F.when(col("n_failed_lines") > 0, n_word_chars(col("clean"))).otherwise(col("word_chars"))}).drop(P + "same", P + "r")
    d = added(d, {"covered": F.size(F.array_distinct(F.flatten(F.expr(f"transform({P}rep, p -> array(p.i, p.i + 1, p.i + 2))"))))}).drop(P + "rep")
    d = added(d, {"n_repeat_words": F.when(col("covered") > 0, col("covered")).otherwise(0)})
    d = added(d, {"base_failed": (col("n_words") < MIN_WORDS) | (col("n_repeat_words") * 100 > col("n_words") * MAX_REPEAT_PERCENT)})
    return added(d, {"kept": ~col("base_failed") & (col("left") * 100 >= col("word_chars") * MIN_KEPT_PERCENT)})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base figures, base_failed, kept and n_failed_lines."""
    d = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select(
        "doc_id",
        *[col(c).cast("long").alias(c) for c in figures],
        col("base_failed").alias("base_failed"),
        col("kept").alias("kept"),
        col("n_failed_lines").cast("long").alias("n_failed_lines"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of docs."""
    cols = docs.columns
    # The row number keeps the filter above the projections: pushed down through them,
    # it would repeat their expressions many times over.
    d = judged(docs).select(*[F.col(c) for c in cols], col("kept"), col("clean"), F.monotonically_increasing_id().alias(P + "row"))
    d = d.filter(col("kept") & (col("row") >= 0))
    text = col("clean")
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    return d.select(*[out[c].alias(c) if c in out else F.col(c) for c in cols])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, length(line) AS size,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
             length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS seps,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS syms,
             (length(line) - length(replace(line, '!!', ''))) / 2 AS shouts
      FROM (SELECT rid, unnest(lines) AS line FROM w)),
j AS (SELECT rid, line, worded, chars, worded AND (
        (size < 60 AND NOT regexp_matches(line, '[.!?…:;)\]\"''”’»][\x20\x09-\x0D]*\z'))
        OR (seps >= 2 AND seps * 24 >= size) OR (syms > 0 AND syms * 10 >= size) OR (shouts >= 2 AND shouts * 24 >= size)
        OR (size <= 150 AND regexp_matches(line, '(?i)all rights reserved|licensed under|is licensed|released under|terms of (use|service)|privacy policy|cookie|javascript|subscribe|newsletter|click here|sign (in|up)|log in|read more|share this|back to top'))) AS bad
      FROM l),
k AS (SELECT rid, count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS kept_chars,
             count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded) AS n_dup_lines FROM j GROUP BY rid),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(k.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             k.kept_chars, CAST(k.n_failed_lines AS BIGINT) AS n_failed_lines
      FROM w JOIN k USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= word_chars * 50 AS kept,
       n_failed_lines
FROM f
"""
