"""Language identification with interpolated Kneser-Ney character models.

The models look at the letters of a word, with marks before and after it, so a
word's score does not depend on its neighbours: Spark counts the distinct words of
every language, and n-grams come from that table.  Continuation counts, discounts
and probabilities are joins and aggregates over all n-grams, so each n-gram of the
documents gets its log probability under each language.  The most frequent n-grams
go to all tasks as a sorted array of 64-bit hashes, of bounded size; a text's other
n-grams are joined with the table, so the result never depends on the bound.

A text gets the language of the lowest cross-entropy per letter.  The margin to the
second best is calibrated by a logistic curve; texts under REJECT are marked as not
accepted.  The language is predicted from the text alone.

Defined results: a null text, or one without a letter, is "und" with score 0.  With
nothing to learn from, every text is "und".  Ties go to the first language by name.
Repeated rows are predicted one by one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import frequent, written

ORDER = 4
#: Documents the calibration looks at, remembered words.
CALIBRATION_DOCS, MEMO = 2000, 1 << 19
#: Log probabilities, n-grams times languages, that every task gets.
HEAD = 1 << 22
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
SALT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all texts; a null lang is counted like the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[lang].update(words_of(text or ""))
            if sum(map(len, seen.values())) > MEMO:
                yield out()
                seen.clear()
        yield out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, gram, n: n-grams of ORDER characters, and shorter ones at a word's start."""
    padded = F.concat(F.lit(START), F.col("word"), F.lit(END))
    size = F.length(padded)
    full = F.when(size >= ORDER, F.transform(F.sequence(F.lit(1), size - ORDER + 1), lambda i: F.substring(padded, i, ORDER))).otherwise(F.array().cast("array<string>"))
    first = F.transform(F.sequence(F.lit(2), F.least(size, F.lit(ORDER - 1))), lambda k: F.substring(padded, F.lit(1), k))
    return words.select("lang", F.explode(F.concat(full, first)).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashes(codes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order characters up to each of ends."""
    h = np.full(len(ends), order, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(order - 1, -1, -1):
            h = (h ^ codes[ends - back]) * SALT
            h ^= h >> np.uint64(29)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Model:
    """Plain version of one language's model, which the tables equal."""

    @staticmethod
    def smooth(full: dict[str, int]) -> dict:
        """Probabilities of the seen n-grams by order, and the weights of their contexts."""
        counts: list[dict[str, float]] = [{}, {}, {}, {}, {}][: ORDER + 1]
        for g, n in full.items():
            counts[len(g)][g] = n  # of full order, or at a word's start, where nothing stands before
        for order in range(ORDER - 1, 0, -1):
            lower = counts[order]
            for g in counts[order + 1]:
                if not g[1:].startswith(START):
                    lower[g[1:]] = lower.get(g[1:], 0) + 1
        p: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        weight: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        size, rest = max(1, len(counts[1])), 0.5
        for order in range(1, ORDER + 1):
            values = list(counts[order].values())
            once, twice = values.count(1), values.count(2)
            cut = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
            total: dict[str, float] = defaultdict(float)
            kinds: Counter = Counter()
            for g, n in counts[order].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            for h, n in total.items():
                weight[order - 1][h] = cut * kinds[h] / n
            if order == 1:
                rest = weight[0].get("", 0.5)
            for g, n in counts[order].items():
                h = g[:-1]
                low = p[order - 1].get(g[1:], 1 / (size + 1)) if order > 1 else 1 / (size + 1)
                p[order][g] = (n - cut) / total[h] + weight[order - 1][h] * low
        return {"p": p, "weight": weight, "size": size, "rest": rest}

    @staticmethod
    def logp(level: dict, g: str) -> float:
        out = 0.0
        while g:
            if (p := level["p"][len(g)].get(g)) is not None:
                return out + float(np.log(p))
            out += float(np.log(level["weight"][len(g) - 1].get(g[:-1], 1.0)))
            g = g[1:]
        return out + float(np.log(1 / (level["size"] + 1)))


def levels(grams: DataFrame, langs: list[str]) -> list[DataFrame]:
    """By order from 1: at (number of the language), gram, n as Kneser-Ney counts below the full order.

    The n-grams of texts to predict come along, with a null at.
    """
    numbers = grams.sparkSession.createDataFrame(list(enumerate(langs)), "at int, lang string")
    grams = grams.join(F.broadcast(numbers), "lang", "left").select("at", "gram", "n")
    out: list[DataFrame] = []
    for order in range(ORDER, 0, -1):
        now = grams.filter(F.length("gram") == order)  # of full order, or at a word's start, where nothing stands before
        if out:
            now = now.union(out[-1].groupBy("at", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")))
        out.append(written(now, f"level-{order}"))
    return out[::-1]


def discounts(counts: list[DataFrame], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By order and language the discount, the sum and the number of the counts."""
    cut, total, kinds = (np.ones((ORDER, width)) for _ in range(3))
    for order, df in enumerate(counts):
        of = df.filter(F.col("at").isNotNull()).groupBy("at")
        for at, once, twice, n, k in of.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.sum("n"), F.count("*")).collect():
            cut[order, at] = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
            total[order, at], kinds[order, at] = n, k
    return cut, total, kinds


def dense(lists: pa.ListArray, field: str, width: int) -> np.ndarray:
    """Per row the field of its structs, at the place that the structs name."""
    out = np.zeros((len(lists), width))
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out[rows, flat.field("at").to_numpy(zero_copy_only=False)] = flat.field(field).to_numpy(zero_copy_only=False)
    return out


def gram_scores(grams: DataFrame, langs: list[str]) -> DataFrame:
    """gram, n, logp: the log probability of each n-gram's last character under each language."""
    width = len(langs)
    counts = levels(grams, langs)
    cut, total, kinds = discounts(counts, width)
    least = 1 / (kinds[0] + 1)  # of any character

    def smooth(order: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = dense(b.column(2), "n", width)
                if order == 1:
                    sums, kinds_, low = total[0], kinds[0], least
                else:
                    sums, kinds_ = dense(b.column(3), "total", width), dense(b.column(3), "kinds", width)
                    low = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                share = cut[order - 1]
                known = (np.maximum(seen - share, 0) + share * kinds_ * low) / np.maximum(sums, 1)
                p = np.where(sums > 0, known, low)
                column = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, p.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], names=["gram", "n", "p"])

        return run

    lower, out = None, None
    for order, df in enumerate(counts, 1):
        seen = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))
        now = df.groupBy("gram").agg(F.sum("n").alias("n"), seen.alias("seen"))
        if order > 1:
            context = F.substring("gram", 1, order - 1).alias("context")
            contexts = df.filter(F.col("at").isNotNull()).groupBy("at", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            contexts = contexts.groupBy("context").agg(F.collect_list(F.struct("at", "total", "kinds")).alias("sums"))
            now = now.withColumns({"context": context, "rest": F.substring("gram", 2, order)})
            now = now.join(contexts, "context", "left").join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest")
            now = now.select("gram", "n", "seen", "sums", "low")
        lower = written(now.mapInArrow(smooth(order), "gram string, n long, p array<double>"), f"probabilities-{order}")
        if order > 1:
            whole = lower if order == ORDER else lower.filter(F.col("gram").startswith(START))
            out = whole if out is None else out.union(whole)
    return out.select("gram", "n", F.transform("p", lambda x: F.log(x)).alias("logp"))


class Scorer:
    """Scores texts by the n-grams of a head table, each distinct word once while it is remembered."""

    def __init__(self, grams: list[str], logp: np.ndarray):
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        h = np.zeros(len(grams), np.uint64)
        ends, codes = np.cumsum(sizes) - 1, codes_of("".join(grams))
        for order in range(1, ORDER + 1):
            h[sizes == order] = hashes(codes, ends[sizes == order], order)
        at = np.argsort(h, kind="stable")
        self.keys, self.logp = h[at], logp[at]
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.logp.shape[1] + 1))
        self.rare: dict[int, list[str]] = {}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == h) if len(self.keys) else np.zeros(len(h), bool)

    def scores(self, words: list[str]) -> tuple[np.ndarray, dict[int, list[str]]]:
        """Per word the log probability under each language and the letters predicted; its n-grams outside the head."""
        out, rare = np.zeros((len(words), self.logp.shape[1] + 1)), defaultdict(list)
        real = [i for i, w in enumerate(words) if any(map(str.isalpha, w))]
        if not real:
            return out, rare
        text = "".join(START + words[i] + END for i in real)
        sizes = np.array([len(words[i]) + 2 for i in real])
        codes = codes_of(text)
        starts = np.cumsum(sizes) - sizes
        ends = np.setdiff1d(np.arange(len(codes)), starts, assume_unique=True)
        word = np.repeat(np.arange(len(real)), sizes - 1)
        order = np.minimum(ends - starts[word] + 1, ORDER)
        value = np.zeros((len(ends), self.logp.shape[1]))
        for k in range(2, ORDER + 1):
            now = np.flatnonzero(order == k)
            at, hit = self.find(hashes(codes, ends[now], k))
            value[now[hit]] = self.logp[at[hit]]
            for i in now[~hit].tolist():
                rare[real[word[i]]].append(text[ends[i] - k + 1 : ends[i] + 1])
        out[real, :-1] = np.add.reduceat(value, starts - np.arange(len(real)))
        out[real, -1] = sizes - 2  # letters, to tell texts without any
        return out, rare

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[Counter]]:
        """Per text the log probabilities and the letters, the number of words, and the n-grams outside the head."""
        if len(self.at) > MEMO:
            self.reset()
        at, lists = self.at, [words_of(t) for t in texts]
        new = list(set().union(*lists).difference(at)) if lists else []
        if new:
            rows, rare = self.scores(new)
            self.rare.update({len(at) + i: x for i, x in rare.items()})
            for w in new:
                at[w] = len(at)
            self.rows = np.concatenate([self.rows, rows])
        out, left = np.zeros((len(texts), self.rows.shape[1])), [Counter() for _ in texts]
        for i, words in enumerate(lists):
            if words:
                places = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                out[i] = self.rows[places].sum(axis=0)
                if self.rare:
                    for x in filter(self.rare.__contains__, places.tolist()):
                        left[i].update(self.rare[x])
        return out, list(map(len, lists)), left


def choose(total: np.ndarray, n_words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Best language of each row (-1: none) by the cross-entropy per letter and mark, and its margin."""
    logp, letters = total[:, :-1], total[:, -1]
    if not logp.shape[1]:
        return [-1] * len(total), np.zeros(len(total))
    ce = -logp / np.maximum(letters + n_words, 1)[:, None]
    best = np.where(letters > 0, ce.argmin(axis=1), -1)
    margin = np.partition(ce, 1, axis=1)[:, 1] - ce.min(axis=1) if ce.shape[1] > 1 else np.ones(len(ce))
    return best.tolist(), margin


def fitted_curve(rows: list[tuple[float, bool]]) -> tuple[float, float]:
    """Logistic curve of being right by margin, with Platt's smoothed targets."""
    if not rows:
        return 10.0, 0.0
    x, right = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    up, down = right.sum(), (~right).sum()
    y = np.where(right, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
    return float(max(0.0, w[0])), float(w[1])


def head_table(scores: DataFrame, width: int) -> tuple[list[str], np.ndarray]:
    """The most frequent n-grams, HEAD log probabilities at most."""
    found = frequent(scores, "n", HEAD // width).select("gram", "logp").toArrow()
    logp = found.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return found.column("gram").to_pylist(), logp.reshape(-1, width)


def predicted(docs: DataFrame, scores: DataFrame | None, langs: list[str]) -> DataFrame:
    """The columns of docs but text, which is the first, and lang_pred and margin."""
    width = len(langs)
    shared = docs.sparkSession.sparkContext.broadcast(head_table(scores, width) if width else ([], np.zeros((0, 0))))
    extra = docs.columns[1:]
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema.fields[1:])

    def names(best: list[int]) -> pa.Array:
        return pa.array([langs[i] if i >= 0 else "und" for i in best], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*shared.value)
        for b in batches:
            total, n, rare = score([x or "" for x in b.column(0).to_pylist()])
            best, margin = choose(total, np.array(n))
            left = [list(x.items()) or None for x in rare] if width else [None] * len(n)
            sums = pa.array([t.tolist() if x else None for t, x in zip(total, left, strict=True)], pa.list_(pa.float64()))
            grams = pa.array([x and [{"gram": g, "n": k} for g, k in x] for x in left], pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))
            arrays = [*(b.column(c) for c in extra), names(best), pa.array(margin, pa.float64()), sums, pa.array(n, pa.int64()), grams, b.column("_row")]
            yield pa.RecordBatch.from_arrays(arrays, names=[*extra, "lang_pred", "margin", "_sums", "_words", "_rare", "_row"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.array(b.column("_sums").to_pylist()).reshape(-1, width + 1)
            total[:, :-1] += np.array(b.column("_more").to_pylist()).reshape(-1, width)
            best, margin = choose(total, b.column("_words").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), names(best), pa.array(margin, pa.float64())], names=[*extra, "lang_pred", "margin"])

    first = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        run, f"{kept}lang_pred string, margin double, _sums array<double>, _words long, _rare array<struct<gram: string, n: long>>, _row long"
    )
    first = written(first, "texts")
    done = first.filter(F.col("_rare").isNull()).select(*extra, "lang_pred", "margin")
    if not width:
        return done
    open_ = first.filter(F.col("_rare").isNotNull())
    grams = open_.select("_row", F.inline("_rare").alias("gram", "n")).join(scores.select("gram", "logp"), "gram")
    more = grams.groupBy("_row").agg(F.array(*(F.sum(F.col("n") * F.col("logp")[i]) for i in range(width))).alias("_more"))
    return done.union(open_.drop("_rare").join(more, "_row").mapInArrow(settled, f"{kept}lang_pred string, margin double"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every document.

    Learns from the documents that are not held out and have a language.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    d = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.when(~held_out, F.col("lang")).alias("lang"))
    grams = written(gram_counts(word_counts(d)), "grams")
    langs = sorted(r.lang for r in grams.filter(F.col("lang").isNotNull()).select("lang").distinct().collect())
    found = written(predicted(d, gram_scores(grams, langs) if langs else None, langs), "margins")
    train = found.filter(F.col("lang").isNotNull())
    every = max(1, train.count() // CALIBRATION_DOCS)
    sample = train.filter((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & (F.col("lang_pred") != "und"))
    a, b = fitted_curve([tuple(r) for r in sample.select("margin", F.col("lang_pred") == F.col("lang")).limit(4 * CALIBRATION_DOCS).collect()])
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("margin") + b))
    score = F.when(F.col("lang_pred") != "und", 1 / (1 + F.exp(-z))).otherwise(0.0)
    return found.select("doc_id", "held_out", "lang_pred", score.alias("score"), (score >= REJECT).alias("accepted"))
