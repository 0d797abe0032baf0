"""Small tables with everything that may go wrong, and plain versions of the operators."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return [w.decode("utf-8") for w in WORD.findall((text or "").encode())]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    """Texts with copies, near copies, shared passages, runs, odd characters and edge cases."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ε", "the", "of", "and", "naïve", "x|y", "##", "end."] + [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [prose(120) + "." for _ in range(6)]
    passage = prose(70)
    out = [None, "", "   \t\n", "word", "a b c", "A B C", "one two three four five", "\u00a0nbsp\u00a0stays \u2003wide"]
    out += base + [base[0], base[1], base[1].upper(), base[2] + " extra words here", "lead " + base[3]]
    out += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)]
    out += ["run. " * 150, "run. " * 90, "ab cd " * 60, prose(5000), "x" * 20000, "line one.\nline one.\n" * 5]
    out += [" ".join(base[4].split()[:n]) for n in (49, 50, 51, 6, 7, 8)]
    for i in range(4):  # near copies of one another
        w = base[5].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    short = [f"s{i}" for i in range(9)]
    out += [" ".join(short), " ".join([*short, "t1"]), " ".join(short[1:]), " ".join([*short, "t1", "t2", "t3", "t4"])]
    return out


def rows():
    langs, sources = ["en", "de", None], ["a", "b", "c", None]
    out = [(i, t, langs[i % 3], sources[i % 4], None if t is None else len(t), -1, "clash") for i, t in enumerate(texts())]
    return [*out, out[9], (None, "null id text with words", "en", "a", 5, 0, ""), (10_000_000_000, texts()[9], None, None, None, None, None)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def same(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    for g, w in zip(got, want, strict=False):
        assert g == w, (g, w)
    assert len(got) == len(want)
