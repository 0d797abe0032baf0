import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import (
    html_text, jaccard_join, language_id, quality_rules, secret_scan, sentencepiece_codec, source_mix, substring_dedup, url_filter,
    vector_search,
)
from symgraph.llm.queries import piece_model
from tests.llm.common import docs, empty, rows, sha, same, texts, words

# 1 SentencePiece


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def plain_codes(sp, text):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids))


def test_sentencepiece_equals_library(spark, processor):
    got = sentencepiece_codec.digests(sentencepiece_codec.encode(docs(spark), piece_model()))
    same(got, [(r[0], *plain_codes(processor, r[1])) for r in rows()])
    assert sentencepiece_codec.encode(empty(spark), piece_model()).count() == 0


def test_sentencepiece_random_texts(processor):
    import random

    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "\t", "\r", "\x00", "ﬁ", "🎉", "의", "the", "ing", "<s>", "\u3000", "\xa0", "1", "</s>", "<0x0A>", "▁▁"]
    found = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    codec = sentencepiece_codec.Codec(piece_model())
    assert not codec.whole
    for text, ids, back in zip(found, codec.encode(found), codec.decode_last(), strict=True):
        want = processor.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert back == processor.decode(want), repr(text)


def test_sentencepiece_forgets_rare_chunks_only(processor, monkeypatch):
    import pyarrow as pa

    codec, reads = sentencepiece_codec.Codec(piece_model()), []

    class Table:
        def to_batches(self, **_):
            reads.append(1)
            return pa.table([[" the", " \x01"], *zip(*codec.segment([" the", " \x01"]), strict=True)], names=["chunk", "ids", "decoded"]).to_batches()

    monkeypatch.setattr(sentencepiece_codec, "RARE", 2)
    codec = sentencepiece_codec.Codec(piece_model(), Table())
    for i in range(20):
        texts = [f"the a{i} b{i} \x01", f"\x01 a{i} c{i % 3} the the", ""]
        want = [processor.encode(t, add_bos=True, add_eos=True) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want
        assert codec.decode_last() == [processor.decode(x) for x in want]
        assert len(codec.ids) <= 2 + 2 + 4  # the table, what RARE allows and one call's
    assert len(reads) == 1


# 2 Substring dedup


def plain_dedup(data, size=50):
    first = {}
    for i, text in ((r[0], r[1]) for r in data if r[0] is not None):
        w = words(text)
        for at in range(len(w) - size + 1):
            k = tuple(w[at : at + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, text in ((r[0], r[1]) for r in data):
        w = words(text)
        gone = set()
        for at in range(len(w) - size + 1):
            if i is not None and first[tuple(w[at : at + size])] < i:
                gone.update(range(at, at + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup(spark):
    same(substring_dedup.dedup(docs(spark)), plain_dedup(rows()))
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_substring_dedup_random_passages(spark):
    """Repeats of just 50 words at any place, in texts of a small vocabulary with runs."""
    import random

    rng = random.Random(8)
    data = []
    pool = [[rng.choice("abcdefgh") for _ in range(rng.choice([49, 50, 51, 60]))] for _ in range(12)] + [["r"] * 55, ["p", "q"] * 30]
    for i in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 40))] + rng.choice(pool)
        data.append((rng.randint(0, 10_000), " ".join(w), "en", "a", 0, 0, ""))
    same(substring_dedup.dedup(docs(spark, data)), plain_dedup(data))


# 3 URL filter

URLS = [
    None, "", "no scheme/x", "http://Example.ORG/es/1", "https://a.example.org/en/17?x", "http://example.org", "http://example.org/en/2#a", "x://host.com/de/", "http://my.com/fr/a",
    "http://org/", "http://aorg/", "http://a.net/p", "http://a.net/q", "http://b.co.uk/", "://", "http://É.net/ÄB", "http://h.com?de/", "http://u@h.com:8/de/x",
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_url_rules_and_reputation(spark):
    data = [(i, u, "clash") for i, u in enumerate(URLS * 4)] + [(500, URLS[3], "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame([(i, int(u == "http://a.net/p")) for i, u in enumerate(URLS * 4) if u and "net" in u], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, url_filter.RULES, outcomes).collect()}
    assert len(got) == len(data)
    for i, u, _ in data:
        host, path, rule = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1])
        if rule:
            assert got[i].verdict == rule[0]
        assert got[i].verdict in ("allow", "block")
    none = spark.createDataFrame([], "page_id long, good int")
    assert url_filter.url_filter(pages, url_filter.RULES, none).count() == len(data)
    assert url_filter.url_filter(pages.limit(0), url_filter.RULES, none).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("good.a.com", 50, 48.0), ("bad.b.com", 50, 2.0), ("new.a.com", 0, 0.0), ("one.b.com", 1, 1.0)], "host string, n long, good double")
    r = {x.host: x for x in url_filter.reputation(hosts).collect()}
    assert r["good.a.com"].bound > 0.5 > r["bad.b.com"].bound
    assert r["bad.b.com"].mean < r["one.b.com"].mean < 1.0
    assert r["new.a.com"].mean > r["one.b.com"].mean - 1


# 4 Vector search


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:600] = x[300]  # one vector often
    data = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    data += [(9000, None, 1, ""), (9100, [0.0] * 16, 1, ""), (9200, [float("nan")] * 16, 1, ""), (9300, [None] * 16, 1, ""), (9400, [float("inf")] * 16, 1, ""), (9500, [1.0], 1, "")]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in vector_search.search(vectors).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(f[2] == d[f[1]] for f in found)
        hit += len({f[1] for f in found} & set(best))
    assert hit >= 0.9 * 150
    assert [f[1] for f in got[300]] == list(range(301, 311))
    assert vector_search.search(vectors.limit(0)).count() == 0
    assert vector_search.search(vectors.filter("vec_id in (0, 1, 2)")).count() == 2


def nearest(x, q, k):
    """The ids of the k nearest rows of x to row q, by brute force."""
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k]


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.25), (64, None), (384, 0.25), (384, None)])
def test_vector_search_recall_in_a_block(dim, spread):
    """Recall of collision counting itself; clusters need fewer than half of the rows verified."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((vector_search.BLOCK, dim))
    if spread:
        x = rng.standard_normal((200, dim))[rng.integers(0, 200, len(x))] + spread * x
    asked = np.arange(0, len(x), 200)
    hit, verified = 0, []
    for i, place, _, n in vector_search.best(x, np.arange(len(x)), x[asked], asked, 10):
        hit += len(set(place.tolist()) & set(nearest(x, asked[i], 10).tolist()))
        verified.append(n)
    assert hit >= 0.9 * 10 * len(asked)
    assert np.mean(verified) < (0.5 if spread else 0.99) * len(x)


def test_vector_search_recall_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))[rng.integers(0, 300, 20000)] + 0.4 * rng.standard_normal((20000, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(vectors, query_mod=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 20000, 500))
    assert sum(len(found & set(nearest(x, q, 10).tolist())) for q, found in got.items()) >= 0.9 * 10 * len(got)


def test_vector_search_repeated_rows(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(7, [1.0, 0.5])] * 400 + [(3, [1.0, 0.25]), (5, [1.0, 2.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.search(vectors).collect())
    assert got == [(0, 1, 3, 0.25), *((0, i, 7, 0.5) for i in range(2, 11))]


# 5 Language identification


def test_language_id(spark):
    import random

    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "wh", "er"], "de": ["sch", "ung", "keit", "ü", "der"], "fr": ["eau", "é", "oi", "que", "ê"]}
    data = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        data.append((i, text, lang if i % 10 else None, "s", 1, 1, ""))
    data += [(1000, None, "en", "s", 1, 1, ""), (1001, "123 ... 4²", "de", "s", 1, 1, ""), (1002, "", None, "s", 1, 1, ""), (1003, "a" * 30000, "en", "s", 1, 1, ""), data[5]]
    got = language_id.identify(docs(spark, data)).collect()
    assert len(got) == len(data)
    right = {i: parts for i, *parts in ((r[0], r[2]) for r in data)}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (1000, 1001, 1002)] == ["und"] * 3
    held = [r for r in got if r.held_out and r.doc_id < 1000 and right[r.doc_id][0]]
    assert np.mean([r.lang_pred == right[r.doc_id][0] for r in held]) >= 0.95
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs(spark, [(2, "abc", None, "s", 1, 1, "")])).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    model = language_id.Model.smooth({"\x02ab": 4, "\x02a": 5, "abc\x03": 3, "\x02abc": 3, "abd\x03": 1, "\x02abd": 1})
    for order in range(1, language_id.ORDER + 1):
        for h in model["weight"][order - 1]:
            seen = [p for g, p in model["p"][order].items() if g[:-1] == h]
            assert sum(seen) <= 1 + 1e-9


def labelled(parts, n):
    import random

    rng = random.Random(6)
    langs = sorted(parts)
    return [(i, " ".join("".join(rng.choices(parts[langs[i % len(langs)]], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))), langs[i % len(langs)], "s", 1, 1, "") for i in range(n)]


@pytest.mark.parametrize("head", [0, 60, 1 << 22])
def test_kneser_ney_tables_equal_plain(spark, monkeypatch, head):
    """Log probabilities and predictions are those of the plain models, however few n-grams the head holds."""
    monkeypatch.setattr(language_id, "HEAD", head)
    data = labelled({"en": ["the", "ing", "wh", "er"], "de": ["sch", "ung", "ü", "der"], "zh": ["漢", "字", "🎉語", "a"]}, 90) + [(90 + i, t, None, "s", 1, 1, "") for i, t in enumerate(["ünseen wörds", "x", "漢a ² the"])]
    d = docs(spark, data)
    grams = language_id.gram_counts(language_id.word_counts(d))
    full = {}
    for lang, g, n in grams.collect():
        full.setdefault(lang, {})[g] = n
    langs = ["de", "en", "zh"]
    plain = [language_id.Model.smooth(full[x]) for x in langs]
    want = {g: [language_id.Model.logp(m, g) for m in plain] for c in full.values() for g in c}
    got = {r.gram: r for r in language_id.gram_scores(grams, langs).collect()}
    assert set(got) == set(want)
    for g, logp in want.items():
        assert np.allclose(got[g].logp, logp, atol=1e-9) and got[g].n == sum(c.get(g, 0) for c in full.values()), g
    held = {i for i, *_ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    train = [(i, t, None if i in held else x, *rest) for i, t, x, *rest in data]
    full = {}
    for lang, g, n in language_id.gram_counts(language_id.word_counts(docs(spark, train))).collect():
        full.setdefault(lang, {})[g] = n
    plain = [language_id.Model.smooth(full[x]) for x in langs]
    by = {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}
    for i, text, *_ in data:
        total = np.zeros(3)
        for w in language_id.words_of(text):
            if any(map(str.isalpha, w)):
                w = language_id.START + w + language_id.END
                total += [sum(language_id.Model.logp(m, w[max(0, at - 3) : at + 1]) for at in range(1, len(w))) for m in plain]
        assert by[i] == langs[int(np.argmax(total))], i


def test_language_of_few_documents_beside_a_large_one(spark):
    """Nothing is left out of the models, however many n-grams the other language has."""
    rng = np.random.default_rng(1)
    many = [" ".join("".join(map(chr, x)) for x in rng.integers(0xAC00, 0xD7A3, (60, 6))) for _ in range(2000)]
    data = [(i, t, "ko", "s", 1, 1, "") for i, t in enumerate(many)]
    few = {5000: "abcdefgh", 5001: "ijklmnop", 5002: "qrstuvwx", 5003: "yzäöüß"}
    data += [(i, t, "xx", "s", 1, 1, "") for i, t in few.items()]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, data)).collect()}
    assert {got[i] for i in few} == {"xx"}


# 6 Quality rules


def plain_quality(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    cover = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_figures(spark):
    got = quality_rules.quality(docs(spark)).collect()
    want = {r[0]: plain_quality(r[1]) for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        n, chars, symbols, dup, repeat = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        assert r.n_repeat_words == repeat, r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(empty(spark)).count() == 0


def test_quality_of_a_very_long_text(spark):
    """Also where the short hash takes different windows for equal."""
    text = " ".join(f"{i * 7919 % 400_009:x}" for i in range(400_000))
    data = [(1, text, "en", "s", 0, 0, ""), (2, text + " end. " + text[:40], "en", "s", 0, 0, "")]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality(docs(spark, data)).collect()}
    assert got == {i: plain_quality(t)[4] for i, t, *_ in data} and got[1] == 0 < got[2]


def test_quality_lines(spark):
    body = "\n".join(" ".join(f"word{i * 20 + j}" for j in range(20)) + "." for i in range(5))
    data = [(1, body + "\nHome | About | Contact\nAll rights reserved.", "en", "s", 0, 0, ""), (2, "\n".join(["a | b | c | d | e | f | g"] * 1 + [f"x{i} | y{i} | z{i}" for i in range(40)]), "en", "s", 0, 0, "")]
    kept = quality_rules.clean(docs(spark, data)).collect()
    assert [(r.doc_id, r.text, r.n_chars, r.score) for r in kept] == [(1, body, len(body), "")]
    assert quality_rules.clean(docs(spark, data)).columns == docs(spark, data).columns


# 7 Secrets

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def plain_secrets(text):
    t = text or ""
    kinds = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
    counts = [sum(x[1] == k for x in found) for k in range(3)]
    return (*counts, sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)))


SECRETS = [
    "password = 'abcdef'", "PassWord:abc", "token=token=abcdefgh secret: xyz123456", "apikey=\"0123456789abcdef0123456789\" api_key = a.b-c_d/e+f", "AKIA" + "A" * 16 + "é",
    "AKIAAKIA" + "B" * 10, "akia" + "A" * 16, "xAKIA12345", "deadbeef" * 3 + "DEADBEEF", "İ password = İsecret=abcdef1", "paſſword = abcdefg", "é" * 10 + "secret= abcdef" * 3, None,
    "password password=password:abcdefgh", "ghp_" + "x" * 30 + secret_scan.checksum("x" * 30), "ghp_" + "x" * 36, "toKen = longvalue1",
]


def test_secrets(spark):
    data = [(i, t, "en", "s", 0, 0, "") for i, t in enumerate([*SECRETS, *texts()])]
    got = secret_scan.secrets(docs(spark, data))
    same(got.drop("spans"), [(i, *plain_secrets(t)) for i, t, *_ in data])
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert spans[14] == "github:0:40" and spans[15] == ""
    assert secret_scan.secrets(empty(spark)).count() == 0


def test_redaction(spark):
    data = [(1, "a token = abcdef1234 b", "en", "s", 0, 0, "x"), (2, "clean text", "en", "s", 10, 0, ""), (3, None, "en", "s", None, 0, "")]
    out = {r.doc_id: r for r in secret_scan.redact(docs(spark, data)).collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == 12 and out[2].text == "clean text" and out[3].text is None


# 8 Jaccard join


def plain_groups(data):
    def shingles(text):
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(data)):
        for j in range(i):
            same_ = len(sets[i] & sets[j])
            if same_ and 100 * same_ >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(data)]


def test_jaccard_groups(spark):
    same(jaccard_join.groups(docs(spark)), plain_groups(rows()))
    assert jaccard_join.groups(empty(spark)).count() == 0


@pytest.mark.parametrize("common", [0, 16])
def test_jaccard_random(spark, common, monkeypatch):
    """Near copies of all sizes and similarities, also with nearly all tokens taken as common."""
    import random

    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rng = random.Random(common)
    data = []
    for i in range(260):
        if data and rng.random() < 0.6:
            w = words(rng.choice(data)[1])
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 30)}"
            w = w[rng.randint(0, 2) :] + [f"t{rng.randint(0, 5)}" for _ in range(rng.randint(0, 2))]
        else:
            w = [f"v{rng.randint(0, 40)}" for _ in range(rng.choice([3, 6, 8, 9, 10, 12, 15, 40, 100]))]
        data.append((i * 3, " ".join(w or ["z"]), "en", "s", 0, 0, ""))
    same(jaccard_join.groups(docs(spark, data)), plain_groups(data))


def test_jaccard_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with few or many edits: lists of hundreds, in parts, of which some members link and others do not."""
    import random

    monkeypatch.setattr(jaccard_join, "PART", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    data = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        data.append((i, " ".join(w), "en", "s", 0, 0, ""))
    same(jaccard_join.groups(docs(spark, data)), plain_groups(data))


def test_representatives(spark):
    keep = [i for i, n, c in plain_groups(rows()) if i is None or i == c]
    keep.remove(rows()[9][0])  # this row is there twice
    out = jaccard_join.representatives(docs(spark))
    assert out.columns == docs(spark).columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x or 0)) == sorted(keep, key=lambda x: (x is None, x or 0))


def test_representatives_of_a_repeated_id(spark):
    a, unique = " ".join(f"a{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    data = [(i, t, "en", "s", 0, 0, "") for i, t in ((3, a), (5, a), (5, unique), (5, unique), (7, ""), (7, ""))]
    got = sorted((r.doc_id, r.text) for r in jaccard_join.representatives(docs(spark, data)).collect())
    assert got == [(3, a), (5, unique), (7, ""), (7, "")]
    assert jaccard_join.representatives(empty(spark)).count() == 0


def test_representatives_of_an_id_in_several_groups(spark):
    a, unique = " ".join(f"a{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    for one, two in ((a, unique), (unique, a)):
        data = [(3, one, "s", 1), (3, two, "s", 2), (5, one, "s", 3)]
        d = spark.createDataFrame(data, "doc_id long, text string, _id string, _hash int")
        out = jaccard_join.representatives(d)
        assert out.columns == d.columns and sorted(tuple(r) for r in out.collect()) == sorted(data[:2])


# 9 Source mixing


def test_mixture_keeps_clashing_columns(spark):
    names = ["_source", "_block", "_row", "_first", "_slot", "_bucket", "_all", "position", "a.b"]
    d = spark.createDataFrame([(i, "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(300)], ["doc_id", "source", *names])
    out = source_mix.in_order(d)
    assert out.columns == d.columns and sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in d.collect())


def test_mix_deviates_by_less_than_a_block(spark):
    data = [(i, None, "en", "abc"[0 if i % 3 else 1 + i % 2] if i % 50 else None, 0, 0, "") for i in range(6000)]
    got = source_mix.mix(docs(spark, data), {"a": 0.5, "b": 0.25, "c": 0.125, None: 0.125}).toPandas()
    assert len(got) == 6000 and got.position.is_unique and ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    blocks = got.drop_duplicates("slot").sort_values("slot")
    assert blocks.slot.tolist() == list(range(len(blocks)))
    source = blocks.source.fillna("-").to_numpy()
    full = min(np.flatnonzero(source == s).max() for s in "abc-") + 1
    for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.125), ("-", 0.125)):
        assert (abs(np.cumsum(source[:full] == s) - w * np.arange(1, full + 1)) < 1).all()
    assert source_mix.mix(empty(spark)).count() == 0
    assert sorted(r.doc_id for r in source_mix.in_order(docs(spark, data)).collect()) == list(range(6000))


def fluid(blocks, weights, slots):
    """Shares of the sources after each slot, in exact fractions, event by event."""
    left, out, done = [Fraction(b) for b in blocks], [], [Fraction(0)] * len(blocks)
    for _ in range(slots):
        room = Fraction(1)
        while room > 0 and any(left):
            active = [i for i, x in enumerate(left) if x > 0]
            total = sum(weights[i] for i in active)
            part = min(room, min(left[i] * total / weights[i] for i in active))
            for i in active:
                left[i] -= part * weights[i] / total
                done[i] += part * weights[i] / total
            room -= part
        out.append(list(done))
    return out


@pytest.mark.parametrize("blocks,weights", [([40, 80], ["1/3", "2/3"]), ([30, 20, 60], ["7/10", "2/10", "1/10"]), ([50, 1, 3], ["1", "1/1000000", "1/7"]), ([1] * 20, ["1"] * 20), ([9, 0, 5], ["1", "1", "3"])])
def test_schedule_deviates_by_less_than_a_block(blocks, weights):
    """Against a fluid share computed event by event, and each slot against a search for the earliest deadline."""
    weights = [Fraction(w) for w in weights]
    table = source_mix.plan(blocks, weights)
    owner = {int(t): s for s, rows in enumerate(table) for t in rows[:, 0]}
    assert sorted(owner) == list(range(sum(blocks)))
    had = [0] * len(blocks)
    for t, shares in enumerate(fluid(blocks, weights, sum(blocks))):
        ready = [(rows[had[s], 2], s) for s, rows in enumerate(table) if had[s] < blocks[s] and rows[had[s], 1] <= t]
        assert min(ready)[1] == owner[t] and t < min(ready)[0]
        had[owner[t]] += 1
        assert all(abs(a - b) < 1 for a, b in zip(had, shares, strict=True))


def test_schedule_does_not_drift():
    """Over 100,000 slots with weights that no short period fits."""
    weights = [Fraction(0.7), Fraction(0.2), Fraction(0.1), Fraction(1e-6)]
    table = source_mix.plan([70_000, 20_000, 10_000, 1], weights)
    for w, rows in zip(weights, table, strict=True):
        k = np.arange(len(rows))
        share = float(w / sum(weights)) * rows[:, 0]
        assert (rows[:, 0] < 99_990).sum() == 0 or (abs(k - share)[rows[:, 0] < 99_990] < 1.001).all()


def test_mix_of_many_sources(spark):
    data = [(i, None, "en", f"s{i % 3001}", 0, 0, "") for i in range(6100)]
    got = source_mix.mix(docs(spark, data)).toPandas()
    assert len(got) == 6100 and got.position.is_unique and got.drop_duplicates("slot").slot.size == 3001


# 10 HTML

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><div id=header><a href=x>Logo</a></div><div class='cookie-notice'>We use cookies, ok. Fine.</div>"
    "<div class=main><div class=sidebar><ul><li>One<li>Two</ul></div><div class='post-content'><h2>Title &lt;here&gt;</h2><p>First para, with <a href=q>link</a> text &amp; more.\n  Long"
    " enough, is it not? Yes it is, really.<p>Second para, also long enough to matter, I think. <b>And</b> more<br>words follow here.<script>var t='</p>';</script></div>"
    "<div id=comments><p>Nice post, dude! I liked it, a lot, really. So much text here in comments.</div><form><p>Subscribe</form></div><footer>c</footer></body></html>"
)


UNTELLING = (
    "<body><div><ul><li><a href=a>Start</a></li><li><a href=b>Wetter</a></li><li><a href=c>Sport</a></li></ul></div>"
    "<section><h2>Ein Titel</h2><p>Ein erster Absatz, der lang genug ist, um als Text zu gelten; er hat auch Satzzeichen.</p>"
    "<p>Ein zweiter Absatz, ebenso lang, mit Kommas, Punkten und allem, was dazu gehört.</p></section></body>"
)


def test_html_without_telling_names(monkeypatch):
    """Where no tag or class name tells, the tag paths' ratios decide; with all paths chosen the result is another."""
    got = html_text.main_text(UNTELLING).split("\n")
    assert [x[:9] for x in got] == ["Ein Titel", "Ein erste", "Ein zweit"]
    monkeypatch.setattr(html_text, "chosen_paths", lambda page: set(page.path))
    assert len(html_text.main_text(UNTELLING).split("\n")) == 6


def test_html_keeps_what_an_article_holds():
    page = "<article><h1>T</h1><p class=byline>By A. Writer, today.</p><p>Text of some length, with marks.</p><div class=related-work>Related work, in full.</div><p class=tags>One, two.</p></article>"
    assert html_text.main_text(page) == "T\nBy A. Writer, today.\nText of some length, with marks.\nRelated work, in full.\nOne, two."


@pytest.mark.parametrize("tag", ["div", "p", "b", "li", "span", "table"])
def test_html_of_unclosed_elements_takes_time_in_proportion(tag):
    import time

    def took(n):
        began = time.perf_counter()
        assert html_text.main_text(f"<{tag}>x" * n).replace("\n", "").replace(" ", "") == "x" * n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.02)


def test_html(spark):
    want = "Title <here>\nFirst para, with link text & more. Long enough, is it not? Yes it is, really.\nSecond para, also long enough to matter, I think. And more words follow here."
    assert html_text.main_text(PAGE) == want
    data = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>plain</p", 5), (5, "u", "no tags at all", 5), (6, "u", "<div>" * 3000 + "deep", 5), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and got[5].text == "no tags at all" and got[6].text == "deep"
    assert html_text.extract(pages).count() == len(data) and html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("large", ["<table><tr><td>{}</td></tr></table>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<section><p>{}</p></section>"])
def test_html_keeps_what_stands_around_a_large_element(large):
    intro, end = "An introduction, which says what follows, is here.", "At the end, some words close the article, as usual."
    inner = "The large element, a quote or a list, holds most of the text, that is three quarters. " * 4
    page = f"<body><nav>Home</nav><div class=links>x</div><article><h1>Headline</h1><p>{intro}</p>{large.format(inner)}<p>{end}</p></article></body>"
    assert html_text.main_text(page).split("\n")[-4:] == ["Headline", intro, inner.strip(), end]
