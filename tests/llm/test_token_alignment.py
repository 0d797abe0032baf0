import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from symgraph.llm import token_alignment
from symgraph.llm.queries import byte_model, piece_model
from tests.llm.common import docs, empty, rows, same, sha


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_model())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for b in range(256):
        if b not in keep:
            out[chr(256 + len(out) - len(keep))] = b
    return out


LETTERS = letters()


def plain(models, text):
    """(A ids, B ids) of the groups and the linked places, by walking over the bytes."""
    a, b = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.encode().replace("▁".encode(), b" ") for i, p in zip(ids_b, pieces, strict=True)]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends = [list(accumulate(map(len, side))) for side in (bytes_a, bytes_b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, at = [], 0
    for cut in cuts:
        groups.append(tuple([i for i, e in zip(ids, end, strict=True) if at < e <= cut] for ids, end in ((ids_a, ends[0]), (ids_b, ends[1]))))
        at = cut
    links, j = [], 0
    for i, (e, x) in enumerate(zip(ends[0], bytes_a, strict=True)):
        while ends[1][j] <= e - len(x):
            j += 1
        k = j
        while k < len(ids_b) and ends[1][k] - len(bytes_b[k]) < e:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    return len(ids_a), len(ids_b), groups, links


def plain_rows(models, data):
    found = [(r[0], plain(models, r[1])) for r in data]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for i, f in found:
        if f is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in f[2])
        yield i, f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), sha(text)


@pytest.mark.parametrize("head", [1 << 20, 60, 0])
def test_alignment_equals_plain(spark, models, monkeypatch, head):
    monkeypatch.setattr(token_alignment, "HEAD", head)
    more = [(i, t, None, None, None, None, None) for i, t in enumerate(["literal ▁ mark", "<|endoftext|> <s> </s> <unk> <0x41>", "İstanbul \U0001f389\U0001f389 é́", " lead", "tail \n", "a\tb  c\n\n d\x1c e　f"], 500)]
    data = rows() + more
    same(token_alignment.alignment(docs(spark, data), byte_model(), piece_model()), list(plain_rows(models, data)))


def test_alignment_of_random_texts(models, monkeypatch):
    rng = random.Random(8)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r", "\x00", "\x1c", "\x85", "　", "\xa0", "é", "\U0001f389", "의", "▁", "the", "ing", "'s", "1", "23", "!?", "<s>", "<|endoftext|>", "<0x0A>", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    monkeypatch.setattr(token_alignment, "MEMO", 50)
    aligner = token_alignment.Aligner(byte_model(), piece_model())
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, (n_a, n_b, n_groups, n_links, groups, keys, times) in zip(some, aligner.rows(some), strict=True):
            want = plain(models, text)
            if want is None:
                assert (n_a, n_b, n_groups, n_links, groups, len(keys)) == (0, 0, 0, 0, "", 0), repr(text)
                continue
            assert (n_a, n_b, n_groups) == (want[0], want[1], len(want[2])), repr(text)
            assert groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want[2])
            assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == Counter(x * aligner.base + y for x, y in want[3]) and n_links == len(want[3])


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment(empty(spark), byte_model(), piece_model()).count() == 0
    nulls = docs(spark, [(1, None, None, None, None, None, None), (1, "", None, None, None, None, None)])
    same(token_alignment.alignment(nulls, byte_model(), piece_model()), [(1, 0, 0, 0, 0, 0, 0, "")] * 2)
    assert token_alignment.aligned(docs(spark, [(1, "a word", None, None, None, None, None)]), byte_model(), piece_model()).first().groups.count("|") == 2
