import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import hard_negatives
from tests.llm.common import same

ROWS = "vec_id long, embedding array<float>, label int"
TWICE = "vec_id long, embedding array<double>, label int, x string, block int, part int, windows string"


def plain(data, mod=50):
    rows = sorted({(i, tuple(int(np.floor(256 * float(np.float32(v)))) for v in e), label) for i, e, label in data})
    for i, q, label in rows:
        if i % mod or (i, q, label) != min((r for r in rows if r[0] == i), key=lambda r: (r[1], r[2])):
            continue
        score = lambda r: sum(a * b for a, b in zip(q, r[1], strict=True))  # noqa: E731,B023
        others = sorted(((-score(r), r[0], r[2]) for r in rows if r[0] != i))
        for ps, p, _ in [x for x in others if x[2] == label][:5]:
            negatives = [x for x in others if x[2] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            for k, (ns, n, _) in enumerate(negatives, 1):
                yield i, p, k, n, -ps, -ns


def clustered(rng, n, dim, centres=6):
    mids = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(centres)]
    out = []
    for i in range(n):
        m = rng.choice(mids)
        e = [v + rng.gauss(0, 0.1) for v in m]
        out.append((i, [v * rng.choice([0.5, 1, 2]) for v in e] if i % 9 else e, rng.randrange(4)))
    return out


@pytest.mark.parametrize("numbers", [1 << 19, 600])
def test_hard_negatives_equal_plain(spark, monkeypatch, numbers):
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    rng = random.Random(3)
    data = clustered(rng, 500, 8)
    data += [(500 + i, data[50][1], i % 3) for i in range(120)]  # one vector many times
    data += [(1000, data[50][1], 1), (1000, data[51][1], 2), (1050, [0.0] * 8, 0), (-50, data[7][1], 2)]  # an id with two vectors, a zero vector
    odd = [(2000, None, 1), (2050, [float("nan")] * 8, 1), (2100, [1.0] * 7, 1), (2150, [float("inf")] + [0.0] * 7, 1), (2200, [None] + [0.0] * 7, 1), (2250, data[0][1], None), (None, data[0][1], 1), (2300, [3e38] * 8, 1)]
    found = hard_negatives.mine(spark.createDataFrame([*data, *odd, data[3], data[50]], ROWS), lambda i: i % 50 == 0)
    want = list(plain(data))
    assert len(want) > 50
    same(found, want)


def test_hard_negatives_with_clashing_columns(spark):
    data = clustered(random.Random(4), 200, 6)
    rows = [(i, [float(np.float32(v)) for v in e], label, "x", 1, 2, "w") for i, e, label in data]
    same(hard_negatives.mine(spark.createDataFrame(rows, TWICE), lambda i: i % 50 == 0), list(plain(data)))


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], ROWS), lambda i: i % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], ROWS)
    assert hard_negatives.mine(one, lambda i: i % 50 == 0).count() == 0
    assert hard_negatives.mine(one, lambda i: i % 50 == 49).count() == 0


def forest(rng, n, dim, spread, scale=256.0):
    mids = rng.standard_normal((40, dim))
    x = np.floor(scale * (mids[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, dim))))
    return hard_negatives.Forest(np.arange(n), rng.integers(0, 3, n), x), x


def test_cover_tree_holds_its_rows():
    f, x = forest(np.random.default_rng(5), 1500, 5, 0.1)
    for tree in f.trees.values():
        below = [None] * len(tree.kids)
        for node in reversed(range(len(tree.kids))):
            a, b = tree.spans[node]
            below[node] = tree.order[a:b] if not len(tree.kids[node]) else np.concatenate([below[k] for k in tree.kids[node]])
            far = lambda p: np.hypot(np.linalg.norm(x[p] - x[tree.centre[node]], axis=1), np.sqrt(f.top - (x[p] ** 2).sum(1)) - np.sqrt(f.top - (x[tree.centre[node]] ** 2).sum()))  # noqa: E731,B023
            assert far(below[node]).max() <= tree.radius[node] * (1 + 1e-9) + 1e-6
            for k in tree.kids[node]:
                assert tree.radius[k] <= tree.radius[node]
            low, high = f.bounds(tree, np.array([node]), x[7])
            assert low[0] <= (x[below[node]] @ x[7]).min() and (x[below[node]] @ x[7]).max() <= high[0]
        assert len(set(below[0].tolist())) == len(below[0]) == len(tree.order)
    assert sorted(np.concatenate([t.order for t in f.trees.values()]).tolist()) == list(range(1500))


@pytest.mark.parametrize("scale", [256.0, 1e6, 1e8])
def test_search_equals_plain_and_skips_nodes(scale):
    rng = np.random.default_rng(6)
    f, x = forest(rng, 4000, 16, 0.05, scale)
    exact = x.astype(np.int64)
    for own in range(0, 4000, 400):
        score = (exact @ exact[own]).tolist()
        top = max(s for i, s in enumerate(score) if i != own)
        windows = [hard_negatives.Win(None, None, hard_negatives.LOWEST, hard_negatives.HIGHEST, 5), hard_negatives.Win(1, 1, top // 2, top * 19 // 20, 3), hard_negatives.Win(1, 1, -5, 5, 4)]
        got = f.search(x[own], own, list(f.trees.values()), windows)
        for w, (ids, scores) in zip(windows, got, strict=True):
            want = sorted((-s, i) for i, s in enumerate(score) if i != own and w.low <= s <= w.high)[: w.k]
            assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    f.visited = 0
    for own in range(0, 4000, 40):
        f.search(x[own], own, list(f.trees.values()), [hard_negatives.Win(None, None, hard_negatives.LOWEST, hard_negatives.HIGHEST, 5)])
    assert f.visited < 0.3 * 100 * 4000
