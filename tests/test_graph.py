"""Graph, lookup, search, resolution, context and streaming on small exact fixtures."""

import heapq
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from symgraph.functions import text as T
from symgraph.operators import context, graph, imports, lookup, resolve, search, stats
from symgraph.plans import queries
from symgraph.schema import EDGE_WEIGHTS, OTHER_WEIGHT, SEARCH_WEIGHTS
from symgraph.sources import code, star
from symgraph.streaming import sync

NODES = [
    ("n1", "function", "sign_in", "door.sign_in", "door/lock.py", "python", "signs a guest in", "def sign_in(g)", "public"),
    ("n2", "function", "get_guest", "door.get_guest", "door/lock.py", "python", "", "def get_guest(i)", "public"),
    ("n3", "class", "Guest", "people.Guest", "people/guest.py", "python", "a guest", "", "public"),
    ("n4", "method", "store", "people.Guest.store", "people/guest.py", "python", "", "", "private"),
    ("n5", "module", "lock", "door.lock", "door/lock.py", "python", "", "", "public"),
]
EDGES = [("e1", "n5", "n1", "contains", 1), ("e2", "n5", "n2", "contains", 1), ("e3", "n1", "n2", "calls", 12), ("e4", "n3", "n4", "contains", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    n = spark.createDataFrame(NODES, "id string, kind string, name string, qualified_name string, file_path string, language string, docstring string, signature string, visibility string")
    return n, spark.createDataFrame(EDGES, "id string, source_id string, target_id string, kind string, line int")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_filters(tables):
    n, e = tables
    f = lookup.filter_nodes(n, kinds=["function"])
    assert ids(f) == ["n1", "n2"] and ids(lookup.induced_edges(e, f)) == ["e3"]
    assert len(ids(lookup.filter_nodes(n, kinds=[]))) == 5 and ids(lookup.filter_nodes(n, kinds=["decorator"])) == []
    assert ids(lookup.filter_nodes(n, globs=["people/*"])) == ["n3", "n4"]


def test_focus(tables):
    n, e = tables
    assert ids(graph.focus(e, n, "sign_in", 2)) == ["n1", "n2", "n5"]
    assert ids(graph.focus(e, n, "Guest", 1)) == ["n1", "n2", "n3", "n4", "n5"]
    assert ids(graph.focus(e, n, "nothing", 1)) == ["n1", "n2", "n3", "n4", "n5"]


def test_callers_and_ghosts(spark, tables):
    n, e = tables
    assert ids(graph.callers(e, n, n.filter("name = 'get_guest'")), "source_id") == ["n1"]
    assert ids(graph.callees(e, n, n.filter("name = 'sign_in'")), "target_id") == ["n2"]
    assert ids(lookup.ghost_edges(e, n.filter("id <> 'n2'"))) == ["e2", "e3"]
    left, edges = lookup.delete_nodes(n, e, n.filter("id = 'n1'"))
    assert len(ids(left)) == 4 and ids(edges) == ["e2", "e4"]
    q = spark.createDataFrame([("people.Guest",), ("GUEST",), ("store",), ("none",)], "q string")
    assert {(r.q, r.id, r.score) for r in lookup.definitions(n, q).collect()} == {("people.Guest", "n3", 1.0), ("GUEST", "n3", 0.8), ("store", "n4", 0.9)}
    assert {(r.kind, r.n) for r in stats.by_kind(e).collect()} == {("contains", 3), ("calls", 1)}


def plain_walk(edges, nodes, root, depth, cap, least, starts=None):
    found = {x: (0, 1.0, []) for x in sorted(starts or [root]) if x in nodes}
    heap = [(-1.0, x) for x in found]
    while heap and len(found) < cap:
        _, at = heapq.heappop(heap)
        d, s, path = found[at]
        if d >= depth or s < least:
            continue
        for i, a, b, k, _ in edges:
            if a == at and b in nodes and b not in found:
                found[b] = (d + 1, s * EDGE_WEIGHTS.get(k, OTHER_WEIGHT), [*path, i])
                heapq.heappush(heap, (-found[b][1], b))
    return {(root, i, d, round(s, 9), tuple(p)) for i, (d, s, p) in found.items()} if starts is None else [(root, i, d, round(s, 9), tuple(p), n) for n, (i, (d, s, p)) in enumerate(found.items())]


def test_traverse_random(spark):
    rng = random.Random(6)
    for trial in range(4):
        nodes = [f"v{i}" for i in range(25)]
        kinds = ["contains", "calls", "imports", "reads", "references"]
        edges = [(f"e{i:03}", rng.choice(nodes), rng.choice([*nodes, "ghost"]), rng.choice(kinds), 0) for i in range(70)]
        if trial % 2:  # two nodes lead to more nodes than a walk may find
            edges += [(f"h{i:03}", rng.choice(nodes[:2]), rng.choice(nodes), rng.choice(kinds), 0) for i in range(60)]
        n = spark.createDataFrame([(x,) for x in nodes], "id string")
        e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
        depth, cap = 2 + trial, 8 + trial
        got = graph.traverse(e, n, n, max_depth=depth, max_nodes=cap, min_score=0.3)
        want = set().union(*(plain_walk(edges, set(nodes), x, depth, cap, 0.3) for x in nodes))
        assert {(r.root, r.id, r.depth, round(r.score, 9), tuple(r.path)) for r in got.collect()} == want


def test_traverse_ends(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([], "id string, source_id string, target_id string, kind string, line int")
    assert {(r.root, r.id, r.depth) for r in graph.traverse(e, n, n).collect()} == {("a", "a", 0), ("b", "b", 0)}
    assert graph.traverse(e, n, n.filter("id = 'none'")).count() == 0
    loop = spark.createDataFrame([("1", "a", "a", "calls", 0), ("2", "a", "b", "calls", 0)], e.schema)
    assert {(r.root, r.id, r.depth) for r in graph.traverse(loop, n, n, max_nodes=1).collect()} == {("a", "a", 0), ("b", "b", 0)}
    assert {(r.root, r.id, r.depth) for r in graph.traverse(loop, n, n, max_nodes=2).collect()} == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0)}


def test_terms(spark):
    stems = lambda x: set(spark.range(1).select(T.stems(F.lit(x))).first()[0])
    terms = lambda x: spark.range(1).select(T.terms(F.lit(x))).first()[0]
    want = {
        "parsing": {"pars", "parse"}, "eviction": {"evict"}, "running": {"runn", "runne", "run"}, "management": {"manage"}, "entries": {"entry"}, "processes": {"process"},
        "errors": {"error"}, "class": set(), "handled": {"handle", "handl"}, "agreed": set(), "carried": {"carrie", "carri", "carry"}, "builder": {"build", "builde"},
        "planner": {"plann", "planne", "plan"}, "the": set(), "ties": set(), "seed": set(), "": set(),
    }
    assert {x: stems(x) for x in want} == want
    assert terms("get the UserService for tokens") == sorted({"userservice", "user", "service", "get", "tokens", "token"} | stems("user") | stems("service"))
    assert terms("HTTPServer parsing_errors") == sorted({"httpserver", "http", "server", "parsing", "errors", "error"}.union(*map(stems, ("httpserver", "server", "parsing"))))
    assert terms("the class of") == []


def test_bm25_equals_fts5(spark):
    rng = random.Random(9)
    words = ["alpha", "alphabet", "beta", "betatron", "gamma", "delta", "épsilon", "zeta", "x1", "übung"]
    rows = [(f"{i:04x}", *[" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(4)]) for i in range(80)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id, name, qualified_name, docstring, signature)")
    con.executemany("insert into f values (?, ?, ?, ?, ?)", rows)
    want = dict(con.execute("select id, -bm25(f, 0, 20, 5, 1, 2) from f where f match '\"alph\"* OR \"epsi\"* OR \"x1\"*'"))
    df = spark.createDataFrame(rows, "id string, name string, qualified_name string, docstring string, signature string")
    got = {r.id: r.score for r in search.bm25(df, ["alph", "epsi", "x1"], SEARCH_WEIGHTS).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_search_tiers(tables):
    n, _ = tables
    assert search.search(n, "get_guest").first().id == "n2"
    assert ids(search.search(n, "the class")) == []
    assert "n4" in ids(search.search(n, "stroe", 10)) or "n4" in ids(search.search(n, "storr", 10))
    assert ids(search.like_tier(n, "gue")) == ["n2", "n3"]


def test_resolve(spark, tables):
    n, _ = tables
    refs = spark.createDataFrame([("x1", "n1", "get_guest"), ("x2", "n1", "people.Guest"), ("x3", "n1", "none")], "edge_id string, source_id string, text string")
    got = {r.edge_id: (r.target_id, r.how) for r in resolve.resolve(refs, n).collect()}
    assert got == {"x1": ("n2", "name"), "x2": ("n3", "qualified"), "x3": (None, "unresolved")}


def test_resolve_prefers_file_then_language(spark):
    rng = random.Random(4)
    nodes = [(f"n{i:02}", rng.choice("xyz"), f"q.{rng.choice('xyz')}{i % 7}", rng.choice(["f1", "f2", "f3"]), rng.choice(["python", "go", None])) for i in range(30)]
    refs = [(f"e{i % 35}", rng.choice([*(x[0] for x in nodes), "none"]), rng.choice(["x", "y", "z", "w", None, "q.x1", "q.y2"])) for i in range(40)]
    by_id = {x[0]: x for x in nodes}

    def plain(source, text):
        full = [x[0] for x in nodes if x[2] == text]
        if full:
            return max(full), "qualified"
        src = by_id.get(source, (None,) * 5)
        found = sorted((not (src[3] and x[3] == src[3]), not (src[4] and x[4] == src[4]), x[0]) for x in nodes if x[1] == text)
        return (found[0][2], "name" if len(found) == 1 else "chosen") if found else (None, "unresolved")

    n = spark.createDataFrame(nodes, "id string, name string, qualified_name string, file_path string, language string")
    r = spark.createDataFrame(refs, "edge_id string, source_id string, text string")
    got = sorted((x.edge_id, x.source_id, x.text or "", x.target_id or "", x.how) for x in resolve.resolve(r, n).collect())
    assert got == sorted((e, s, t or "", plain(s, t)[0] or "", plain(s, t)[1]) for e, s, t in refs)


def test_snippets_and_choice(spark):
    files = spark.createDataFrame([("f.py", [f"line {i}" for i in range(1, 41)])], "file_path string, lines array<string>")
    ranked = spark.createDataFrame(
        [("q", "a", "a", "function", "f.py", 5, 8, 0.9), ("q", "b", "b", "function", "f.py", 5, 9, 0.8), ("q", "c", "c", "class", "f.py", 1, 40, 0.7), ("q", "d", "d", "file", "f.py", 1, 40, 1.0)],
        "query string, id string, name string, kind string, file_path string, start_line int, end_line int, score double",
    )
    s = {r.id: r for r in context.snippets(ranked, files).collect()}
    assert set(s) == {"a", "b", "c"} and (s["a"].from_line, s["a"].to_line) == (5, 8) and s["c"].to_line - s["c"].from_line == 9
    assert s["a"].code == "line 5\nline 6\nline 7\nline 8"
    chosen = context.select(context.snippets(ranked, files), per_file=5)
    assert ids(chosen) == ["a", "c"]
    assert 'lines="5-8" relevance="0.90"' in context.as_xml(chosen).first().xml


PYTHON = "class A(B):\n    def f(self):\n        return g(self)\n\nX = 1\n\ndef h():\n    def inner():\n        return k()\n    return A()\n"


def test_code_graph(spark, tmp_path):
    (tmp_path / "src").mkdir(), (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "m.py").write_text(PYTHON)
    (tmp_path / "src" / "empty.py").write_text("")
    (tmp_path / "node_modules" / "x.py").write_text("def no(): pass\n")
    (tmp_path / "src" / "a.go").write_text('package a\n\nimport "fmt"\n\nfunc (s *S) Run() {\n\tfmt.Println("}")\n}\n')
    n, e = code.graph(code.discover(spark, str(tmp_path)))
    got = {(r.kind, r.name, r.start_line, r.end_line) for r in n.filter("kind NOT IN ('file', 'import')").collect()}
    assert got == {("class", "A", 1, 3), ("method", "f", 2, 3), ("constant", "X", 5, 5), ("function", "h", 7, 10), ("method", "Run", 5, 7)}
    assert n.filter("kind = 'file'").count() == 3
    assert {r.name for r in n.filter("kind = 'import'").collect()} == {'import "fmt"'}
    assert {(r.kind, r.target_text) for r in e.filter("kind NOT IN ('contains', 'reads', 'writes')").collect()} == {("extends", "B"), ("calls", "g"), ("calls", "k"), ("calls", "A"), ("calls", "fmt.Println"), ("imports", 'import "fmt"')}


def test_discovery_below_a_hidden_folder(spark, tmp_path):
    root = tmp_path / ".data" / "build" / "it's"
    (root / "src" / "dist").mkdir(parents=True)
    (root / "src" / "a b.py").write_text("X = 1\n")
    (root / "src" / "empty.go").write_text("")
    (root / "src" / "dist" / "no.py").write_text("Y = 1\n")
    (root / "notes.txt").write_text("")
    got = {(r.path.rsplit("/", 1)[-1], r.language, r.text) for r in code.discover(spark, str(root)).collect()}
    assert got == {("a b.py", "python", "X = 1\n"), ("empty.go", "go", "")}


def test_text_in_strings_and_comments_is_no_code(spark, tmp_path):
    (tmp_path / "a.py").write_text('"""Docs.\n\nclass Fake:\n    pass\n"""\n\ndef real():\n    s = """\ndef fake(): pass\n"""\n    return call(s)  # it\'s """ here\n')
    (tmp_path / "b.go").write_text('package b\n\n/* func no() {\n}\n*/\nfunc yes() {\n\tgo("/*")\n}\n')
    n, e = code.graph(code.discover(spark, str(tmp_path)))
    assert {(r.kind, r.name, r.start_line, r.end_line) for r in n.filter("kind <> 'file'").collect()} == {("function", "real", 7, 11), ("function", "yes", 6, 8)}
    assert {r.target_text for r in e.filter("kind = 'calls'").collect()} == {"call", "go"}


def test_imports(spark):
    nodes = spark.createDataFrame(
        [("1", "file", "m.py", "/r/a/m.py"), ("2", "function", "f", "/r/a/m.py"), ("3", "file", "__init__.py", "/r/p/__init__.py"), ("4", "file", "x.ts", "/r/web/x.ts"), ("5", "file", "index.ts", "/r/web/lib/index.ts")],
        "id string, kind string, name string, file_path string",
    )
    rows = [
        ("a", "python", "from a.m import f", "/r/z.py"), ("b", "python", "import a.m", "/r/z.py"), ("c", "python", "from p import thing", "/r/z.py"), ("d", "python", "import os", "/r/z.py"), ("h", "python", "from a.m import *", "/r/z.py"),
        ("e", "typescript", "import {k} from '../web/x'", "/r/src/y.ts"), ("f", "javascript", 'import k from "./lib"', "/r/web/y.js"), ("g", "typescript", "import 'side'", "/r/y.ts"), ("i", "go", 'import "fmt"', "/r/y.go"), ("j", "python", None, "/r/z.py"),
    ]
    i = spark.createDataFrame(rows, "id string, language string, text string, source_file string")
    assert {tuple(r) for r in imports.resolve(i, nodes, "/r/").collect()} == {("a", "2"), ("b", "1"), ("c", "3"), ("e", "4"), ("f", "5"), ("h", "1")}


def test_text_of_comments_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.doc_text(F.lit("/** Adds.\n * Two lines.\n * @param x\n *\n * three\n * four\n * five\n * six\n */"))) == "Adds. Two lines. three four five"
    assert one(T.signature_type(F.lit("x: UserStore = None"))) == "UserStore" and one(T.signature_type(F.lit("x: int"))) is None
    assert sorted(one(T.identifiers(F.lit("see UserStore and get_user, not plain")))) == ["UserStore", "get_user"]


def test_streaming_debounce(spark, tmp_path):
    rows = [("a.py", "modified", None, "2024-01-01 00:00:00", "1"), ("a.py", "modified", None, "2024-01-01 00:00:00.5", "2"), ("a.py", "moved", "b.py", "2024-01-01 00:00:05", "3"), ("x.txt", "created", None, "2024-01-01 00:00:05", "4"), ("z.py", "created", None, "2024-01-01 01:00:00", "5")]
    events = spark.createDataFrame(rows, "path string, event_type string, dest_path string, t string, content string").select("path", "event_type", "dest_path", F.to_timestamp("t").alias("ts"), "content")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = sync.start(sync.expanded(stream), lambda df, _: seen.extend(tuple(r) for r in df.select("path", "op", "content", "n").collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a.py", "delete", "3", 1), ("a.py", "upsert", "2", 2), ("b.py", "upsert", "3", 1)]


def test_index(spark, tmp_path):
    from symgraph.plans import index

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text(PYTHON)
    (tmp_path / "src" / "n.py").write_text("from m import h\n\n\ndef caller():\n    return h()\n")
    index.build(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    i = index.Index(spark, str(tmp_path / "out"))
    assert [r.name for r in i.callers("h").collect()] == ["caller"]
    assert {tuple(r.symbols) for r in i.impact("h").collect()} == {("function h",), ("file n.py", "function caller")}
    assert i.search("caller").first()["name"] == "caller"
    assert "def caller" in i.context("caller").first().xml
    assert i.status().first().files == 2


def plain_choice(rows, max_tokens, max_snippets, per_file):
    """Snippets in their order, one after the other: overlaps first, then the budget."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        spans = [(k[5], k[6]) for k in kept if k[3] == r[3]]
        if not any((n := min(b - a, r[6] - r[5])) > 0 and (min(b, r[6]) - max(a, r[5])) / n >= 0.6 for a, b in spans):
            kept.append(r)
    out, used, files = [], 0, {}
    for r in kept:
        if used + r[8] > max_tokens or len(out) >= max_snippets:
            break
        if files.get(r[3], 0) < per_file:
            files[r[3]] = files.get(r[3], 0) + 1
            out.append(r)
            used += r[8]
    return {(r[0], r[1], i + 1) for i, r in enumerate(out)}


def test_choice_equals_plain(spark):
    rng = random.Random(7)
    rows = []
    for q in range(40):
        for i in range(rng.randint(1, 25)):
            first = rng.randint(1, 12)
            rows.append((f"q{q}", f"n{i:02}", "n", f"f{rng.randrange(4)}", rng.choice([0.1, 0.5, 0.9, rng.random()]), first, first + rng.randint(0, 5), "code", rng.choice([1, 30, 90, 400])))
    found = spark.createDataFrame(rows, "query string, id string, name string, file_path string, score double, from_line int, to_line int, code string, tokens int")
    for limits in ((400, 3, 1), (150, 5, 2), (90, 9, 9)):
        want = set().union(*(plain_choice([r for r in rows if r[0] == f"q{q}"], *limits) for q in range(40)))
        assert {(r["query"], r.id, r.pos) for r in context.select(found, *limits).collect()} == want


def test_walks_from_several_starts(spark):
    rng = random.Random(8)
    nodes = [f"v{i:02}" for i in range(30)]
    edges = [(f"e{i:03}", rng.choice(nodes), rng.choice([*nodes, "ghost"]), rng.choice(["contains", "calls", "imports", "reads"]), 0) for i in range(110)]
    edges += [(f"h{i:03}", "v03", rng.choice(nodes), "calls", 0) for i in range(40)]
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
    walks = {f"w{k}": rng.sample([*nodes, "none"], k) for k in (1, 2, 3, 7, 14)}
    roots = spark.createDataFrame([(w, x) for w, xs in walks.items() for x in xs], "walk string, id string")
    for depth, cap in ((3, 12), (1, 5), (4, 25)):
        got = graph.traverse(e, n, roots, max_depth=depth, max_nodes=cap, min_score=0.2)
        want = {t for w, xs in walks.items() for t in plain_walk(edges, set(nodes), w, depth, cap, 0.2, xs)}
        assert {(r.root, r.id, r.depth, round(r.score, 9), tuple(r.path), r.seq) for r in got.collect()} == want


def test_explore(spark):
    rng = random.Random(9)
    nodes = [f"v{i:02}" for i in range(40)]
    edges = [(f"e{i:03}", rng.choice(nodes), rng.choice(nodes), rng.choice(["contains", "calls"]), 0) for i in range(90)]
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
    results = [(x, 9.0 - i, i + 1) for i, x in enumerate(rng.sample(nodes, 7))]
    want = [(x, s) for x, s, _ in results]
    for x, _, _ in results[:5]:
        for _, i, *_ in plain_walk(edges, set(nodes), x, 2, 20, 0.01, [x]):
            if i not in {y for y, _ in want} and len(want) < 20:
                want.append((i, 0.0))
    got = graph.explore(e, n, spark.createDataFrame(results, "id string, score double, rank int"), max_nodes=20)
    assert [(r.id, r.score) for r in got.orderBy("pos").collect()] == want


def test_components_and_views(spark, tables):
    rng = random.Random(10)
    for m in (0, 25, 60):
        nodes = [f"v{i}" for i in range(50)]
        edges = [(f"e{i}", rng.choice(nodes), rng.choice([*nodes, "ghost"]), "calls", 0) for i in range(m)] + [(f"c{i}", f"v{i}", f"v{i + 1}", "calls", 0) for i in range(30, 40)]
        least = {x: x for x in nodes}
        for _ in nodes:
            for _, a, b, *_ in edges:
                if b in least:
                    least[a] = least[b] = min(least[a], least[b])
        n = spark.createDataFrame([(x,) for x in nodes], "id string")
        e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
        assert {(r.id, r.component) for r in graph.components(e, n).collect()} == set(least.items())
    n, e = tables
    kept, among = graph.view(n, e, name_part="sign_in", depth=1)
    assert ids(kept) == ["n1", "n2", "n5"] and ids(among) == ["e1", "e2", "e3"]
    kept, among = graph.view(n, e, name_part="store", component=True)
    assert ids(kept) == ["n3", "n4"] and ids(among) == ["e4"]
    kept, _ = graph.view(n, e, kinds=["function"], name_part="nothing", component=True)
    assert ids(kept) == ["n1", "n2"]


def test_walks_in_batches(spark):
    """One Python call takes many walks, a single step takes none, and both keep the order of discovery."""
    rng = random.Random(3)
    names = [f"v{i:02}" for i in range(12)]
    edges = [(f"e{i:03}", rng.choice(names), rng.choice([*names, "ghost"]), rng.choice(["calls", "imports"]), 0) for i in range(40)]
    n = spark.createDataFrame([(x,) for x in names], "id string")
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
    for depth in (1, 3):
        got = graph.traverse(e, n, n, max_depth=depth, max_nodes=6)
        plan = got._jdf.queryExecution().toString()
        assert "InPandas" not in plan and ("MapInArrow" in plan) == (depth > 1)
        rows = got.collect()
        for root in names:
            found = sorted((r for r in rows if r.root == root), key=lambda r: r.seq)
            assert [(r.root, r.id, r.depth, round(r.score, 9), tuple(r.path), r.seq) for r in found] == plain_walk(edges, set(names), root, depth, 6, 0.01, [root])


def test_edges_are_read_once(spark, tables):
    """Rounds over the edges read what was stored of them; they are not computed again for each."""
    n, e = tables
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    counted_edges = e.withColumn("kind", counted.asNondeterministic()("kind"))
    got = {(r.root, r.id, round(r.score, 9)) for r in graph.best_path_score(counted_edges, n.filter("id = 'n5'"), 3).collect()}
    assert got == {("n5", "n5", 1.0), ("n5", "n1", 1.0), ("n5", "n2", 1.0)} and read.value == len(EDGES)


def test_postings_move_rows_once(spark):
    rows = spark.createDataFrame([("a", "one two one"), ("b", "two")], "id string, name string")
    post = search.postings(rows, {"name": 2.0})
    assert {(r.token, r.id, r.size, r.tf) for r in post.collect()} == {("one", "a", 3, 4.0), ("two", "a", 3, 2.0), ("two", "b", 1, 2.0)}
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(token" not in plan


STAR = "/root/testdata/sf0.001"


def test_numbered_ids(spark):
    """Numbers stand for the ids, also for null and negative keys."""
    every = spark.createDataFrame([(k,) for k in (0, 7, -1, -8, (1 << 60) - 1, None)], "k long")
    got = every.select("k", *(F.expr(star.numbered(f"concat('{c}:', k)")).alias(c) for c in star.LETTERS))
    rows = got.select("k", *(star.named(c).alias(c) for c in star.LETTERS)).collect()
    assert all(r[c] == (None if r.k is None else f"{c}:{r.k}") for r in rows for c in star.LETTERS)
    assert sorted(star.named_edges(star.numbered_edges(spark, STAR)).collect()) == sorted(star.edges(spark, STAR).collect())
    nodes = star.numbered_nodes(spark, STAR).withColumn("id", star.named("id"))
    assert sorted(nodes.collect()) == sorted(star.nodes(spark, STAR).collect())


def moves_numbers(df):
    """Whether the joins of df's plan move numbers: no id is put together in or below one."""
    path = []  # column and operator of what lies above a line
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = re.search(r"\w", line).start()
        path = [(c, op) for c, op in path if c < at] + [(at, line[at:].split()[0])]
        if re.search(r"concat\([rncspo]:,", line) and any(op == "Join" for _, op in path):
            return False
    return True


def test_traverse_depth1_moves_numbers(spark):
    assert moves_numbers(queries.QUERIES["traverse_depth1"](spark, STAR))


def test_delete_nodes_edges_moves_numbers(spark):
    assert moves_numbers(queries.QUERIES["delete_nodes_edges"](spark, STAR))


def test_view_filter_moves_numbers(spark):
    assert moves_numbers(queries.QUERIES["view_filter"](spark, STAR))


def test_ghost_edges_and_induced_subgraph_move_numbers(spark):
    assert all(moves_numbers(queries.QUERIES[q](spark, STAR)) for q in ("ghost_edges", "induced_subgraph"))


def test_delete_outgoing_moves_numbers(spark):
    assert moves_numbers(queries.QUERIES["delete_outgoing"](spark, STAR))


def test_structural_search_stores_near_steps(spark, monkeypatch):
    """Few starts store what is near them only, and find what many starts do."""
    rng = random.Random(12)
    names = [f"v{i:02}" for i in range(60)]
    edges = [(f"e{i:03}", rng.choice(names), rng.choice([*names, "ghost"]), rng.choice(["calls", "imports", "reads"]), 0) for i in range(120)]
    edges += [(f"h{i:03}", rng.choice(names[:2]), rng.choice(names), "calls", 0) for i in range(60)]
    edges += [(f"z{i:03}", f"z{i}", f"z{i + 1}", "calls", 0) for i in range(500)]  # far from all starts
    n = spark.createDataFrame([(x,) for x in [*names, *(f"z{i}" for i in range(501))]], "id string")
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
    roots = spark.createDataFrame([(x,) for x in ["v00", *names[5:12], "none"]], "id string")
    rows, store = [], graph.kept

    def counted(df):
        out = store(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "kept", counted)
    for depth, cap in ((2, 30), (3, 8)):
        want = set().union(*(plain_walk(edges, set(names), x, depth, cap, 0.01, [x]) for x in ["v00", *names[5:12]]))
        for few in (graph.FEW, 0):
            rows.clear()
            monkeypatch.setattr(graph, "FEW", few)
            got = graph.traverse(e, n, roots, max_depth=depth, max_nodes=cap)
            assert {(r.root, r.id, r.depth, round(r.score, 9), tuple(r.path), r.seq) for r in got.collect()} == want
            assert (max(rows) < 200) == (few > 0)
        monkeypatch.undo()
        monkeypatch.setattr(graph, "kept", counted)


def test_ordered_ids(spark):
    """Numbers in the order of the ids, and of the edges of one end; a key of too many digits is an error."""
    keys = (0, 7, 1, 8, 10, 100, 105, 1099, 109, 99, 9, -1, -8, -10, -105, 10**16 - 1, 10**15, None)
    every = spark.createDataFrame([(k,) for k in keys], "k long")
    for c in star.LETTERS:
        rows = every.selectExpr("k", f"{star.ordered(f"concat('{c}:', k)")} AS n").withColumn("name", F.expr(star.ordered_name("n"))).collect()
        assert all(r.name == (None if r.k is None else f"{c}:{r.k}") for r in rows)
        there = [r for r in rows if r.k is not None]
        assert [r.name for r in sorted(there, key=lambda r: r.n)] == sorted(r.name for r in there)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        spark.createDataFrame([(10**16,)], "k long").selectExpr(star.ordered("concat('c:', k)")).collect()
    for far, near in (("source_id", "target_id"), ("target_id", "source_id")):
        edges = star.ordered_edges(spark, STAR, far)
        ends = edges.select(near, "id", *(F.expr(star.ordered_name(x)).alias(x[0]) for x in ("source_id", "target_id")), "kind", F.expr(star.ordered_name("id", edge=True)).alias("far"))
        of = {}
        for r in ends.collect():
            assert r.far == r[far[0]]
            of.setdefault(r[near], []).append((r.id, f"{r.s}>{r.t}>{r.kind}"))
        assert all([i for _, i in sorted(x)] == sorted(i for _, i in x) for x in of.values())


def test_walks_go_by_numbers(spark, monkeypatch):
    """dependents, impact_traverse and dependencies walk over numbers and find what walks over strings do."""
    n, e = star.nodes(spark, STAR), star.edges(spark, STAR)
    parts, both, classes = n.filter("kind = 'interface'"), n.filter("kind IN ('interface', 'struct')"), n.filter("kind = 'class'")
    want = {"dependents": graph.dependents(e, n, both), "impact_traverse": graph.impact(e, n, parts, 5), "dependencies": graph.dependencies(e, n, classes)}
    want = {q: sorted(map(str, x.collect())) for q, x in want.items()}
    stored, store = [], graph.kept

    def seen(df):
        stored.append({t for c, t in df.dtypes if c in ("root", "id", "near", "far", "edge_id")})
        return store(df)

    monkeypatch.setattr(graph, "kept", seen)
    for q, rows in want.items():
        got = queries.QUERIES[q](spark, STAR)
        assert sorted(map(str, got.select(*got.columns).collect())) == rows and rows
    assert stored and all(x <= {"bigint"} for x in stored)


def test_component_view_goes_from_its_seeds(spark, monkeypatch):
    """The components of few nodes are found from there: no edge far away is stored or moves; far or many nodes give the same."""
    edges = [(f"c{i}", f"v{i}", f"v{i + 1}", "calls", 0) for i in range(6)] + [("g", "v2", "ghost", "calls", 0), ("p", "v3", "w", "calls", 0), ("q", "w", "x", "calls", 0)]
    edges += [(f"z{i:03}", f"z{i}", f"z{i + 1}", "calls", 0) for i in range(40)]
    names = [*(f"v{i}" for i in range(7)), "x", *(f"z{i}" for i in range(41))]  # w is shown by no view
    n = spark.createDataFrame([(x, "class", "seed" if x in ("v1", "x") else "other") for x in names], "id string, kind string, name string")
    n = n.unionByName(spark.createDataFrame([("w", "file", "w")], n.schema))
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, kind string, line int")
    rows, store = [], graph.kept

    def counted(df):
        out = store(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "kept", counted)
    for rounds, nodes in ((12, 1 << 20), (3, 1 << 20), (12, 1)):
        rows.clear()
        monkeypatch.setattr(graph, "REACH_ROUNDS", rounds)
        monkeypatch.setattr(graph, "REACH_NODES", nodes)
        shown, among = graph.view(n, e, kinds=["class"], name_part="seed", component=True)
        assert ids(shown) == [*(f"v{i}" for i in range(7)), "x"] and ids(among) == [f"c{i}" for i in range(6)]
        assert max(rows) <= 8
    got = graph.component_focus(e, n.filter("kind = 'class'"), n.filter("name = 'seed'"))
    assert {(r.id, r.component) for r in got.collect()} == {*((f"v{i}", "v0") for i in range(7)), ("x", "x")}


def test_component_view_moves_numbers(spark):
    assert moves_numbers(queries.QUERIES["component_view"](spark, STAR))


def test_bm25_multi_query_takes_all_words(spark, tmp_path):
    """Short words of a query count too, also one of two letters by its beginning."""
    spark.createDataFrame([(0, "Sun by"), (1, "longwords")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["the sun", "bystander went", "longwordsmith", "moon", "sunny bye", "x", "y", "z", "u v", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["bm25_multi_query"](spark, str(tmp_path)).collect()
    assert {(r.q, r.doc_id) for r in found} == {(0, 0), (0, 1), (0, 4), (1, 2)} and next(r for r in found if r.q == 0 and r["rank"] == 1).doc_id == 4
