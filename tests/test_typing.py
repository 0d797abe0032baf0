"""Types of receivers, imports bound in a stored graph, and the fixpoint on random facts."""

import json
import random
import re

import pytest

from symgraph.operators import frameworks, imports, typing
from symgraph.plans import index

FILES = {
    "app/__init__.py": "",
    "app/models.py": """class Base:
    def save(self): return self.check()
    def check(self) -> bool: return True
class User(Base):
    def __init__(self, name):
        self.name = name
        self.store = Store()
    def validate(self): return self.store.get(self.name)
class Store:
    def get(self, key): return key
    def owner(self) -> User: ...
""",
    "app/other.py": """class Thing:
    def validate(self): return 1
def validate(): pass
""",
    "app/services.py": """from .models import User as Person, Store
from app import other
import app.models as m
shared = Store()
def create(name: str):
    user = Person(name)
    user.validate()
    user.save()
    same = user
    same.validate()
    return user
def use(store: Store):
    p = create("x")
    p.validate()
    q = store.owner()
    q.save()
    q.store.get(1)
    other.validate()
    shared.get(2)
    m.Store.get(3)
def either(flag):
    x = Person(1)
    x = other.Thing()
    x.validate()
def unknown(y):
    y.validate()
""",
    "web/a.ts": "import { Api as Remote } from './b';\nclass Page {\n  private api: Remote;\n  load(): Result { return this.api.fetch() }\n  show() { const r = this.load(); r.draw(); }\n}\n",
    "web/b.ts": "export class Api { fetch(): Result { return new Result() } }\nexport class Result { draw() {} }\n",
    "jvm/A.java": "class A {\n  private B b;\n  void go(C c) { b.run(); c.run(); }\n}\nclass B { void run() {} }\nclass C extends B { }\n",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (top / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (top / "src" / name).write_text(text)
    index.build(spark, str(top / "src"), str(top / "out"))
    return index.Index(spark, str(top / "out"))


@pytest.fixture(scope="module")
def calls(stored):
    name = {r.id: r.qualified_name for r in stored.nodes.collect()}
    return {(name[r.source_id], r.target_text): (name.get(r.target_id), r.resolved_target, json.loads(r.type_context) if r.type_context else None) for r in stored.edges.filter("kind = 'calls'").collect()}


def test_receivers_are_typed(calls):
    flow = lambda t: {"receiver": t, "source": "type_flow"}
    want = {
        ("services.create", "user.validate"): ("models.User.validate", "User"), ("services.create", "user.save"): ("models.Base.save", "User"), ("services.create", "same.validate"): ("models.User.validate", "User"),
        ("services.use", "p.validate"): ("models.User.validate", "User"), ("services.use", "store.owner"): ("models.Store.owner", "Store"), ("services.use", "q.save"): ("models.Base.save", "User"),
        ("services.use", "q.store.get"): ("models.Store.get", "Store"), ("services.use", "shared.get"): ("models.Store.get", "Store"), ("services.use", "m.Store.get"): ("models.Store.get", "Store"),
        ("models.User.validate", "self.store.get"): ("models.Store.get", "Store"), ("models.Base.save", "self.check"): ("models.Base.check", "Base"),
        ("a.Page.load", "this.api.fetch"): ("b.Api.fetch", "Api"), ("a.Page.show", "this.load"): ("a.Page.load", "Page"), ("a.Page.show", "r.draw"): ("b.Result.draw", "Result"),
        ("A.A.go", "b.run"): ("A.B.run", "B"), ("A.A.go", "c.run"): ("A.B.run", "C"),
    }
    for key, (method, kind) in want.items():
        assert calls[key] == (method, method, flow(kind)), (key, calls[key])


def test_several_types_are_listed_and_none_is_guessed(calls):
    assert calls["services.either", "x.validate"] == (None, "", {"receiver": "Thing|User", "ambiguous": ["models.User.validate", "other.Thing.validate"], "source": "type_flow"})
    assert calls["services.unknown", "y.validate"] == (None, "", None)


def test_imports_are_bound(stored, calls):
    assert calls["services.create", "Person"][0] == "models.User" and calls["services.use", "other.validate"][0] == "other.validate"
    name = {r.id: r.name for r in stored.nodes.collect()}
    bound = {(name[r.source_id], name[r.target_id]) for r in stored.edges.filter("kind = 'imports' AND confidence = 1.0").collect() if "import" not in name[r.target_id]}
    assert bound == {("services.py", "User"), ("services.py", "Store"), ("services.py", "other.py"), ("services.py", "models.py"), ("a.ts", "Api")}
    assert stored.impact("Store").count() >= 2


STATEMENTS = [
    ("python", "from a import b, c as d", {("a", "b", "b"), ("a", "c", "d")}), ("python", "from .x.y import (\n    p,  # why\n    q,\n)", {(".x.y", "p", "p"), (".x.y", "q", "q")}), ("python", "from . import z", {(".", "z", "z")}),
    ("python", "import a.b, c as d", {("a.b", "*", "a"), ("c", "*", "d")}), ("python", "from m import *", {("m", "*", "*")}),
    ("typescript", "import D, { a, b as c } from './m'", {("./m", "D", "D"), ("./m", "a", "a"), ("./m", "b", "c")}), ("typescript", 'import * as ns from "m"', {("m", "*", "ns")}), ("javascript", "import type { T } from 'm'", {("m", "T", "T")}),
    ("typescript", "import 'side'", set()), ("go", 'import "fmt"', set()), ("python", None, set()),
]


def test_import_clauses(spark):
    rows = spark.createDataFrame([(str(i), x[0], x[1], "/f") for i, x in enumerate(STATEMENTS)], "id string, language string, text string, source_file string")
    got = {}
    for r in imports.names(rows).collect():
        got.setdefault(int(r.id), set()).add((r.module, r.name, r.alias))
    for i, (_, text, want) in enumerate(STATEMENTS):
        assert got.get(i, set()) == want, text


def test_spread_equals_plain(spark):
    rng = random.Random(1)
    for n in (0, 5, 60):
        facts = {(str(rng.randrange(30)), rng.choice("xyz")) for _ in range(6 if n else 0)}
        flows = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(n)]
        want = set(facts)
        while more := {(b, v) for a, b in flows for k, v in want if k == a} - want:
            want |= more
        got = typing.spread(spark.createDataFrame(list(facts), "key string, value string"), spark.createDataFrame(flows, "source string, target string"))
        assert {tuple(r) for r in got.collect()} == want


def test_contexts_of_a_stored_graph(stored):
    text = stored.context("create user", form="structured").first().text
    assert text.startswith("## Code Context\n\n**Query:** create user\n\n### Entry Points\n\n- **create** (function)") and "### Code" in text
    assert "### Call Chains" in stored.context("create user", form="graph").first().text and "code_context" in stored.context("create user").first().xml
    explored = stored.explore("create").first().text
    assert "## Relationship Map" in explored and re.search(r"create --\[(?:calls|reads)\]--> \w+", explored)


def test_rules_of_frameworks(spark):
    nodes = spark.createDataFrame(
        [("1", "function", "get_db", "deps.get_db", "/r/deps.py"), ("2", "file", "models.py", "/r/shop/models.py", "/r/shop/models.py"), ("3", "class", "Order", "models.Order", "/r/shop/models.py"), ("4", "function", "go", "x.go", "/r/x.py")],
        "id string, kind string, name string, qualified_name string, file_path string",
    )
    refs = spark.createDataFrame([("a", "Depends(get_db)"), ("b", "shop.Order"), ("c", "shop.Other"), ("d", "other.Order"), ("e", "get_db"), ("f", "task:go"), ("g", None)], "edge_id string, text string")
    want = {("a", "1", "fastapi"), ("b", "3", "django"), ("c", "2", "django")}
    assert {tuple(r) for r in frameworks.resolve(refs, nodes, "/r/").collect()} == want
    frameworks.register("queue", symbol=lambda text: frameworks.matched(text, r"^task:(\w+)$"))
    try:
        assert {tuple(r) for r in frameworks.resolve(refs, nodes, "/r").collect()} == want | {("f", "4", "queue")}
    finally:
        del frameworks.SYMBOLS["queue"]
