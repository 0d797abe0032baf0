"""Statements, definitions, bases, calls and the flow of data in source files of every language."""

import ast

import pytest
from pyspark.sql import functions as F

from symgraph.sources import code, languages, lexer

PYTHON = '''
from base import Root


class User:
    """A user."""

    def __init__(self, name: str, age: int = 0):
        self.name = name
        self.total: int = age + 1

    def validate(self) -> bool:
        return len(self.name) > 0 and self.check(self.name, strict=True)


class Admin(User, pkg.Mixin, metaclass=Meta):
    def __init__(self, name: str):
        super().__init__(name)
        self.level, self.other = 1, [x for x in range(3)]
        count += helper(1)

    def validate(self) -> bool:
        if not super().validate(): raise ValueError(f"bad {self.level} for {self.name!r}")
        a_b = c_d = make(User(self.name), key=lambda item: item.id)
        return True


LIMIT, other = 3, 4
_hidden = 5


async def create(name: str, kinds: Dict[str, User]) -> User:
    user = User(name)
    user.validate()
    values[name].count = user
    for entry in kinds:
        total[entry] += Other[entry]
    def inner():
        return user
    return user
def one(x): return two(x)
'''
FILES = {
    "a.py": PYTHON,
    "a.ts": "/** Doc.\n * @x */\nexport class A<T extends X> extends B<T> implements P, Q {\n  private x: number = 1;\n  go = (a) => made(a)\n  run(a: T): U { return make(a, new Thing()) }\n}\nimport { a, b } from 'm';\nconst { c } = q;\nconst f = (x: Named) => g(x)\nexport const h = async () => {\n  total = await k(`v ${x.y} {`)\n    .then(z)\n}\ninterface I extends J { name: string }\ntype S = { a: string }\nfunction text() { return '}' + \"function no() {\" }\n",
    "a.cpp": "#include <x.h>\n// A note.\nclass D : public Base, private ns::B2 {\npublic:\n  void run() { go(); }\n  int field;\n};\nint main() { D d; d.run(); return 0; }\nvoid D::other(int a)\n{\n  if (a) { b(); } else c();\n}\ntypedef struct { int x; } P;\nnamespace n { enum Color { red }; }\n",
    "a.c": "struct node { int v; };\nstatic int add(int a, int b) {\n  return plus(a, b);\n}\nint counter = 0;\ntypedef int (*cb)(int);\n",
    "a.go": 'package a\nimport (\n\t"fmt"\n\tx "y/z"\n)\ntype S struct {\n\tBase\n\t*pkg.Other\n\tname string\n}\ntype R interface {\n\tReader\n}\nfunc (s *S) Run(f func() error, i interface{}) (map[string]int, error) {\n\tfmt.Println("}")\n\tgo func() { work() }()\n\treturn nil, nil\n}\nconst Max = 3\n',
    "a.rs": "#[derive(Debug)]\npub struct X<'a> { a: &'a str }\nimpl<'a> Show for X<'a> { fn show(&self) -> String { helper('{') } }\nuse a::{b, c};\npub trait T: U + V { fn z(&self); }\nmod inner {\n    pub fn free() { go(); }\n}\n",
    "A.java": "package a.b;\nimport java.util.List;\n/** A doc. */\npublic class J<T extends X> extends Base<T> implements P, Q {\n  private static final int MAX = 3;\n  private List<String> names = new ArrayList<>();\n  @Override\n  public <R> List<R> go(int a) throws E { return helper.make(a); }\n  J() { super(); }\n  enum Color { RED, GREEN }\n  interface In extends K, L {}\n}\n",
    "a.kt": "import x.y\nclass Foo(val a: Int) : Base(a), Face {\n  val x = 1\n  override fun go(): Int = compute(a)\n}\ninterface Face : Root\nfun top() { go() }\n",
    "a.swift": "import Foundation\nclass S: Base, Proto {\n  let a = 1\n  var b: Int { return c() }\n  func f(x: Int) -> Int { g(x) }\n  init(q: Int) { self.q = q }\n}\nstruct T: Proto {}\nprotocol P: Q {}\n",
    "a.js": "class M extends N { m() { n() } }\nexports.run = function () { go() }\n",
    "ñ.py": "class Größe:\n    def año(self): return straße()\n",
    "comment.py": "# nothing here\n",
    "crlf.py": "def a():\r\n    b()\r\n\r\ndef c(): d()\n",
    "deep.py": "def a():\n    def b():\n        def c():\n            return d()\n    return b\n",
    "a.rb": "def x; end\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    s = languages.LANGUAGES
    kinds = {"py": "python", "ts": "typescript", "rs": "rust", "kt": "kotlin", "js": "javascript", "rb": "ruby"}
    rows = [(f"/r/{p}", kinds.get(p.split(".")[1], p.split(".")[1]), t) for p, t in FILES.items()]
    assert set(s) <= {r[1] for r in rows}
    n, e = code.graph(spark.createDataFrame(rows, "path string, language string, text string"))
    nodes, edges = n.collect(), e.collect()
    ids = [r.id for r in nodes]
    assert len(set(ids)) == len(ids) and all(r.source_id in set(ids) for r in edges)
    return nodes, edges


def nodes_of(tables, file, *kinds):
    return {(r.kind, r.name, r.start_line, r.end_line) for r in tables[0] if r.file_path == f"/r/{file}" and r.kind not in ("file", "import") and (not kinds or r.kind in kinds)}


def edges_of(tables, file, *kinds):
    name = {r.id: r.name for r in tables[0] if r.file_path == f"/r/{file}"}
    return {(r.kind, name[r.source_id], r.target_text) for r in tables[1] if r.source_id in name and r.kind in kinds}


STRUCTURE = ("extends", "implements", "calls", "instantiates")
WANT = {
    "a.ts": (
        {("class", "A", 3, 7), ("variable", "x", 4, 4), ("method", "go", 5, 5), ("method", "run", 6, 6), ("function", "f", 10, 10), ("function", "h", 11, 14), ("interface", "I", 15, 15), ("variable", "name", 15, 15), ("type_alias", "S", 16, 16), ("function", "text", 17, 17)},
        {("extends", "A", "B"), ("implements", "A", "P"), ("implements", "A", "Q"), ("extends", "I", "J"), ("calls", "go", "made"), ("calls", "run", "make"), ("instantiates", "run", "Thing"), ("calls", "f", "g"), ("calls", "h", "k")},
    ),
    "a.cpp": (
        {("class", "D", 3, 7), ("method", "run", 5, 5), ("function", "main", 8, 8), ("function", "other", 9, 12), ("type_alias", "P", 13, 13), ("module", "n", 14, 14), ("enum", "Color", 14, 14)},
        {("extends", "D", "Base"), ("extends", "D", "ns::B2"), ("calls", "run", "go"), ("calls", "main", "d.run"), ("calls", "other", "b"), ("calls", "other", "c")},
    ),
    "a.c": ({("struct", "node", 1, 1), ("function", "add", 2, 4), ("variable", "counter", 5, 5), ("type_alias", "cb", 6, 6)}, {("calls", "add", "plus")}),
    "a.go": (
        {("struct", "S", 6, 10), ("interface", "R", 11, 13), ("method", "Run", 14, 18), ("constant", "Max", 19, 19)},
        {("extends", "S", "Base"), ("extends", "S", "pkg.Other"), ("extends", "R", "Reader"), ("calls", "Run", "fmt.Println"), ("calls", "Run", "work")},
    ),
    "a.rs": (
        {("struct", "X", 2, 2), ("module", "impl X", 3, 3), ("method", "show", 3, 3), ("trait", "T", 5, 5), ("method", "z", 5, 5), ("module", "inner", 6, 8), ("function", "free", 7, 7)},
        {("implements", "impl X", "Show"), ("extends", "T", "U"), ("extends", "T", "V"), ("calls", "show", "helper"), ("calls", "free", "go")},
    ),
    "A.java": (
        {("module", "a.b", 1, 1), ("class", "J", 4, 12), ("constant", "MAX", 5, 5), ("variable", "names", 6, 6), ("method", "go", 7, 8), ("method", "J", 9, 9), ("enum", "Color", 10, 10), ("interface", "In", 11, 11)},
        {("extends", "J", "Base"), ("implements", "J", "P"), ("implements", "J", "Q"), ("extends", "In", "K"), ("extends", "In", "L"), ("calls", "go", "helper.make"), ("calls", "J", "super"), ("instantiates", "names", "ArrayList")},
    ),
    "a.kt": (
        {("class", "Foo", 2, 5), ("constant", "x", 3, 3), ("method", "go", 4, 4), ("interface", "Face", 6, 6), ("function", "top", 7, 7)},
        {("extends", "Foo", "Base"), ("implements", "Foo", "Face"), ("extends", "Face", "Root"), ("calls", "go", "compute"), ("calls", "top", "go")},
    ),
    "a.swift": (
        {("class", "S", 2, 7), ("constant", "a", 3, 3), ("variable", "b", 4, 4), ("method", "f", 5, 5), ("method", "init", 6, 6), ("struct", "T", 8, 8), ("interface", "P", 9, 9)},
        {("extends", "S", "Base"), ("implements", "S", "Proto"), ("implements", "T", "Proto"), ("extends", "P", "Q"), ("calls", "b", "c"), ("calls", "f", "g")},
    ),
    "a.js": ({("class", "M", 1, 1), ("method", "m", 1, 1), ("function", "run", 2, 2)}, {("extends", "M", "N"), ("calls", "m", "n"), ("calls", "run", "go")}),
    "ñ.py": ({("class", "Größe", 1, 2), ("method", "año", 2, 2)}, {("calls", "año", "straße")}),
    "comment.py": (set(), set()),
    "crlf.py": ({("function", "a", 1, 2), ("function", "c", 4, 4)}, {("calls", "a", "b"), ("calls", "c", "d")}),
    "deep.py": ({("function", "a", 1, 5)}, {("calls", "a", "d")}),
    "a.rb": (set(), set()),
}


@pytest.mark.parametrize("file", WANT)
def test_definitions_bases_and_calls(tables, file):
    assert nodes_of(tables, file) == WANT[file][0]
    assert edges_of(tables, file, *STRUCTURE) == WANT[file][1]
    assert sum(r.kind == "file" and r.file_path == f"/r/{file}" for r in tables[0]) == 1


def flows(node, writes, reads):
    """Reads and writes of a syntax tree, in another way: by the nodes of Python's own parser."""
    if isinstance(node, (ast.Assign, ast.AnnAssign)):
        for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
            writes |= {x for n in ast.walk(t) for x in names(n)}
        if node.value is not None:
            flows(node.value, writes, reads)
        return
    if isinstance(node, ast.AugAssign):
        target = {x for n in ast.walk(node.target) for x in names(n)}
        writes |= target
        reads |= target
        flows(node.value, writes, reads)
        return
    reads |= names(node)
    for c in ast.iter_child_nodes(node):
        flows(c, writes, reads)


def names(node):
    return {v for f in ("id", "attr", "arg", "name") if isinstance(v := getattr(node, f, None), str)}


def plain_edges(body, holder, out):
    for x in body:
        if isinstance(x, ast.ClassDef):
            out |= {("extends", x.name, ast.unparse(b)) for b in x.bases}
            plain_edges(x.body, x.name, out)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            writes, reads = set(), set()
            for b in x.body:
                flows(b, writes, reads)
                out |= {("calls", x.name, ast.unparse(c.func)) for c in ast.walk(b) if isinstance(c, ast.Call)}
            real = lambda v: v not in languages.PYTHON_SKIPPED and len(v) > 1
            out |= {("writes", x.name, v) for v in writes if real(v)} | {("reads", x.name, v) for v in reads - writes if real(v)}
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            out.add(("imports", "a.py", ast.unparse(x)))


def test_python_equals_the_syntax_tree(tables):
    want = set()
    plain_edges(ast.parse(PYTHON).body, "a.py", want)
    assert len(want) > 40 and edges_of(tables, "a.py", "extends", "calls", "writes", "reads", "imports") == want
    assert edges_of(tables, "a.py", "references") == {("references", "create", x) for x in ("Dict", "User", "Other")}
    found = {(r.kind, r.name, r.qualified_name, r.visibility) for r in tables[0] if r.file_path == "/r/a.py" and r.kind in ("class", "constant")}
    assert found == {("class", "User", "a.User", "public"), ("class", "Admin", "a.Admin", "public"), ("constant", "LIMIT", "a.LIMIT", "public"), ("constant", "other", "a.other", "public")}


def test_texts_and_flags(tables):
    node = {(r.file_path[3:], r.name): r for r in tables[0] if (r.kind, r.name) != ("method", "J")}
    assert node["a.py", "User"].docstring == "A user." and node["a.ts", "A"].docstring == "Doc." and node["a.cpp", "D"].docstring == "A note." and node["A.java", "J"].docstring == "A doc."
    assert node["a.py", "create"].signature == "def create(name: str, kinds: Dict[str, User]) -> User" and node["a.py", "create"].is_async
    assert node["a.ts", "A"].is_exported and node["a.ts", "x"].visibility == "private" and node["A.java", "MAX"].is_static and node["a.rs", "show"].qualified_name == "impl_X::show"
    assert node["a.cpp", "other"].qualified_name == "a::D::other" and node["a.py", "validate"].parent_id in {r.id for r in tables[0] if r.kind == "class"}
    assert node["a.py", "from base import Root"].qualified_name == "import:from base import Root" and all(r.content_hash for r in tables[0])
    assert ("writes", "h", "total") in edges_of(tables, "a.ts", "writes") and ("references", "f", "Named") in edges_of(tables, "a.ts", "references")


def test_a_file_that_cannot_be_read_is_a_row(spark, monkeypatch):
    found = lexer.rows("/r/a.py", "python", None)
    assert [r["seq"] for r in found] == [lexer.FILE] and found[0]["error"] is None
    monkeypatch.setattr(lexer, "python", lambda text: 1 / 0)
    assert [(r["seq"], r["error"]) for r in lexer.rows("/r/a.py", "python", "x = 1")] == [(lexer.FILE, "ZeroDivisionError: division by zero")]


def test_odd_texts_end():
    for text in ["{" * 500, "}" * 500, '"' * 301, "'''", "((((", "/*", "def", "class:", "\\\n" * 50, ":\n:\n", "`${", "x = {\n" * 50, "f(" * 300]:
        for language in ["python", *lexer.MARKS]:
            assert lexer.rows("p", language, text)[0]["error"] is None


def test_many_definitions_in_a_file():
    text = "".join(f"def f{i}(): return g{i}()\n" for i in range(3000))
    assert sum(r["opens"] for r in lexer.python(text).rows) == 3000


def test_a_language_from_outside(spark):
    languages.register(languages.Language("toy", "java", (languages.Rule("function", r"^proc\s+(\w+)", True), languages.Rule("class", r"^thing\s+(\w+)", True)), r"^load\s.*$", "load:", extends=(r"\bfrom\s+(.+)$",)))
    try:
        rows = [("/r/a.toy", "toy", "load x;\nthing A from B {\n  proc go() { run(); }\n}\n")]
        n, e = code.graph(spark.createDataFrame(rows, "path string, language string, text string"))
        assert {(r.kind, r.name) for r in n.collect()} == {("file", "a.toy"), ("import", "load x"), ("class", "A"), ("method", "go")}
        assert {(r.kind, r.target_text) for r in e.filter(F.col("kind") != "contains").collect()} == {("imports", "load x"), ("extends", "B"), ("calls", "run")}
    finally:
        del languages.LANGUAGES["toy"]


def test_statements_of_a_language(spark):
    s = code.statements(spark.createDataFrame([("/r/a.go", "go", FILES["a.go"])], "path string, language string, text string"))
    held = {(r.head, tuple(h.name for h in r.holders)) for r in s.filter("NOT kept AND seq >= 0").collect()}
    assert ("name string", ("S",)) in held and ("work()", ("Run",)) in held
