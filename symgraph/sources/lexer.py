"""Statements of source files: one pass over a file's marks, with a stack of open blocks.

A statement is what stands between braces, semicolons, line ends or indentations.  Its
code has no comments and no contents of literals (but those of expressions within them),
so patterns over it cannot be misled; raw is the text as it stands.  Everything that is
known of languages beyond their marks is in symgraph.sources.languages, as columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, language string, seq int, above array<int>, line int, last int, end int, lines int, hash string, opens boolean, code string, raw string, doc string, error string"
)
#: The pseudo statement of the file itself.
FILE = -1

STRING = r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'
PYTHON = re.compile(
    r"(?P<literal>\b[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|" + STRING + r")|(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|" + STRING + r"))"
    r"|(?P<comment>#[^\n]*)|(?P<join>\\\r?\n)|(?P<line>\n)|(?P<open>[(\[{])|(?P<shut>[)\]}])|(?P<semi>;)|(?P<colon>:(?!=))|(?P<word>\w+)|(?P<blank>[ \t\r\f]+)|(?P<rest>.)",
    re.S,
)
HEADS = frozenset("class def async if elif else for while with try except finally match case".split())

#: Marks of languages with braces: literals that differ, in front of what all share.
LITERALS = {
    "rust": r"r#*\"(?s:.*?)\"#*|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\[^\n]{1,8})'",
    "go": r"`[^`]*`?|" + STRING,
    "typescript": r"`(?:[^`\\]|\\.)*`?|(?<=[(=,:!&|?{;\n])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|" + STRING,
    "c": STRING,
}
LITERALS |= {"javascript": LITERALS["typescript"], "cpp": r'R"\((?s:.*?)\)"|' + STRING}
LITERALS |= {x: r'"""(?s:.*?)(?:"""|\Z)|' + STRING for x in ("java", "kotlin", "swift")}
#: Languages in which a line end may end a statement, and where it does not.
LINE_ENDS = frozenset(["typescript", "javascript", "go", "kotlin", "swift"])
GOES_ON = re.compile(r"\s*(?:[.?:&|+*%=,)\]{]|/(?![/*])|-[^-]|<[^<]|(?:extends|implements|where|throws)\b)")
#: Go puts a semicolon behind a line that ends with a name, a literal or a closing bracket.
GO_ENDS = re.compile(r"(?:[\w\"`)\]}]|\+\+|--)$")
UNFINISHED = re.compile(r"(?:[,=*/%&|?:.(\[]|(?<!\+)\+|(?<!-)-|=>|->)$")
#: Heads whose braces hold names, not a block.
NO_BLOCK = re.compile(r"^(?:import\b(?!.*[=(])|export\s*(?:type\s*)?$|(?:pub(?:\([^)]*\))?\s+)?use\b|(?:export\s+)?(?:const|let|var)\s*$|typedef\b)")
GO_EMPTY = re.compile(r"\b(?:interface|struct)$")
LABEL = re.compile(r"^(?:public|private|protected)$")


def marks(language: str) -> re.Pattern:
    attribute = r"|(?P<skip>#!?\[[^\]\n]*\])" if language == "rust" else ""
    directive = r"|(?P<directive>(?m:^)[ \t]*\#(?:[^\n\\]|\\.)*)" if language in ("c", "cpp") else ""
    return re.compile(
        r"(?P<comment>/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*)" + attribute + directive + rf"|(?P<literal>{LITERALS[language]})"
        r"|(?P<line>\n)|(?P<open>[(\[])|(?P<shut>[)\]])|(?P<block>\{)|(?P<done>\})|(?P<semi>;)|(?P<blank>[ \t\r\f]+)|(?P<word>[\w$]+)|(?P<rest>.)"
    )


MARKS = {x: marks(x) for x in LITERALS}


class File:
    """The statements of one file, growing."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.stack: list[int] = []  # open blocks, by the place of the statement that opened them
        self.line = 1
        self.clear()
        self.notes: list[tuple[int, str]] = []  # comments that may describe the next statement, with their last lines

    def clear(self) -> None:
        self.code: list[str] = []
        self.raw: list[str] = []
        self.start = 0

    def add(self, code: str, raw: str) -> None:
        if not self.start and code.strip():
            self.start, self.raw = self.line, []
        self.code.append(code)
        if self.start:
            self.raw.append(raw)

    def text(self) -> str:
        return "".join(self.code).strip()

    def note(self, text: str) -> None:
        if self.notes and self.notes[-1][0] < self.line - 1:
            self.notes = []
        self.notes.append((self.line + text.count("\n"), text))

    def finish(self, opens: bool, last: int | None = None) -> None:
        """Ends the statement; one that opens a block holds those that follow."""
        code = self.text()
        if code or opens:
            start = self.start or self.line
            doc = "\n".join(x for _, x in self.notes) if self.notes and self.notes[-1][0] >= start - 1 and self.notes[0][0] <= start else ""
            last = last or self.line
            self.rows.append({"seq": len(self.rows), "above": list(self.stack), "line": start, "last": last, "end": last, "opens": opens, "code": code, "raw": "".join(self.raw).strip(), "doc": doc})
            if opens:
                self.stack.append(len(self.rows) - 1)
            self.notes = []
        self.clear()

    def close(self, end: int) -> None:
        if self.stack:
            self.rows[self.stack.pop()]["end"] = end


def holes(literal: str, mark: str) -> str:
    """The expressions within a literal."""
    found = re.findall(mark + r"\{([^{}]*)\}", literal)
    return '""' + "".join(f"+({x.split('!')[0].split(':')[0]})" for x in found)


def python(text: str) -> File:
    f = File()
    depth, column, fresh, tail = 0, 0, True, 1  # tail: the last line with code
    columns: list[float] = []
    for m in PYTHON.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "blank":
            if fresh:
                column = len(s.expandtabs(8))
            f.add(" ", s)
        elif kind == "comment":
            pass
        elif kind == "line":
            if not depth:
                f.finish(False, tail)
                fresh, column = True, 0
            else:
                f.add("\n", s)
        elif kind == "join":
            f.add(" ", s)
        else:
            if not f.start:
                at = column if fresh else columns[-1] + 0.5 if f.rows and f.rows[-1]["opens"] and columns else column
                while columns and fresh and columns[-1] >= at:
                    columns.pop()
                    f.close(tail)
                here, fresh = at, False
            if kind == "literal":
                code = '""'
                if "f" in s[:2].lower() and s[:1] not in "\"'":
                    code = holes(s.replace("{{", "").replace("}}", ""), "")
                f.add(code, s)
            elif kind == "semi" and not depth:
                f.finish(False)
            elif kind == "colon" and not depth and re.match(r"\w*", f.text()).group() in HEADS and "lambda" not in f.text():
                tail = f.line
                f.finish(True)
                columns.append(here)
            else:
                depth = max(0, depth + (kind == "open") - (kind == "shut"))
                f.add(s, s)
            tail = f.line + s.count("\n")
        f.line += s.count("\n")
    f.finish(False, tail)
    while f.stack:
        f.close(tail)
    # A statement that is a string alone, first in a block, describes it.
    for r in f.rows:
        if r["code"] == '""' and r["above"] and r["above"][-1] == r["seq"] - 1:
            f.rows[r["above"][-1]]["doc"] = r["raw"]
    return f


def braced(text: str, language: str) -> File:
    f = File()
    depth, fresh = 0, True
    inner: list[str] = []  # braces that hold no block, or a block
    for m in MARKS[language].finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "blank" or kind == "skip":
            f.add(" ", s)
        elif kind == "comment":
            if fresh and not f.text():
                f.note(s)
        elif kind == "line":
            fresh = True
            code = f.text() if language in LINE_ENDS and not depth else ""
            ends = bool(code) and (bool(GO_ENDS.search(code)) if language == "go" else not UNFINISHED.search(code) and not GOES_ON.match(text, m.end()))
            if ends:
                f.finish(False)
            else:
                f.add("\n", s)
        elif kind == "directive":
            f.finish(False)
            f.add(s.strip(), s.strip())
            f.finish(False, f.line + s.count("\n"))
        elif kind == "block":
            code = f.text()
            if depth or NO_BLOCK.search(code) or language == "go" and text[m.end() : m.end() + 1] == "}" and GO_EMPTY.search(code):
                inner.append("")
                depth += 1
                f.add(s, s)
            else:
                f.finish(True)
                inner.append("block")
        elif kind == "done":
            if inner and inner.pop() == "":
                depth = max(0, depth - 1)
                f.add(s, s)
            else:
                f.finish(False)
                depth = 0
                f.close(f.line)
        elif kind == "semi" and not depth:
            f.finish(False)
        elif kind == "rest" and s == ":" and language == "cpp" and LABEL.match(f.text()):
            f.clear()
        else:
            fresh = False
            depth = max(0, depth + (kind == "open") - (kind == "shut"))
            f.add(holes(s, r"\$") if kind == "literal" and s.startswith("`") else '""' if kind == "literal" else s, s)
        f.line += s.count("\n")
    f.finish(False)
    while f.stack:
        f.close(f.line)
    return f


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()[:16]


def rows(path: str, language: str, text: str | None, like: dict[str, str] | None = None) -> list[dict]:
    """The file's own row, then its statements; of a file that cannot be read, its own row with the error.

    like: whose marks other languages use.
    """
    text, marks = text or "", (like or {}).get(language, language)
    lines = text.split("\n")
    every = {"path": path, "language": language, "lines": len(lines), "error": None}
    own = every | {"seq": FILE, "above": [], "line": 1, "last": 1, "end": len(lines), "opens": True, "code": "", "raw": "", "doc": "", "hash": digest(lines)}
    try:
        found = python(text) if marks == "python" else braced(text, marks) if marks in MARKS else File()
    except Exception as e:  # one file must not end the job; the row says what was wrong
        return [own | {"error": f"{type(e).__name__}: {e}"}]
    return [own, *(every | r | {"hash": digest(lines[r["line"] - 1 : r["end"]])} for r in found.rows)]


def statements(files: DataFrame, like: dict[str, str] | None = None) -> DataFrame:
    """One row per statement of the files (path, language, text), and one per file with seq FILE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"seq": pa.int32(), "above": pa.list_(pa.int32()), "line": pa.int32(), "last": pa.int32(), "end": pa.int32(), "lines": pa.int32(), "opens": pa.bool_()}
        for b in batches:
            for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = rows(path, language, text, like)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names=names)

    return files.select("path", "language", "text").mapInArrow(run, SCHEMA)
