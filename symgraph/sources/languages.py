"""What definitions, imports and bases look like in each language, as patterns over statements.

A language is a value in a registry: register() adds one, or replaces one, from outside.
Patterns are matched on a statement's head: its code in one line, without annotations.
"""

from __future__ import annotations

import keyword
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A statement that fits is a definition of the kind; group 1 of the pattern is its name, or names with commas.

    opens: whether it must open a block (None: either way); where: "any", "file" (in no
    block), "type" (in a type's block) or "outer" (in no block, or in a type's).
    """

    kind: str
    pattern: str
    opens: bool | None = None
    where: str = "any"


class Language(NamedTuple):
    """like: whose marks the lexer uses; extends and implements: patterns of lists of bases, in group 1."""

    name: str
    like: str
    rules: tuple[Rule, ...]
    imports: str
    import_prefix: str = "import:"
    separator: str = "."
    extends: tuple[str, ...] = ()
    implements: tuple[str, ...] = ()
    embedded: str = ""  # a statement in a type's block that names a base, in group 1
    flows: bool = False  # reads, writes and references of types are taken
    keywords: frozenset[str] = frozenset()
    skipped: frozenset[str] = frozenset()  # names that are neither read nor written


U = "(?U)"
NAME = r"([\p{L}_$][\w$]*)"
TYPE = r"[\w.]+(?:<.*>)?(?:\[\])*\??"
MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|override|open|data|inner|internal|inline|suspend|lateinit|const|transient|volatile|strictfp|fileprivate|mutating|weak|required|convenience|class)\s+)*"
#: Names that the flow of data passes over.
PYTHON_SKIPPED = frozenset(
    """self cls True False None print len range int str float bool list dict set tuple type isinstance super property staticmethod classmethod
    enumerate zip map filter sorted reversed next iter hasattr getattr setattr delattr any all sum min max abs round""".split()
)
TYPESCRIPT_SKIPPED = frozenset(
    """this self true false null undefined console Object Array String Number Boolean Promise Map Set Symbol Error RegExp Date JSON Math
    parseInt parseFloat isNaN isFinite require module exports window document""".split()
)
TYPESCRIPT_WORDS = frozenset(
    """await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements
    import in instanceof interface let new null of package private protected public return static super switch this throw true try type typeof
    var void while with yield async as get set readonly""".split()
)
#: Words before a parenthesis that are no calls.
NO_CALL = "if for foreach while switch catch return def class function fn func fun match elif with not and or in is lambda sizeof new await yield assert except print guard when using synchronized init deinit".split()
FUNCTIONS = ("function", "method")
TYPES = ("class", "struct", "interface", "trait", "enum")

LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> None:
    """Adds a language; the lexer reads it by the marks of language.like."""
    LANGUAGES[language.name] = language


register(Language(
    "python", "python",
    (
        Rule("class", U + rf"^class\s+{NAME}", True), Rule("function", U + rf"^(?:async\s+)?def\s+{NAME}", True),
        Rule("constant", U + r"^([\p{L}_]\w*(?:\s*,\s*[\p{L}_]\w*)*)\s*(?::[^=]+)?=(?!=)", False, "file"),
    ),
    U + r"^(?:import\s+\S.*|from\s+\S+\s+import\b.*)$",
    extends=(U + r"^class\s+\w+\s*(?:\[.*?\])?\s*\((.*)\)$",), flows=True, keywords=frozenset(keyword.kwlist), skipped=PYTHON_SKIPPED,
))
EXPORT = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
ARROW = r"(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"
FIELD = r"^(?:(?:public|private|protected|static|readonly|declare|abstract|override|accessor)\s+)*#?" + NAME + r"[?!]?"
TYPESCRIPT = Language(
    "typescript", "typescript",
    (
        Rule("class", U + rf"{EXPORT}(?:abstract\s+)?class\s+{NAME}", True), Rule("interface", U + rf"{EXPORT}interface\s+{NAME}", True), Rule("enum", U + rf"{EXPORT}(?:const\s+)?enum\s+{NAME}", True),
        Rule("type_alias", U + rf"{EXPORT}type\s+{NAME}\s*(?:<.*?>)?\s*="), Rule("module", U + rf"{EXPORT}(?:namespace|module)\s+{NAME}", True),
        Rule("function", U + rf"{EXPORT}(?:async\s+)?function\s*\*?\s*{NAME}"), Rule("function", U + rf"{EXPORT}(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*{ARROW}"), Rule("function", U + rf"^(?:[\w$]+\.)+{NAME}\s*=\s*{ARROW}"),
        Rule("method", U + r"^(?!(?:if|for|while|switch|catch|return|function|do|else|with)\b)(?:(?:public|private|protected|static|async|get|set|abstract|override|declare)\s+)*\*?\s*#?" + NAME + r"[?!]?\s*(?:<[^(]*>)?\s*\(", None, "type"),
        Rule("method", U + rf"{FIELD}\s*(?::[^=]+)?=\s*{ARROW}", None, "type"), Rule("variable", U + rf"{FIELD}\s*(?:[:=]|$)", False, "type"),
        Rule("constant", U + rf"^(?:export\s+)?(?:declare\s+)?const\s+{NAME}\s*[:=]", None, "file"), Rule("constant", U + r"^(?:export\s+)?(?:let|var)\s+([\p{Lu}_$][\p{Lu}\d_$]+)\b\s*[:=]", None, "file"), Rule("variable", U + rf"^(?:export\s+)?(?:declare\s+)?(?:let|var)\s+{NAME}", None, "file"),
    ),
    U + r"^import\b(?!\s*\().*$",
    extends=(U + r"\bextends\s+(.+?)(?:\s+implements\b.*)?$",), implements=(U + r"\bimplements\s+(.+)$",), flows=True, keywords=TYPESCRIPT_WORDS, skipped=TYPESCRIPT_SKIPPED,
)
register(TYPESCRIPT)
register(TYPESCRIPT._replace(name="javascript", like="javascript"))
PUB = r"^(?:pub(?:\([^)]*\))?\s+)?"
register(Language(
    "rust", "rust",
    (
        Rule("struct", U + rf"{PUB}(?:struct|union)\s+{NAME}"), Rule("trait", U + rf"{PUB}(?:unsafe\s+)?trait\s+{NAME}"), Rule("enum", U + rf"{PUB}enum\s+{NAME}"), Rule("module", U + rf"{PUB}mod\s+{NAME}"),
        Rule("module", U + r"^(?:unsafe\s+)?impl\b\s*(?:<.*?>)?\s*(?:!?[\w:]+(?:<.*?>)?\s+for\s+)?&?(?:'\w+\s+)?(?:\w+::)*" + NAME, True),
        Rule("function", U + rf"{PUB}(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"\"\s+)?)*fn\s+{NAME}"),
    ),
    U + r"^(?:pub(?:\([^)]*\))?\s+)?use\s.*$", "use:", "::",
    extends=(U + r"\btrait\s+\w+(?:<.*?>)?\s*:\s*(.+?)(?:\bwhere\b.*)?$",), implements=(U + r"^(?:unsafe\s+)?impl\b\s*(?:<.*?>)?\s*!?([\w:]+)(?:<.*?>)?\s+for\b",),
))
register(Language(
    "go", "go",
    (
        Rule("method", U + rf"^func\s*\([^)]*\)\s*{NAME}", True), Rule("function", U + rf"^func\s+{NAME}"), Rule("struct", U + rf"^type\s+{NAME}(?:\[.*?\])?\s+struct\b"), Rule("interface", U + rf"^type\s+{NAME}(?:\[.*?\])?\s+interface\b"),
        Rule("constant", U + rf"^const\s+{NAME}", None, "file"),
    ),
    U + r"^import\b.*$", "import:", "::", embedded=U + r"^\*?([\w.]+)$",
))
JAVA = Language(
    "java", "java",
    (
        Rule("module", U + r"^package\s+([\w.]+)", False, "file"), Rule("interface", U + rf"^{MODIFIERS}@?interface\s+{NAME}", True), Rule("enum", U + rf"^{MODIFIERS}enum\s+(?:class\s+)?{NAME}", True),
        Rule("class", U + rf"^{MODIFIERS}(?:class|record|object|annotation\s+class)\s+{NAME}"), Rule("method", U + rf"^{MODIFIERS}(?:<.*?>\s*)?(?:{TYPE}\s+)?{NAME}\s*\([^=]*\)\s*(?:throws\s.*)?$", None, "type"),
        Rule("constant", U + rf"^(?:(?:public|private|protected)\s+)?(?:static\s+final|final\s+static)\s+{TYPE}\s+{NAME}", False, "type"), Rule("variable", U + rf"^{MODIFIERS}{TYPE}\s+{NAME}\s*(?:\[\])?\s*(?:[=,].*)?$", None, "type"),
    ),
    U + r"^import\s.*$", extends=(U + r"\bextends\s+(.+?)(?:\s+(?:implements|permits)\b.*)?$",), implements=(U + r"\bimplements\s+(.+?)(?:\s+permits\b.*)?$",),
)
register(JAVA)
register(JAVA._replace(
    name="kotlin", like="kotlin",
    rules=(
        JAVA.rules[0], Rule("interface", U + rf"^{MODIFIERS}(?:fun\s+)?interface\s+{NAME}"), Rule("enum", U + rf"^{MODIFIERS}enum\s+class\s+{NAME}"), Rule("class", U + rf"^{MODIFIERS}(?:annotation\s+|value\s+)?(?:class|object)\s+{NAME}"),
        Rule("function", U + rf"^(?:{MODIFIERS}(?:operator|infix|tailrec|external)?\s*)fun\s+(?:<.*?>\s*)?(?:[\w.<>?]+\.)?{NAME}\s*\("),
        Rule("constant", U + rf"^{MODIFIERS}val\s+(?:<.*?>\s*)?(?:\w+\.)?{NAME}", None, "outer"), Rule("variable", U + rf"^{MODIFIERS}var\s+(?:<.*?>\s*)?(?:\w+\.)?{NAME}", None, "outer"),
    ),
    # Called bases are classes, others are interfaces; parentheses are empty here.
    extends=(U + r"\b(?:class|object)\s+\w+[^:]*:\s*(.*\(\).*)$",), implements=(U + r"\b(?:class|object|interface)\s+\w+[^:]*:\s*(.*)$",),
))
register(Language(
    "swift", "swift",
    (
        Rule("struct", U + rf"^{MODIFIERS}struct\s+{NAME}", True), Rule("interface", U + rf"^{MODIFIERS}protocol\s+{NAME}", True), Rule("enum", U + rf"^{MODIFIERS}(?:indirect\s+)?enum\s+{NAME}", True),
        Rule("class", U + rf"^(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|actor|extension)\s+{NAME}", True), Rule("function", U + rf"^{MODIFIERS}func\s+{NAME}"), Rule("method", U + rf"^{MODIFIERS}(init)\b[?!]?\s*(?:<.*?>)?\(", None, "type"),
        Rule("constant", U + rf"^{MODIFIERS}let\s+{NAME}", None, "outer"), Rule("variable", U + rf"^{MODIFIERS}(?:\w+\(set\)\s+)?var\s+{NAME}", None, "outer"),
    ),
    U + r"^import\s.*$", extends=(U + r"^(?:\w+\s+)*(?:class|actor|protocol)\s+\w+(?:<.*?>)?\s*:\s*(.*?)(?:\bwhere\b.*)?$",), implements=(U + r"^(?:\w+\s+)*(?:class|actor|struct|enum|extension)\s+[\w.]+(?:<.*?>)?\s*:\s*(.*?)(?:\bwhere\b.*)?$",),
))
C = Language(
    "c", "c",
    (
        Rule("class", U + rf"^(?:template\s*<.*?>\s*)?class\s+(?:\w+\s+)??{NAME}\s*(?:final\s*)?(?::|$)", True), Rule("struct", U + rf"^(?:template\s*<.*?>\s*)?(?:struct|union)\s+{NAME}\s*(?:final\s*)?(?::|$)", True),
        Rule("enum", U + rf"^enum\s+(?:class\s+|struct\s+)?{NAME}", True), Rule("type_alias", U + rf"^typedef\b.*?{NAME}\s*(?:\[[^\]]*\])?$", False), Rule("type_alias", U + rf"^typedef\b.*\(\s*\*\s*{NAME}\s*\)\s*\(.*\)$", False), Rule("type_alias", U + rf"^using\s+{NAME}\s*=", False),
        Rule("module", U + r"^(?:inline\s+)?namespace\s+([\w:]+)", True),
        Rule("function", U + r"^(?!(?:if|for|while|switch|return|else|do|catch|namespace|class|struct|enum|union|typedef)\b(?!.*\)\s*$)|(?:if|for|while|switch|return|else|catch)\b)[^=]*?(?<![\w$])(~?[\p{L}_$][\w$]*|operator\s*\W{1,3})\s*\((?:[^()]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|volatile|&|\s)*(?:->.*|:.*|try)?$", True),
        Rule("variable", U + r"^(?!(?:using|return|typedef|friend|template|extern\s+\"|goto|namespace|class|struct\s+\w+$|enum|union\s+\w+$)\b)(?:[\w:<>,]+[\s*&]+)+" + NAME + r"\s*(?:\[[^\]]*\])*\s*(?:=.*)?$", None, "file"),
    ),
    U + r"^#\s*include\b.*$", "include:", "::", extends=(U + r"^(?:template\s*<.*?>\s*)?(?:class|struct)\s+(?:\w+\s+)*?\w+\s*(?:final\s*)?:(?!:)\s*(.*)$",),
)
register(C)
register(C._replace(name="cpp", like="cpp"))


def by_language(pick) -> Column:
    """The first non-null of a column expression for each registered language."""
    found = [F.when(F.col("language") == x.name, c) for x in LANGUAGES.values() if (c := pick(x)) is not None]
    return F.coalesce(*found)


def first_line(column: Column | str) -> Column:
    """One line, single spaces, without annotations at the start and access labels."""
    flat = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.regexp_replace(flat, U + r"^(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)+(?!$)", "")


def definition(in_block: Column, in_type: Column) -> Column:
    """(kind, names) of the first rule of the statement's language that fits, else null."""

    def one(x: Language) -> Column:
        whens = []
        for r in x.rules:
            fits = F.col("head").rlike(r.pattern)
            fits = fits if r.opens is None else fits & (F.col("opens") == r.opens)
            fits = {"file": fits & ~in_block, "type": fits & in_type, "outer": fits & (~in_block | in_type)}.get(r.where, fits)
            whens.append(F.when(fits, F.struct(F.lit(r.kind).alias("kind"), F.regexp_extract("head", r.pattern, 1).alias("name"))))
        return F.coalesce(*whens)

    return by_language(one)


def is_import() -> Column:
    return F.coalesce(by_language(lambda x: F.col("head").rlike(x.imports)), F.lit(False))


def base_names(text: Column, within: str = ",") -> Column:
    """The names of a list of bases: without generics, arguments, access words and keyword arguments."""
    for _ in range(3):
        text = F.regexp_replace(text, r"<[^<>]*>|\[[^\[\]]*\]", "")
    items = F.transform(F.split(text, rf"[{within}]"), lambda s: F.trim(F.regexp_replace(s, r"\b(?:public|private|protected|virtual)\b|\([^()]*\)|^\s*[*&?]|'\w+", "")))
    return F.filter(items, lambda s: s.rlike(U + r"^[\p{L}_$][\w$]*(?:(?:\.|::)[\p{L}_$][\w$]*)*$"))


def bases() -> tuple[Column, Column]:
    """extends and implements of a type's head, as arrays of texts."""
    flat = F.regexp_replace("head", r"\((?:[^()]|\([^()]*\))*\)", "()")
    for _ in range(3):  # generics, from the inside
        flat = F.regexp_replace(flat, r"<[^<>]*>", "")
    none = F.array().cast("array<string>")

    def listed(x: Language, patterns: tuple[str, ...]) -> Column | None:
        head = F.col("head") if x.like == "python" else flat
        parts = [base_names(F.regexp_extract(head, p, 1), ",+" if x.name == "rust" else ",") for p in patterns]
        return F.concat(*parts) if parts else None

    extends, implements = by_language(lambda x: listed(x, x.extends)), by_language(lambda x: listed(x, x.implements))
    of_kotlin = lambda called: F.filter(F.split(F.regexp_extract(flat, U + r"\b(?:class|object|interface)\s+\w+[^:]*:\s*(.*)$", 1), ","), lambda s: s.contains("()") == called)
    kotlin, swift, first = F.col("language") == "kotlin", F.col("language") == "swift", F.col("kind") == "class"
    names = lambda items: base_names(F.array_join(items, ","))
    own = F.coalesce(extends, none)
    others = F.coalesce(implements, none)
    # Swift: a class's first base may be a class, the others are protocols.
    return (
        F.when(kotlin & (F.col("kind") == "interface"), names(F.concat(of_kotlin(True), of_kotlin(False)))).when(kotlin, names(of_kotlin(True))).when(swift & first & ~F.col("head").contains("extension "), F.slice(own, 1, 1)).when(swift & (F.col("kind") != "interface"), none).otherwise(own),
        F.when(kotlin & (F.col("kind") == "interface"), none).when(kotlin, names(of_kotlin(False))).when(swift & first & ~F.col("head").contains("extension "), F.slice(others, 2, 1000)).when(swift & (F.col("kind") == "interface"), none).otherwise(others),
    )
