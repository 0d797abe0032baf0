"""Symbols and references from source files.

The lexer cuts a file into statements with their blocks, one row each; all else is
columns and joins over these rows: patterns per language find definitions, imports and
bases, statements meet the definitions around them by the file and the place of the
statement, and calls, reads, writes and type names become edges to unresolved texts,
which symgraph.operators.resolve binds.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions.text import doc_text, short_id
from symgraph.schema import LANGUAGES, SKIP_DIRS
from symgraph.sources import languages as rules
from symgraph.sources import lexer
from symgraph.sources.shared import cut

def language() -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[F.regexp_extract("path", r"(\.[^./]+)$", 1)], F.lit("unknown"))


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def plain_path(root: str) -> str:
    """root without a scheme, as an absolute path."""
    start = re.sub(SCHEME, "", root)
    return (start if start != root or root.startswith("/") else os.path.abspath(root)).rstrip("/")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, language, text of the source files under root, without skipped folders.

    Only the part of a path below root decides whether it is skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = [unquote(re.sub("^file:/+", "file:/", x)) for x in files.inputFiles()]  # as the path column has them
    files = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    # Spark leaves files without content out of the scan, but not out of the listing.
    empty = spark.createDataFrame([(x, "") for x in full], "path string, text string").join(files.select("path"), "path", "left_anti")
    files = files.unionByName(empty).withColumn("language", language())
    path = F.regexp_replace("path", SCHEME, "")
    below = path.substr(F.lit(len(plain_path(root)) + 1), F.length(path))
    skipped = "|".join(f"/{re.escape(d)}/" for d in SKIP_DIRS) + r"|/\.[^/]+/"
    return files.filter((F.col("language") != "unknown") & ~below.rlike(skipped))


U = rules.U
WORD = U + r"(?<![\w$])([\p{L}_$][\w$]*)"
#: A called text: a name with its path, or one with arguments on the way.
CALL = U + r"(?<![\w$.:)\]])([\p{L}_$][\w$]*(?:\s*(?:\?\.|\.|::|->)\s*[\p{L}_$][\w$]*)*)\s*(?:<[\w\s,<>\[\]?.]*>)?\s*\("
CHAIN = U + r"(?<![\w$.:)\]])([\p{L}_$][\w$]*(?:\.[\w$]+)*(?:\([^()]*\)(?:\.[\p{L}_$][\w$]*)+)+)\s*\("
NEW = U + r"\bnew\s+([\p{L}_$][\w$.:]*)"
#: What is written, an annotation, and what it gets; and the same with an operator.
ASSIGNED = U + r"(?s)^((?:[^=<>!()\[\]:]|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\([^()]*\))*?)(:[^=]*?)?(?<![=<>!+\-*/%&|^:@])=(?![=>])(.*)$"
AUGMENTED = U + r"(?s)^([^=()]*?)\s*(?:\+|-|\*\*?|//?|%|&&?|\|\|?|\^|@|<<|>>|\?\?)=(?!=)(.*)$"
DECLARED = U + r"^(?:export\s+)?(?:const|let|var|val|auto|final|static|public|private|protected|readonly|mut)\s+"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def statements(files: DataFrame) -> DataFrame:
    """The statements of the files with their definition (kind, name), and what holds them.

    holders: the definitions around a statement, outermost first, up to the first
    function: nothing is kept of what stands within a function's body.
    """
    s = cut(lexer.statements(files, {x.name: x.like for x in rules.LANGUAGES.values()}).withColumn("head", rules.first_line("code")))
    no, yes = F.lit(False), F.lit(True)
    is_type = F.col("opens") & rules.definition(no, no)["kind"].isin(*rules.TYPES)
    is_impl = F.col("opens") & (F.col("language") == "rust") & F.col("head").rlike(r"\bimpl\b")
    types = s.filter(is_type | is_impl).select("path", F.col("seq").alias("parent"), yes.alias("in_type"))
    s = s.withColumn("parent", F.try_element_at("above", F.lit(-1))).join(types, ["path", "parent"], "left").withColumn("in_type", F.coalesce("in_type", no))
    found_ = F.when(~rules.is_import(), rules.definition(F.size("above") > 0, F.col("in_type")))
    own = F.when(F.col("seq") == lexer.FILE, F.struct(F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"))).otherwise(found_)
    own = F.when(rules.is_import() & (F.col("seq") != lexer.FILE), F.struct(F.lit("import").alias("kind"), F.substring("raw", 1, 80).alias("name"))).otherwise(own)
    impl = (F.col("language") == "rust") & own["kind"].eqNullSafe("module") & F.col("head").rlike(r"\bimpl\b")
    s = s.withColumn("def", F.when(impl, F.struct(F.lit("module").alias("kind"), F.concat(F.lit("impl "), own["name"]).alias("name"))).otherwise(own))
    in_python_private = (F.col("language") == "python") & (F.col("def.kind") == "constant") & F.col("def.name").startswith("_")
    s = cut(s.withColumn("def", F.when(~in_python_private & (F.col("def.name") != ""), F.col("def"))))

    # Of definitions with the same lines the first has the plain id.
    same = Window.partitionBy("path", "line", "end").orderBy("seq")
    defs = s.filter("def is not null").select("path", "seq", "line", "end", "def.kind", "def.name", F.row_number().over(same).alias("_n"))
    ident = F.when(F.col("_n") == 1, short_id(F.col("path"), F.col("line"), F.col("end"))).otherwise(short_id(F.col("path"), F.col("line"), F.col("end"), F.col("kind"), F.col("name")))
    defs = defs.withColumn("id", ident)
    chain = s.select("path", "seq", F.explode("above").alias("at")).join(defs.select("path", F.col("seq").alias("at"), "kind", "name", "id"), ["path", "at"])
    chain = chain.groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "name", "id"))).alias("holders"))
    s = s.join(chain, ["path", "seq"], "left").join(defs.select("path", "seq", "id"), ["path", "seq"], "left")
    first = F.array_position(F.transform("holders", lambda h: h["kind"].isin(*rules.FUNCTIONS).cast("string")), "true").cast("int")
    inside = F.coalesce(first, F.lit(0)) > 0
    file_id = short_id(F.col("path"), F.lit(1), F.col("lines"))
    s = s.withColumns({"file_id": file_id, "kept": F.col("def").isNotNull() & ~inside, "holders": F.when(inside, F.expr("slice(holders, 1, cast(array_position(transform(holders, h -> cast(h.kind IN ('function', 'method') AS string)), 'true') AS int))")).otherwise(F.coalesce("holders", F.array().cast("array<struct<at:int,kind:string,name:string,id:string>>")))})
    last = F.try_element_at("holders", F.lit(-1))
    in_class = F.exists("holders", lambda h: h["kind"].isin(*rules.TYPES)) | (F.col("language") == "rust") & F.exists("holders", lambda h: (h["kind"] == "module") & h["name"].startswith("impl "))
    kind = F.when((F.col("def.kind") == "function") & in_class & ~((F.col("language").isin("c", "cpp")) & ~F.col("in_type")), "method").otherwise(F.col("def.kind"))
    owner = F.when(F.col("kept"), F.col("id")).otherwise(F.coalesce(last["id"], F.col("file_id")))
    owner_kind = F.when(F.col("kept"), kind).otherwise(F.coalesce(last["kind"], F.lit("file")))
    return s.withColumns({"kind": kind, "owner": owner, "owner_kind": owner_kind, "parent_id": F.coalesce(last["id"], F.col("file_id"))})


def node_table(s: DataFrame) -> DataFrame:
    """The nodes of the kept definitions, a row for each name of a definition."""
    impl = (F.col("language") == "rust") & F.col("_name").startswith("impl ")
    separator = F.coalesce(rules.by_language(lambda x: F.lit(x.separator)), F.lit("."))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    raw = F.trim(F.regexp_replace("raw", r"\s+", " "))
    d = s.filter("kept").withColumn("_name", F.explode(F.when(F.col("kind") == "import", F.array("def.name")).otherwise(F.split("def.name", r"\s*,\s*"))))
    d = d.filter(~((F.col("language") == "python") & (F.col("kind") == "constant") & F.col("_name").startswith("_")))
    # A C++ method that is defined outside of its class has the class in front of its name.
    outside = F.when(F.col("language") == "cpp", F.regexp_extract("head", U + r"((?:\w+::)+)~?\w+\s*\(", 1)).otherwise("")
    holders = F.transform("holders", lambda h: h["name"])
    plain = F.concat(F.array_join(F.concat(F.array(stem), holders), "\x00"), F.lit("\x00"), F.replace(outside, F.lit("::"), F.lit("\x00")), F.col("_name"))
    in_impl = (F.col("language") == "rust") & F.exists("holders", lambda h: h["name"].startswith("impl "))
    rust = F.concat_ws("::", F.replace(F.try_element_at("holders", F.lit(-1))["name"], F.lit(" "), F.lit("_")), F.col("_name"))
    prefix = F.coalesce(rules.by_language(lambda x: F.lit(x.import_prefix)), F.lit("import:"))
    qualified = (
        F.when(F.col("kind") == "file", F.col("path")).when(F.col("kind") == "import", F.concat(prefix, F.col("_name"))).when(impl, F.replace("_name", F.lit(" "), F.lit("_")))
        .when(in_impl & (F.col("kind") == "method"), rust).otherwise(F.replace(plain, F.lit("\x00"), separator))
    )
    python = F.col("language") == "python"
    doc = F.when(python, F.trim(F.regexp_replace("doc", r"^\w{0,2}[\"']+|[\"']+$", ""))).otherwise(doc_text(F.col("doc")))
    doc = F.when(F.col("kind").isin("file", "import"), "").otherwise(doc)
    signature = F.when(F.col("kind").isin("file", "import") | python & (F.col("kind") == "class"), "").otherwise(F.regexp_replace(raw, r"^async (?=def )", ""))
    private = F.col("_name").rlike("^_[^_]") | F.col("head").rlike(r"^(?:[\w@]+\s+)*(?:private|fileprivate)\b")
    visibility = F.when(F.col("kind").isin("file", "import"), "public").when(private, "private").when(F.col("head").rlike(r"^(?:[\w@]+\s+)*protected\b"), "protected").otherwise("public")
    flag = lambda word: F.col("head").rlike(rf"^(?:[\w@]+\s+)*{word}\b") & ~F.col("kind").isin("file", "import")
    first = F.col("_name") == F.element_at(F.split("def.name", r"\s*,\s*"), 1)
    ident = F.when(first | (F.col("kind") == "import"), F.col("id")).otherwise(short_id(F.col("path"), F.col("line"), F.col("end"), F.col("kind"), F.col("_name")))
    return d.select(
        ident.alias("id"), "kind", F.col("_name").alias("name"), qualified.alias("qualified_name"), F.col("path").alias("file_path"), "language",
        F.col("line").alias("start_line"), F.col("end").alias("end_line"), doc.alias("docstring"), signature.alias("signature"), visibility.alias("visibility"),
        F.when(F.col("kind") != "file", F.col("parent_id")).alias("parent_id"), flag(r"(?:export|pub|public)").alias("is_exported"), flag("async").alias("is_async"), flag("static").alias("is_static"), flag("abstract").alias("is_abstract"),
        F.col("hash").alias("content_hash"), F.col("seq").cast("long").alias("seq"),
    )


def body() -> Column:
    """The part of a statement that is run by its owner: not the heads of definitions and imports."""
    after = lambda pattern: F.regexp_extract("code", U + "(?s)" + pattern, 1)
    typescript, kotlin = F.col("language").isin("typescript", "javascript"), F.col("language") == "kotlin"
    of_function = F.when(typescript, after(r"=>(.*)$")).when(kotlin, after(r"\)\s*(?::[^={]+)?=(.*)$")).otherwise("")
    kind = F.when(F.col("kept"), F.col("kind"))
    return F.when(kind.isin(*rules.FUNCTIONS), of_function).when(kind.isin("constant", "variable"), after(r"^[^=]*=(.*)$")).when(kind.isNotNull(), "").otherwise(F.col("code"))


def loose(rows: DataFrame, text: Column, kind: str, confidence: float, line: Column) -> DataFrame:
    return rows.select(F.col("owner").alias("source_id"), text.alias("target_text"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), line.alias("line"))


def call_edges(s: DataFrame) -> DataFrame:
    cuts = F.regexp_count("code", F.lit("\n")) - F.regexp_count("_body", F.lit("\n"))
    d = s.filter(F.col("owner_kind").isin(*rules.FUNCTIONS, "constant", "variable")).withColumn("_body", body()).filter("_body <> ''")
    d = d.select("owner", "language", (F.col("line") + cuts).alias("line"), F.posexplode(F.split("_body", "\n")).alias("nth", "text")).withColumn("line", F.col("line") + F.col("nth"))
    made = F.when(F.col("language").isin("typescript", "javascript", "java", "cpp"), found(F.col("text"), NEW)).otherwise(F.array().cast("array<string>"))
    plain = F.regexp_replace("text", U + r"\bnew\s+[\p{L}_$][\w$.:]*(?:<[^()]*>)?", "")
    # A function within the body is no call of it.
    plain = F.regexp_replace(plain, U + r"\b(?:def|function|func|fun|fn|class)\s+[\p{L}_$][\w$]*", "")
    called = F.transform(F.concat(found(plain, CALL), found(plain, CHAIN)), lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit("?."), F.lit(".")))
    called = F.filter(F.array_distinct(called), lambda x: ~x.isin(*rules.NO_CALL))
    calls = d.withColumn("t", F.explode(called))
    return loose(calls, F.col("t"), "calls", 0.5, F.col("line")).unionByName(loose(d.withColumn("t", F.explode(made)), F.col("t"), "instantiates", 0.5, F.col("line")))


def base_edges(s: DataFrame) -> DataFrame:
    extends, implements = rules.bases()
    heads = s.filter(F.col("kept") & (F.col("kind").isin(*rules.TYPES) | (F.col("language") == "rust") & (F.col("kind") == "module")))
    embedded = rules.by_language(lambda x: F.regexp_extract("head", x.embedded, 1) if x.embedded else None)
    fields = s.filter(F.col("in_type") & ~F.col("kept")).withColumn("t", embedded).filter("t <> ''")
    return reduce(DataFrame.unionByName, [
        loose(heads.withColumn("t", F.explode(extends)), F.col("t"), "extends", 0.5, F.col("line")), loose(heads.withColumn("t", F.explode(implements)), F.col("t"), "implements", 0.5, F.col("line")),
        loose(fields, F.col("t"), "extends", 0.5, F.col("line")),
    ])


def flow_edges(s: DataFrame) -> DataFrame:
    """reads and writes of functions, and the types that they name; what a function writes it does not read."""
    flows = [x for x in rules.LANGUAGES.values() if x.flows]
    d = s.filter(F.col("language").isin(*[x.name for x in flows]) & F.col("owner_kind").isin(*rules.FUNCTIONS)).withColumn("_body", body())
    keys = {x.name: sorted(x.keywords) for x in flows}
    is_python = F.col("language") == "python"
    # Names of members are no names of variables, but in Python they count.
    text = lambda c: F.when(is_python, c).otherwise(F.regexp_replace(c, U + r"\.\s*[\p{L}_$][\w$]*", ""))
    not_key = lambda x: ~reduce(lambda a, b: a | b, [(F.col("language") == name) & x.isin(*words) for name, words in keys.items()])
    names = lambda c: F.filter(F.array_distinct(found(text(c), WORD)), not_key)
    part = lambda c, pattern, i: F.regexp_extract(c, pattern, i)
    code = F.trim(F.regexp_replace("_body", DECLARED, ""))
    d = d.filter("_body <> ''").withColumn("_c", code)
    whole, more = F.col("_c").rlike(ASSIGNED), F.col("_c").rlike(AUGMENTED)
    again = part("_c", ASSIGNED, 3)
    left = F.when(more, part("_c", AUGMENTED, 1)).when(whole, F.concat_ws(" ", part("_c", ASSIGNED, 1), part(again, ASSIGNED, 1)))
    right = F.when(more, F.col("_c")).when(whole & again.rlike(ASSIGNED), part(again, ASSIGNED, 3)).when(whole, again).otherwise(F.col("_c"))
    writes = d.select("owner", "language", F.explode(names(left)).alias("t")).distinct()
    reads = d.select("owner", "language", F.explode(names(right)).alias("t")).distinct().join(writes.select("owner", "t"), ["owner", "t"], "left_anti")
    skipped = reduce(lambda a, b: a | b, [(F.col("language") == x.name) & F.col("t").isin(*sorted(x.skipped)) for x in flows])
    real = ~skipped & (F.length("t") >= 2)
    writes, reads = writes.filter(real & ~(F.col("t").startswith("_") & (F.length("t") <= 2))), reads.filter(real)
    # Types: behind colons and arrows of heads and declarations, and what is subscripted.
    heads = s.filter(F.col("language").isin(*[x.name for x in flows]) & (F.col("owner_kind").isin(*rules.FUNCTIONS) | ~is_python & F.col("owner_kind").isin("class", "interface", "constant", "variable", "type_alias")))
    is_head = F.col("kept") | F.col("code").rlike(ASSIGNED) | F.col("in_type")
    noted = F.when(is_head, F.array_join(found(F.col("code"), U + r"(?s)(?::|->)\s*([^,=(){}]+(?:\[[^\]]*\])?)"), " "))
    generic = F.when(~is_python, F.array_join(found(F.col("code"), U + r"<([^<>()]*)>"), " "))
    typed = F.concat(found(F.concat_ws(" ", noted, generic), U + r"(?<![\w.$])(\p{Lu}[\w$]+)"), F.when(is_python, found(F.col("code"), U + r"(?<![\w.])(\p{Lu}\w+)\s*\[")).otherwise(F.array().cast("array<string>")))
    references = heads.withColumn("t", F.explode(F.array_distinct(typed)))
    return reduce(DataFrame.unionByName, [loose(writes, F.col("t"), "writes", 0.4, F.lit(0)), loose(reads, F.col("t"), "reads", 0.3, F.lit(0)), loose(references, F.col("t"), "references", 0.4, F.col("line"))])


def edge_table(s: DataFrame, nodes: DataFrame) -> DataFrame:
    imports = s.filter("kept AND kind = 'import'").withColumn("owner", F.col("parent_id"))
    texts = [call_edges(s), base_edges(s), flow_edges(s), loose(imports, F.col("raw"), "imports", 0.5, F.col("line"))]
    open_ = reduce(DataFrame.unionByName, texts).withColumn("target_id", F.concat(F.lit("unresolved:"), F.col("target_text")))
    contains = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), F.col("start_line").alias("line"), F.lit("").alias("target_text"))
    edges = contains.unionByName(open_).withColumn("id", short_id(F.col("source_id"), F.col("target_id"), F.col("kind")))
    columns = ["source_id", "target_id", "kind", "confidence", "line", "target_text"]
    return edges.groupBy("id").agg(F.max_by(F.struct(*columns), "line").alias("e")).select("id", "e.*")


#: Words in front of a declared name, and texts of types that say nothing about a class.
DECLARES = r"(?:(?:export|const|let|var|val|auto|final|static|public|private|protected|internal|readonly|mut|lateinit|override|open|weak|lazy)\s+)*"
TARGET = r"((?:self\.|this\.|this->)?[\p{L}_$][\w$]*)"
PATH = r"([\p{L}_$][\w$]*(?:(?:\.|::)[\p{L}_$][\w$]*)*)"
WRAPPED = r"\b(?:Optional|Final|Annotated|ClassVar|Type|Promise|Awaitable|Box|Rc|Arc|shared_ptr|unique_ptr)\s*[\[<]\s*([\w.:]+)\s*[^\[\]<>]*[\]>]"
BEHIND = ("python", "typescript", "javascript", "kotlin", "swift", "rust")  # types stand behind colons
BEFORE = ("java", "c", "cpp")  # types stand before names
MEMBERS_UNNAMED = ("java", "kotlin", "swift", "cpp")  # members need no this


def variable_table(s: DataFrame) -> DataFrame:
    """scope, holder, file_id, language, var, how, text: what statements say about variables.

    how is "type" (a type's text), "call" (the result of the called text) or "copy"
    (another variable's value); the variable "" of a function is what it returns, and
    self.x belongs to the type around.  scope is the function's, type's or file's node.
    """
    lang = F.col("language")
    holder = F.try_element_at(F.filter("holders", lambda h: h["kind"].isin(*rules.TYPES)), F.lit(-1))["id"]
    holder = F.when(F.col("kept") & F.col("kind").isin(*rules.TYPES), F.col("id")).otherwise(holder)
    d = s.filter("kind is null OR kind <> 'import'").withColumns({"holder": holder, "_u": F.regexp_replace(F.regexp_replace("head", r"\s+", " "), U + WRAPPED, "$1")})
    # Fields are kept definitions of their own, but they are variables of what holds them.
    scope = F.when(F.col("kept") & F.col("kind").isin("constant", "variable"), F.col("parent_id")).otherwise(F.col("owner"))
    rows = []

    def add(where: Column, var: Column, how: str, text: Column) -> None:
        rows.append(d.filter(where).select(scope.alias("scope"), "holder", "file_id", "language", var.alias("var"), F.lit(how).alias("how"), text.alias("text")))

    u, is_function = F.col("_u"), F.col("kept") & F.col("kind").isin(*rules.FUNCTIONS)
    part = lambda pattern, i: F.regexp_extract(u, U + pattern, i)
    # Parameters and what a function returns.
    inner = F.regexp_replace(F.regexp_replace(u, r"\[[^\[\]]*\]|<[^<>]*>", ""), r"\[[^\[\]]*\]|<[^<>]*>", "")
    args = F.when(lang == "go", F.concat_ws(",", F.regexp_extract(inner, r"^func\s*(?:\(([^)]*)\))?", 1), F.regexp_extract(inner, r"^func\s*(?:\([^)]*\)\s*)?\w+\(([^)]*)\)", 1))).otherwise(F.regexp_extract(inner, r"\(((?:[^()]|\([^()]*\))*)\)", 1))
    param = F.explode(F.split(args, ","))
    pairs = d.filter(is_function & (args != "")).select(scope.alias("scope"), "holder", "file_id", "language", param.alias("p"))
    p = F.trim(F.regexp_replace("p", r"=.*$", ""))
    one = lambda pattern, i: F.regexp_extract(p, U + pattern, i)
    behind, before, go = rf"^(?:\w+\s+)*\*{{0,2}}([\w$]+)\??\s*:\s*(?:&?\s*(?:'\w+\s+)?(?:mut\s+|dyn\s+|inout\s+)?)?{PATH}", rf"^(?:final\s+|const\s+|struct\s+)*{PATH}[\s*&]+([\w$]+)$", rf"^([\w]+)\s+\*?{PATH}$"
    var = F.when(lang.isin(*BEHIND), one(behind, 1)).when(lang.isin(*BEFORE), one(before, 2)).when(lang == "go", one(go, 1))
    kind = F.when(lang.isin(*BEHIND), one(behind, 2)).when(lang.isin(*BEFORE), one(before, 1)).when(lang == "go", one(go, 2))
    rows.append(pairs.select("scope", "holder", "file_id", "language", var.alias("var"), F.lit("type").alias("how"), kind.alias("text")).filter("var <> ''"))
    after = rf"(?:->\s*(?:&?\s*(?:'\w+\s+)?(?:mut\s+|dyn\s+)?)?{PATH})"
    returns = (
        F.when(lang.isin("python", "rust", "swift"), part(after, 1)).when(lang.isin("typescript", "javascript", "kotlin"), part(rf"\)\s*:\s*{PATH}", 1))
        .when(lang == "go", part(rf"\)\s*\(?\*?{PATH}[^()]*\)?$", 1)).when(lang.isin(*BEFORE), F.regexp_extract(inner, U + rf"^(?:\w+\s+)*?{PATH}[\s*&]+(?:\w+::)*~?[\w$]+\s*\(", 1))
    )
    add(is_function & (returns != ""), F.lit(""), "type", returns)
    # Declarations with a type.
    plain = ~is_function & ~F.coalesce(F.col("kind").isin(*rules.TYPES, "module", "file"), F.lit(False))
    behind = rf"^{DECLARES}#?{TARGET}[?!]?\s*:\s*{PATH}"
    add(plain & lang.isin(*BEHIND) & u.rlike(U + behind), part(behind, 1), "type", part(behind, 2))
    before = rf"^{DECLARES}(?!return\b|else\b|throw\b|delete\b|new\b|goto\b|using\b|package\b|case\b){PATH}(?:<.*?>)?[\s*&]+{TARGET}\s*(?:[=({{].*)?$"
    add(plain & lang.isin(*BEFORE) & u.rlike(U + before), part(before, 2), "type", part(before, 1))
    go = rf"^(?:var\s+)?([\w]+)\s+\*?{PATH}(?:\s*=.*)?$"
    add(plain & (lang == "go") & (u.rlike(r"^var\s") | F.col("in_type")) & u.rlike(U + go), part(go, 1), "type", part(go, 2))
    # Assignments of a call's result or of another variable.
    gets = rf"^{DECLARES}(?:{PATH.replace('(', '(?:', 1)}(?:<.*?>)?[\s*&]+)?#?{TARGET}[?!]?\s*(?::[^=]+)?:?=\s*"
    call = gets + rf"(?:await\s+|new\s+|try[?!]?\s+|[&*])*((?:self\.|this\.|this->)?{PATH[1:]}\s*(?:<[^<>()]*>)?\s*(?:\(|$)"
    copy = gets + rf"{TARGET};?$"
    opened = F.col("opens") & lang.isin("go", "rust")  # a literal of a struct
    is_call = u.rlike(U + call) & (opened | u.rlike(U + call.replace("(?:\\(|$)", "\\(")))
    add(plain & is_call, part(call, 1), "call", part(call, 2))
    add(plain & ~is_call & ~opened & u.rlike(U + copy), part(copy, 1), "copy", part(copy, 2))
    in_function = ~F.col("kept") & F.col("owner_kind").isin(*rules.FUNCTIONS)
    back = rf"^return\s+(?:await\s+|new\s+|[&*])*((?:self\.|this\.)?{PATH[1:]}\s*\("
    add(in_function & u.rlike(U + back), F.lit(""), "call", part(back, 1))
    add(in_function & u.rlike(U + rf"^return\s+{TARGET}$"), F.lit(""), "copy", part(rf"^return\s+{TARGET}$", 1))
    out = reduce(DataFrame.unionByName, rows).withColumns({"var": F.replace("var", F.lit("->"), F.lit(".")), "text": F.replace(F.replace("text", F.lit("->"), F.lit(".")), F.lit("::"), F.lit("."))})
    return out.filter("text <> ''").distinct()


def errors(s: DataFrame) -> DataFrame:
    """path, language, error of the files that could not be read."""
    return s.filter("error is not null").select("path", "language", "error")


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges (edge targets of references are "unresolved:" and a text)."""
    nodes, edges, _ = tables(files)
    return nodes, edges


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and what is said about variables (see variable_table)."""
    s = cut(statements(files))
    nodes = node_table(s)
    return nodes, edge_table(s, nodes), variable_table(s)
