"""Import statements bound to nodes: a row for each imported name, joined with the nodes of the files it may mean."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand behind the module path of an import, first match first.
PYTHON_ENDS = (".py", "/__init__.py")
TYPESCRIPT_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx")
#: The name that stands for the whole module.
MODULE = "*"

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
FROM = r"(?Us)^\s*from\s+(\.*[\w.]*)\s*import\b\s*(.*)$"
PLAIN = r"(?Us)^\s*import\s+(.*)$"
SCRIPT = r"(?Us)^\s*import\s+(?:type\s+)?(.*?)\bfrom\s*['\"]([^'\"]+)['\"]"


def named(item: Column) -> Column:
    """(name, alias) of "a" or "a as b"."""
    parts = F.split(F.trim(item), r"\s+as\s+")
    return F.struct(F.trim(parts[0]).alias("name"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0])).alias("alias"))


def clauses(language: Column, text: Column) -> Column:
    """(module, name, alias) for each name that a statement imports; the name is MODULE for a whole module."""
    triple = lambda module, name, alias: F.struct(module.alias("module"), name.alias("name"), alias.alias("alias"))
    items = lambda s: F.filter(F.split(F.regexp_replace(s, r"#[^\n]*|[(){}\\]|\s", " "), ","), lambda x: F.trim(x) != "")
    whole = F.lit(MODULE)
    # from m import a as b, c
    module = F.regexp_extract(text, FROM, 1)
    of_from = F.transform(items(F.regexp_extract(text, FROM, 2)), lambda x: triple(module, named(x)["name"], named(x)["alias"]))
    # import a.b as c, d: without an alias the first part is bound
    of_plain = F.transform(
        items(F.regexp_extract(text, PLAIN, 1)),
        lambda x: triple(named(x)["name"], whole, F.when(named(x)["name"] == named(x)["alias"], F.substring_index(named(x)["name"], ".", 1)).otherwise(named(x)["alias"])),
    )
    # import d, { a as b }, * as n from "m"
    path = F.regexp_extract(text, SCRIPT, 2)
    of_script = F.transform(
        items(F.regexp_replace(F.regexp_extract(text, SCRIPT, 1), r"\btype\s+", "")),
        lambda x: triple(path, F.when(named(x)["name"].isin("*", "default"), whole).otherwise(named(x)["name"]), named(x)["alias"]),
    )
    script = language.isin("typescript", "javascript")
    return F.when((language == "python") & text.rlike(FROM), of_from).when((language == "python") & text.rlike(PLAIN), of_plain).when(script & (path != ""), of_script)


def plain(path: Column) -> Column:
    """The path without a scheme."""
    return F.regexp_replace(path, SCHEME, "")


def normal_path(path: Column) -> Column:
    """The path without "." and ".." steps."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    lead = F.when(path.startswith("/"), "/").otherwise("")
    return F.concat(lead, F.array_join(F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def names(imports: DataFrame) -> DataFrame:
    """id, language, source_file, module, name, alias: what each import (id, language, text, source_file) binds."""
    return imports.select("id", "language", "source_file", F.explode(clauses(F.col("language"), F.col("text"))).alias("c")).select("id", "language", "source_file", "c.*")


def candidates(bound: DataFrame, root: str) -> DataFrame:
    """The rows of names() with nth and file_path: the files that the module may be."""
    root = re.sub(SCHEME, "", root).rstrip("/")
    folder = F.regexp_replace(plain(F.col("source_file")), r"/[^/]*$", "")
    # One dot is the file's own folder, each more the one above.
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(folder, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)).cast("int")))
    python = normal_path(F.concat_ws("/", F.when(dots > 0, up).otherwise(F.lit(root)), F.nullif(rest, F.lit(""))))
    # A name may be a module of the package.
    inner = F.when(F.col("name") != MODULE, F.concat_ws("/", python, "name"))
    of_python = F.concat(F.array(*(F.concat(inner, F.lit(x)) for x in PYTHON_ENDS)), F.array(*(F.concat(python, F.lit(x)) for x in PYTHON_ENDS)))
    base = F.when(F.col("module").startswith("."), F.concat_ws("/", folder, "module")).otherwise(F.concat(F.lit(root + "/"), F.col("module")))
    of_script = F.array(*(F.concat(normal_path(base), F.lit(x)) for x in TYPESCRIPT_ENDS))
    files = F.when(F.col("language") == "python", of_python).when(F.col("language").isin("typescript", "javascript"), of_script)
    return bound.select("*", F.posexplode(files).alias("nth", "file_path")).filter("file_path is not null")


def bindings(imports: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """id, source_file, name, alias, target_id: the node of each imported name.

    It is the name's node in the first file that exists, else, for whole modules and
    names without a node, the file's.  Nodes are joined by file, and by file and name,
    so a hot file meets each import once.
    """
    wanted = candidates(names(imports), root)
    outer = nodes.filter("kind <> 'import'").withColumn("file_path", plain(F.col("file_path")))
    named_ = outer.filter("kind <> 'file'").groupBy("file_path", "name").agg(F.min("id").alias("target_id"))
    files = outer.filter("kind = 'file'").groupBy("file_path").agg(F.min("id").alias("target_id"))
    columns = ["id", "source_file", "module", "name", "alias", "nth"]
    hits = [
        wanted.join(named_, ["file_path", "name"]).select(*columns, F.lit(0).alias("way"), "target_id"),
        wanted.join(files, "file_path").select(*columns, F.lit(1).alias("way"), "target_id"),
    ]
    best = reduce(DataFrame.unionByName, hits)
    # A module of that name comes before a name in the package's file, as its file comes first.
    first = F.row_number().over(Window.partitionBy("id", "module", "name", "alias").orderBy("nth", "way", "target_id"))
    return best.withColumn("_n", first).filter("_n = 1").select("id", "source_file", "name", "alias", "target_id")


def resolve(imports: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """id, target_id: what each import statement binds, a row a node."""
    return bindings(imports, nodes, root).select("id", "target_id").distinct()
