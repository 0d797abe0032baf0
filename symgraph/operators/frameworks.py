"""Rules of frameworks for references that name no symbol: a registry of column functions.

A rule turns a reference's text into the text of another symbol, or into the path of a
file below the root; where it does not apply it gives null.  register() adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]
SYMBOLS: dict[str, Rule] = {}
FILES: dict[str, Rule] = {}


def register(name: str, symbol: Rule | None = None, file: Rule | None = None) -> None:
    """Adds a rule that gives a symbol's text, or one that gives a file's path below the root."""
    if symbol:
        SYMBOLS[name] = symbol
    if file:
        FILES[name] = file


def matched(text: Column, pattern: str, then: Callable[[Column], Column] = lambda c: c) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", then(found))


#: What the two frameworks write.
register("fastapi", symbol=lambda text: matched(text, r"^Depends\(\s*(.*?)\s*\)$"))
register("django", file=lambda text: matched(text, r"^(\w+)\.\w", lambda app: F.concat(app, F.lit("/models.py"))))


def resolve(refs: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """edge_id, target_id, framework of the references (edge_id, text) that a rule leads to a node.

    Rules are tried by name; a symbol is found by qualified name or name, its first node;
    of a file the node of the text's last name counts, else the file's own.
    """
    named = nodes.filter("kind NOT IN ('file', 'import')")
    by_name = named.groupBy(F.col("name").alias("to")).agg(F.min("id").alias("target_id"))
    by_full = named.groupBy(F.col("qualified_name").alias("to")).agg(F.min("id").alias("target_id"))
    in_file = named.groupBy("file_path", "name").agg(F.min("id").alias("target_id"))
    files = nodes.filter("kind = 'file'").groupBy("file_path").agg(F.min("id").alias("target_id"))
    rules = [(n, r, True) for n, r in SYMBOLS.items()] + [(n, r, False) for n, r in FILES.items()]
    each = F.array_compact(F.array(*(F.when(r(F.col("text")).isNotNull(), F.struct(F.lit(n).alias("framework"), r(F.col("text")).alias("to"), F.lit(s).alias("symbol"))) for n, r, s in rules)))
    d = refs.select("edge_id", "text", F.explode(each).alias("x")).select("edge_id", "text", "x.*")
    symbols, paths = d.filter("symbol"), d.filter("NOT symbol").withColumns({"file_path": F.concat(F.lit(root.rstrip("/") + "/"), F.col("to")), "name": F.substring_index("text", ".", -1)})
    pick = lambda rows, way: rows.select("edge_id", "framework", F.lit(way).alias("way"), "target_id")
    hits = pick(symbols.join(by_full, "to"), 0).unionByName(pick(symbols.join(by_name, "to"), 1))
    hits = hits.unionByName(pick(paths.join(in_file, ["file_path", "name"]), 0)).unionByName(pick(paths.join(files, "file_path"), 1))
    first = F.row_number().over(Window.partitionBy("edge_id").orderBy("framework", "way", "target_id"))
    return hits.withColumn("_n", first).filter("_n = 1").select("edge_id", "target_id", "framework")
