"""Contexts of several sections in one text: entry points, related symbols or call chains, and code.

Every section keeps the first few rows of a query before its lines are gathered, so a
query's group is some dozens of lines.  Rows are ranked by pos within their query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.operators import graph, stats

#: How many rows a section takes, and how long its texts may be.
ENTRIES, RELATED, RANKED, SHOWN, CHAINS, CALLEES, LISTED = 5, 15, 10, 5, 3, 10, 5
SIGNATURE, DOCSTRING = 120, 100
#: What kinds and exported symbols gain among entry points.
EXPORTED_BONUS, FUNCTION_BONUS, TYPE_BONUS = 5.0, 3.0, 4.0


def lines(*parts: Column) -> Column:
    """Lines as an array, without those that are null."""
    return F.array_compact(F.array(*parts))


def text(value: str) -> Column:
    return F.lit(value)


def flag(column: str, words: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit(False)), words).otherwise("")


def limited(rows: DataFrame, most: int, *order: str | Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= most)


def section(rows: DataFrame, name: str, title: str, item: Column, order: str = "_n", closing: bool = True) -> DataFrame:
    """query, name: the title and the lines of all rows, in their order."""
    gathered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("l")))), lambda x: x["l"]))
    parts = [F.array(F.lit(title), F.lit("")), gathered, *([F.array(F.lit(""))] if closing else [])]
    return rows.groupBy("query").agg(F.concat(*parts).alias(name))


def signature(most: int = SIGNATURE) -> Column:
    return F.when(F.coalesce(F.length("signature"), F.lit(0)) > 0, F.concat(text("  `"), F.substring("signature", 1, most), text("`")))


def place() -> Column:
    return F.concat_ws(":", "file_path", "start_line")


def code_section(chosen: DataFrame) -> DataFrame:
    header = F.concat(text("#### "), "file_path", text(":"), F.concat_ws("-", "from_line", "to_line"), F.when(F.col("name") != "", F.concat(text(" ("), "name", text(")"))).otherwise(""))
    item = lines(header, text("```"), F.col("code"), text("```"), text(""))
    return section(chosen.withColumn("_n", F.col("pos")), "code_lines", "### Code", item, closing=False)


def together(queries: DataFrame, title: str, sections: list[DataFrame]) -> DataFrame:
    head = F.array(F.lit(title), F.lit(""), F.concat(F.lit("**Query:** "), F.col("query")), F.lit(""))
    out = reduce(lambda a, b: a.join(b, "query", "left"), sections, queries.select("query").distinct())
    none = F.array().cast("array<string>")
    names = [c for s in sections for c in s.columns if c != "query"]
    return out.select("query", F.array_join(F.concat(head, *(F.coalesce(F.col(c), none) for c in names)), "\n").alias("text"))


def structured(queries: DataFrame, entries: DataFrame, related: DataFrame, chosen: DataFrame) -> DataFrame:
    """query, text: entry points with their signatures, related symbols, and the chosen snippets.

    entries and related: query, pos and the columns of nodes; a symbol is related once a file.
    """
    seen = F.when(F.col("visibility") != "public", F.concat(text(" ("), "visibility", text(")"))).otherwise("")
    name = F.concat(text("- **"), "name", text("** ("), "kind", text(")"), seen, flag("is_async", " (async)"), flag("is_exported", " (exported)"), text(" - "), place())
    doc = F.when(F.coalesce(F.length("docstring"), F.lit(0)) > 0, F.concat(text("  "), F.substring("docstring", 1, DOCSTRING)))
    first = section(limited(entries, ENTRIES, "pos"), "entry_lines", "### Entry Points", lines(name, signature(), doc))
    near = limited(related, RELATED, "pos").dropDuplicates(["query", "file_path", "name", "_n"])
    once = F.row_number().over(Window.partitionBy("query", "file_path", "name").orderBy("_n"))
    near = near.withColumn("_once", once).filter("_once = 1")
    second = section(near, "related_lines", "### Related Symbols", lines(F.concat(text("- "), "file_path", text(": "), "name", text(" ("), "kind", text(")"))))
    return together(queries, "## Code Context", [first, second, code_section(chosen)])


def importance(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with their score raised by kind, export and the number of calls."""
    kind = F.when(F.col("kind").isin("function", "method"), FUNCTION_BONUS).when(F.col("kind").isin("class", "interface"), TYPE_BONUS).otherwise(0.0)
    own = F.when(F.coalesce(F.col("is_exported"), F.lit(False)), EXPORTED_BONUS).otherwise(0.0)
    calls = stats.out_degree_bonus(edges).withColumnRenamed("source_id", "id")
    return rows.join(calls, "id", "left").withColumn("score", F.col("score") + kind + own + F.coalesce("bonus", F.lit(0.0))).drop("bonus")


def linearised(queries: DataFrame, entries: DataFrame, chosen: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, text: entry points by importance, whom the first of them call, and the chosen snippets."""
    ranked = importance(limited(entries, RANKED, "pos").drop("_n"), edges)
    ranked = limited(ranked, SHOWN, F.desc("score"), "pos")
    tags = F.array_join(F.array_compact(F.array(F.when(F.col("is_exported"), "exported"), F.when(F.col("is_async"), "async"))), ", ")
    name = F.concat(text("- **"), "name", text("** ("), "kind", text(")"), F.when(tags != "", F.concat(text(" ["), tags, text("]"))).otherwise(""), text(" - "), place())
    first = section(ranked, "entry_lines", "### Entry Points (ranked)", lines(name, signature()))
    top = ranked.filter(F.col("_n") <= CHAINS).select("query", "_n", F.col("name").alias("_caller"), F.col("id").alias("source_id"))
    called = edges.filter("kind = 'calls'").join(top.select("source_id").distinct(), "source_id", "left_semi")
    called = called.withColumn("_k", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).filter(F.col("_k") <= CALLEES)
    called = called.select("source_id", "_k", F.col("target_id").alias("id")).join(nodes.select("id", "name", "file_path"), "id")
    called = called.withColumn("_m", F.row_number().over(Window.partitionBy("source_id").orderBy("_k"))).filter(F.col("_m") <= LISTED)
    listed = F.array_sort(F.collect_list(F.struct("_m", F.concat(text("  - "), "name", text(" ("), "file_path", text(")")).alias("l"))))
    chains = top.join(called, "source_id").groupBy("query", "_n", "_caller").agg(F.transform(listed, lambda x: x["l"]).alias("_to"))
    second = section(chains, "chain_lines", "### Call Chains", F.concat(F.array(F.concat(text("**"), "_caller", text("** ->"))), "_to", F.array(F.lit(""))), closing=False)
    # The title of the chains stands wherever there are entry points.
    titles = ranked.select("query").distinct().withColumn("_t", F.array(F.lit("### Call Chains"), F.lit("")))
    second = titles.join(second, "query", "left").select("query", F.coalesce("chain_lines", "_t").alias("chain_lines"))
    return together(queries, "## Graph Context", [first, second, code_section(chosen)])


def relationships(edges: DataFrame, ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """line: "a --[kind]--> b" for the relationships among the first nodes of a ranking (id, rank)."""
    found = graph.relationship_map(edges, ranked)
    names = nodes.select("id", "name")
    source = names.select(F.col("id").alias("source_id"), F.col("name").alias("a"))
    target = names.select(F.col("id").alias("target_id"), F.col("name").alias("b"))
    return found.join(source, "source_id").join(target, "target_id").select("source_id", "target_id", F.concat(text("  "), "a", text(" --["), "kind", text("]--> "), "b").alias("line"))
