"""Lookups, filters and induced subgraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import glob_regex


def filter_nodes(
    nodes: DataFrame, kinds: Sequence[str] = (), languages: Sequence[str] = (), globs: Sequence[str] = (), name_part: str = ""
) -> DataFrame:
    """Nodes of the kinds, languages and path patterns; an empty list is no filter."""
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(*kinds))
    if languages:
        nodes = nodes.filter(F.col("language").isin(*languages))
    if globs:
        nodes = nodes.filter(F.col("file_path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    if name_part:
        nodes = nodes.filter(F.lower("name").contains(name_part.lower()))
    return nodes


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def view_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a graph view shows: no file nodes, no containment."""
    return induced_edges(edges.filter("kind <> 'contains'"), nodes.filter("kind <> 'file'"))


def ghost_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*edges.columns)


def definitions(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Best node of each query (column q): qualified name 1.0, name 0.9, name in any case 0.8.

    Among equals the smallest id comes first.
    """
    q = queries.select("q").distinct()
    by = [("qualified_name", F.col("q"), 1.0), ("name", F.col("q"), 0.9), ("low", F.lower("q"), 0.8)]
    n = nodes.withColumn("low", F.lower("name"))
    hits = None
    for column, key, score in by:
        found = q.withColumn(column, key).join(n, column).select("q", "id", "kind", F.lit(score).alias("score"))
        hits = found if hits is None else hits.unionByName(found)
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return hits.withColumn("_n", first).filter("_n = 1").drop("_n")


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key, by order."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return last.select("r.*")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the ids of gone and what touches them."""
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    left = left.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the ids (column id), each once."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes of the files (column file_path)."""
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(*nodes.columns)


def files_referencing(deps: DataFrame, ids: DataFrame) -> DataFrame:
    """node_id, file_path: which files refer to the nodes (column id), from the table of dependencies."""
    return deps.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", "file_path").distinct()


def insert_deps(deps: DataFrame, rows: DataFrame) -> DataFrame:
    """deps with rows of the same columns; what is there already is ignored."""
    return deps.unionByName(rows.select(*deps.columns)).distinct()


def delete_outgoing(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges without those that go out from the nodes (column id)."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*edges.columns)


def with_defaults(nodes: DataFrame) -> DataFrame:
    """nodes with "" for a missing docstring or signature and "public" for a missing or empty visibility."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("docstring", "signature")}
    return nodes.withColumns(empty | {"visibility": F.coalesce(F.nullif(F.col("visibility"), F.lit("")), F.lit("public"))})


def neighbourhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """root, id: each node (column id) and those one edge away, in either direction."""
    roots = ids.select(F.col("id").alias("root")).distinct()
    ends = edges.select(F.col("source_id").alias("root"), F.col("target_id").alias("id"))
    both = ends.union(ends.select(F.col("id").alias("root"), F.col("root").alias("id")))
    return both.join(roots, "root", "left_semi").union(roots.select("root", F.col("root").alias("id"))).distinct()


def as_json(rows: DataFrame, kind: str) -> DataFrame:
    """item, json: a JSON object per row, keys in the order of the columns, nulls left out."""
    return rows.select(F.lit(kind).alias("item"), F.to_json(F.struct(*rows.columns)).alias("json"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """item, json for the nodes and the edges among them."""
    return as_json(nodes, "node").union(as_json(induced_edges(edges, nodes), "edge"))
