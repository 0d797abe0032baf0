"""Resolution of textual references to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (edge_id, source_id, text) with target_id and how it was found.

    A text that is a qualified name wins (the last node of that name); else nodes
    of that name, preferring the source's file, then its language, then the first.
    The first node of each name, of each name and language, and so on is found before
    references meet nodes, so every join adds one row at most to a reference, however
    many nodes share the name.
    """
    n = nodes.select("id", "name", "qualified_name", "file_path", "language")
    full = n.groupBy("qualified_name").agg(F.max("id").alias("full_id")).withColumnRenamed("qualified_name", "text")
    here = n.select(F.col("id").alias("source_id"), "file_path", "language")
    out = refs.select("edge_id", "source_id", "text").join(full, "text", "left").join(here, "source_id", "left")
    named = n.withColumnRenamed("name", "text")
    levels = (["text", "file_path", "language"], ["text", "file_path"], ["text", "language"], ["text"])
    for i, keys in enumerate(levels):
        first = named.groupBy(*keys).agg(F.min("id").alias(f"id_{i}"), F.count("*").alias(f"n_{i}"))
        out = out.join(first, keys, "left")
    n_named = F.col(f"n_{len(levels) - 1}")
    how = F.when(F.col("full_id").isNotNull(), "qualified").when(n_named == 1, "name").when(n_named > 1, "chosen").otherwise("unresolved")
    target = F.coalesce("full_id", *(f"id_{i}" for i in range(len(levels))))
    return out.select("edge_id", "source_id", "text", target.alias("target_id"), how.alias("how"))


def infer_call_types(calls: DataFrame, typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (edge_id, receiver, method) resolved over the receivers' types (receiver, type).

    The method must be one of the type: its qualified name begins with the type's
    name and a dot.  Several methods are listed as ambiguous.
    """
    n = nodes.select(F.col("name").alias("method"), "qualified_name", "id")
    hit = calls.join(typed, "receiver").join(n, "method").filter(F.col("qualified_name").startswith(F.concat("type", F.lit("."))))
    return hit.groupBy("edge_id").agg(F.min("id").alias("resolved_target"), F.count_distinct("id").alias("n_candidates"))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "file_path") -> DataFrame:
    """rows after a batch of changes: changed and deleted keys go, new rows come.

    changes has the columns of rows, and op ("upsert" or "delete").
    """
    left = rows.join(changes.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return left.unionByName(changes.filter("op = 'upsert'").select(*rows.columns))
