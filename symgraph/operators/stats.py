"""Counts and summaries of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("kind") == "file", F.col("file_path"))).alias("files"))
    return n.withColumn("edges", edges.agg(F.count("*")).scalar())


def per_file(nodes: DataFrame) -> DataFrame:
    """file_path, n and a text like "class=3 function=5" without file nodes."""
    n = nodes.groupBy("file_path", "kind").agg(F.count("*").alias("n"))
    text = F.when(F.col("kind") != "file", F.concat_ws("=", "kind", "n"))
    return n.groupBy("file_path").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(text)), " ").alias("kinds"))


def out_degree_bonus(edges: DataFrame) -> DataFrame:
    """source_id, bonus: half a point per call, ten at most."""
    n = edges.filter("kind = 'calls'").groupBy("source_id").agg(F.count("*").alias("n"))
    return n.select("source_id", F.least(F.col("n") * 0.5, F.lit(10.0)).alias("bonus"))


def file_node_deps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_path, node_id: which nodes of other files a file refers to."""
    n = nodes.select("id", "file_path")
    e = edges.select("source_id", "target_id")
    e = e.join(n.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    e = e.join(n.select(F.col("id").alias("target_id"), F.col("file_path").alias("other")), "target_id")
    return e.filter("file_path <> other").select("file_path", F.col("target_id").alias("node_id")).distinct()


def retrieval(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, recall, reciprocal_rank of ranked (query, id, rank from 1) against wanted (query, id).

    A query of which nothing is found has 0 for both; averages over rows are mean recall and MRR.
    """
    w = wanted.select("query", "id").distinct()
    hits = w.join(ranked.groupBy("query", "id").agg(F.min("rank").alias("rank")), ["query", "id"], "left")
    out = hits.groupBy("query").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    return out.select("query", (F.col("found") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
