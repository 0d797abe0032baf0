"""Corpus pipeline over the documents table: each stage is one of the operators.

Defined results: null and empty texts are rejected by the quality rules, as are texts
under 50 words.  Of groups of near copies the row of the smallest id stays; rows that
occur twice are one.  Rows with a null id, a null source or null in any other column
pass through all stages.  An empty table gives an empty result of the same columns.
Extra columns pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import jaccard_join, quality_rules, secret_scan, sentencepiece_codec, source_mix
from symgraph.llm.common import cut, table, tuned, written
from symgraph.llm.queries import piece_model


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go too."""
    return quality_rules.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    tuned(spark)
    return jaccard_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced."""
    tuned(spark)
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in the order of the mixture."""
    tuned(spark)
    return source_mix.in_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, with the position in the mixture, in its order.

    The position is the place in the files that the stage before has written.
    """
    tuned(spark)
    placed = source_mix.stored_order(docs.select("doc_id", "text"), "position")
    encoded = sentencepiece_codec.encode(placed, piece_model(), keep=("position",))
    return cut(sentencepiece_codec.digests(encoded, keep=("position",))).orderBy("position")  # else sampling for the order encodes all texts too


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scan", secrets),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", encoding),
]
#: The segmentation of the last stage cannot be expressed in SQL; tests/llm compares
#: the whole pipeline with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
