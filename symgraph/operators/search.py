"""Ranked keyword search: BM25 over prefixes, then substrings, then edit distance.

A query's terms are known to the driver; everything about the nodes is column
expressions over one scan with its counts, or over the rows that a stored index has of
the query's tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions.text import terms, tokens
from symgraph.schema import EXPORTED_BONUS, KIND_BONUS, PRIVATE_BONUS, SEARCH_WEIGHTS
from symgraph.sources.shared import cut, kept

K1, B = 1.2, 0.75
#: Fixed value: what a term in more than half of the rows weighs.
LEAST_IDF = 1e-6


def bm25(rows: DataFrame, prefixes: Sequence[str], weights: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """The rows (all columns, or those to keep) with a token that begins with one of the prefixes, with their score.

    Weights are by column; a column of weight 0 still counts for lengths and for
    which rows match.  A prefix in more than half of the rows hardly counts.  Rows are
    tokenised once: one pass keeps those that match and counts over all.
    """
    d = rows.withColumns({f"_t{i}": tokens(F.col(c)) for i, c in enumerate(weights)})

    def hits(i: int, p: str) -> Column:
        return F.size(F.filter(f"_t{i}", lambda t: t.startswith(p)))

    tf = {f"_f{j}": reduce(add, [hits(i, p) * w for i, w in enumerate(weights.values())]) for j, p in enumerate(prefixes)}
    any_ = {f"_h{j}": reduce(add, [hits(i, p) for i in range(len(weights))]) > 0 for j, p in enumerate(prefixes)}
    size = reduce(add, [F.size(f"_t{i}") for i in range(len(weights))])
    d = d.withColumns(tf | any_ | {"_size": size}).drop(*[f"_t{i}" for i in range(len(weights))])
    counts = Observation()
    d = d.observe(counts, F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size"), *[F.count_if(f"_h{j}").alias(f"df{j}") for j in range(len(prefixes))])
    columns = list(keep or rows.columns)
    found = d.filter(reduce(lambda a, b: a | b, [F.col(f"_h{j}") for j in range(len(prefixes))]))
    found = cut(found.select(*columns, "_size", *tf))
    got = counts.get
    n, mean = got["n"], (got["size"] or 0) / max(1, got["n"])
    parts = [F.when(F.col(f"_f{j}") > 0, F.lit(idf(n, got[f"df{j}"])) * saturated(F.col(f"_f{j}"), F.col("_size"), mean)).otherwise(0.0) for j in range(len(prefixes))]
    return found.withColumn("score", reduce(add, parts)).select(*columns, "score")


def idf(n: int, df: int) -> float:
    """Weight of a term that df of n rows have."""
    value = log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else LEAST_IDF


def saturated(tf: Column, size: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean or 1.0)))


def like_score(query: str) -> Column:
    q, name, qualified = query.lower(), F.lower("name"), F.lower("qualified_name")
    return F.when(name == q, 1.0).when(name.startswith(q), 0.9).when(qualified.contains(q), 0.7).otherwise(0.5)


def like_tier(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name holds the query or whose qualified name begins with it."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("qualified_name").startswith(q)
    return nodes.filter(hit).withColumn("score", like_score(query))


def fuzzy_tier(nodes: DataFrame, query: str, names: int = 50, per_name: int = 5) -> DataFrame:
    """Nodes whose name is one edit (two, for queries of over four letters) from the query."""
    q = query.lower()
    most = 1 if len(q) <= 4 else 2
    d = F.levenshtein(F.lower("name"), F.lit(q), most)
    close = nodes.filter(F.abs(F.length("name") - len(q)) <= most).withColumn("distance", d).filter("distance >= 0")
    best = close.select("name", "distance").distinct().orderBy("distance", "name").limit(names)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    kept = close.join(best.select("name"), "name", "left_semi").withColumn("_n", rank).filter(F.col("_n") <= per_name)
    return kept.withColumn("score", 1 / (1 + F.col("distance"))).drop("_n")


def bonus(query: str) -> Column:
    """Bonus by kind, visibility and how the name fits the whole query."""
    q, name = query.strip().lower(), F.lower("name")
    kinds = F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])
    kind = F.coalesce(kinds[F.col("kind")], F.lit(0))
    seen = F.when(F.coalesce(F.col("is_exported"), F.lit(False)), EXPORTED_BONUS).when(F.col("visibility") == "private", PRIVATE_BONUS).otherwise(0)
    begins = F.bround(10 + F.lit(30.0 * len(q)) / F.length("name"))
    fits = F.when(name == q, 80).when(name.startswith(q), begins).when(name.contains(q), 10).otherwise(0)
    return kind + seen + fits


RANKED = ("id", "kind", "name", "qualified_name", "visibility", "is_exported")


def search(nodes: DataFrame, query: str, limit: int = 10, index: Postings | None = None) -> DataFrame:
    """id, tier, score, rank of the best nodes.

    A tier only counts while the ones before have found fewer than limit nodes; each
    is a top-k report of some hundred rows at most.  With an index the first tier reads
    the rows of the query's tokens instead of all nodes.
    """
    spark = nodes.sparkSession
    found = spark.range(1).select(terms(F.lit(query))).first()[0]
    if not found:
        return nodes.select("id", F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    nodes = nodes if "is_exported" in nodes.columns else nodes.withColumn("is_exported", F.lit(False))
    most = max(5 * limit, 100)
    if index:
        top = index.bm25(found).orderBy(F.desc(F.round("score", 9)), "id").limit(most).collect()
        hits = spark.createDataFrame([(r["id"], r["score"]) for r in top], "id string, score double")
        first = nodes.join(F.broadcast(hits), "id")
    else:
        first = bm25(nodes, found, SEARCH_WEIGHTS, RANKED).orderBy(F.desc(F.round("score", 9)), "id").limit(most)

    def report(tier: DataFrame, nth: int) -> list[tuple[str, int, float]]:
        return [(r["id"], nth, r["score"]) for r in tier.select("id", (F.col("score") + bonus(query)).alias("score")).collect()]

    tiers = report(first, 1)
    others = lambda: nodes.filter(~F.col("id").isin([t[0] for t in tiers])) if tiers else nodes
    if len(tiers) < limit:
        tiers += report(like_tier(others(), query).orderBy(F.desc("score"), F.length("name"), "id").limit(3 * limit), 2)
    if len(tiers) < limit and len(query) >= 3:
        seen = [t[0] for t in tiers]
        close = fuzzy_tier(nodes, query, max(2 * limit, 50))
        tiers += report(close.filter(~F.col("id").isin(seen)) if seen else close, 3)
    best = sorted(tiers, key=lambda t: (-round(t[2], 9), t[1], t[0]))[:limit]
    return spark.createDataFrame([(*t, i + 1) for i, t in enumerate(best)], "id string, tier int, score double, rank int")


def postings(rows: DataFrame, weights: dict[str, float], id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """token, id, tf (weighted), size (tokens of the row) and the columns to keep: the inverted index of the columns."""
    d = tokenised(rows, weights, id_col, keep).select(id_col, *keep, "size", F.explode("_t").alias("_x")).select(id_col, *keep, "size", "_x.token", "_x.w")
    return d.groupBy("token", id_col, "size", *keep).agg(F.sum("w").alias("tf"))


def tokenised(rows: DataFrame, weights: dict[str, float], id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns to keep, size and _t (token, w): rows move once, before they become many postings."""
    rows = rows.repartition(id_col)
    d = rows.select(id_col, *keep, F.concat(*(weighted(c, w) for c, w in weights.items())).alias("_t"))
    return d.withColumn("size", F.size("_t"))


def weighted(column: str, weight: float) -> Column:
    return F.transform(tokens(F.col(column)), lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("w")))


class Postings:
    """A stored inverted index: rows sorted by token, so that a prefix reads the row groups that hold it.

    Tokens are ranges of files, and a token that many rows have is cut by ids too.  The
    number of rows and of tokens is stored beside them, so a query reads nothing else.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.parquet(f"{path}/postings")
        stats = spark.read.parquet(f"{path}/stats").first()
        self.n, self.mean = stats["n"], (stats["size"] or 0) / max(1, stats["n"])

    @staticmethod
    def write(rows: DataFrame, path: str, weights: dict[str, float], id_col: str = "id", keep: Sequence[str] = ()) -> None:
        found = postings(rows, weights, id_col, keep).withColumnRenamed(id_col, "id")
        found.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        size = reduce(add, [F.size(tokens(F.col(c))) for c in weights])
        rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).write.mode("overwrite").parquet(f"{path}/stats")

    def bm25(self, prefixes: Sequence[str]) -> DataFrame:
        """id, score of the rows with a token that begins with one of the prefixes."""
        begins = reduce(lambda a, b: a | b, [F.col("token").startswith(p) for p in prefixes])
        which = F.filter(F.array(*[F.when(F.col("token").startswith(p), F.lit(p)) for p in prefixes]), lambda x: x.isNotNull())
        hit = self.table.filter(begins).select("id", "size", "tf", F.explode(which).alias("prefix")).groupBy("id", "size", "prefix").agg(F.sum("tf").alias("tf"))
        df = hit.groupBy("prefix").agg(F.count("*").alias("df"))  # as many rows as the query has prefixes
        value = F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        value = F.when(value > 0, value).otherwise(LEAST_IDF)
        part = F.when(F.col("tf") > 0, value * saturated(F.col("tf"), F.col("size"), self.mean)).otherwise(0.0)
        return hit.join(F.broadcast(df), "prefix").groupBy("id").agg(F.sum(part).alias("score"))


def bm25_batch(rows: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 10, id_col: str = "id") -> DataFrame:
    """q, id, score, rank: the k best rows for each of many queries (q, term).

    Rows are tokenised once and move once.  Each token of a row meets the terms by all of
    its beginnings, where it lies as long as the terms are few enough to be sent to it,
    and only what it meets is stored.  A term of many rows and queries gives a score to
    each pair of them: these are added up by row, and only the k best of each part move on.
    """
    counts = Observation()
    d = tokenised(rows, weights, id_col).observe(counts, F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    words = kept(queries.select("term").distinct().filter("term <> ''").withColumn("word", F.monotonically_increasing_id()))
    longest = words.agg(F.max(F.length("term"))).first()[0] or 0
    d = d.select(id_col, "size", F.explode("_t").alias("_x")).select(id_col, "size", "_x.token", "_x.w")
    post = d.groupBy("token", id_col, "size").agg(F.sum("w").alias("tf"))
    begins = post.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(max(1, longest))))))
    hit = begins.withColumn("term", F.expr("substring(token, 1, _n)")).join(words, "term")
    hit = kept(hit.groupBy("word", id_col, "size").agg(F.sum("tf").alias("tf")))
    got = counts.get
    n, mean = got["n"], (got["size"] or 0) / max(1, got["n"])
    df = hit.groupBy("word").agg(F.count("*").alias("df"))
    value = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(value > 0, value).otherwise(LEAST_IDF) * saturated(F.col("tf"), F.col("size"), mean)
    scored = hit.join(df, "word").select("word", id_col, part.alias("part")).repartition(id_col)
    asked = kept(queries.join(words, "term").select("q", "word"))
    per = asked.join(scored, "word").groupBy("q", id_col).agg(F.sum("part").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), id_col))
    return per.withColumn("rank", rank).filter(F.col("rank") <= k)
