"""Building, storing and updating a symbol graph, and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions.text import short_id
from symgraph.operators import context, graph, imports, lookup, outline, resolve, search, stats, typing
from symgraph.schema import EDGE_KINDS
from symgraph.sources import code
from symgraph.sources.shared import cut


def resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the targets of textual references bound where a node fits."""
    loose = edges.filter(F.col("target_id").startswith("unresolved:")).select(F.col("id").alias("edge_id"), "source_id", F.col("target_text").alias("text"))
    found = resolve.resolve(loose, nodes).filter("target_id is not null").select(F.col("edge_id").alias("id"), F.col("target_id").alias("_to"))
    out = edges.join(found, "id", "left")
    return out.withColumns({"confidence": F.when(F.col("_to").isNotNull(), 1.0).otherwise(F.col("confidence")), "target_id": F.coalesce("_to", "target_id")}).drop("_to")


def imported(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """file_id, edge_id, line, name, alias, target_id: the node of each name that a file imports."""
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("file_id"), "file_path")
    n = nodes.select(F.col("id").alias("source_id"), "file_path", "language")
    statements = edges.filter("kind = 'imports'").select("id", "source_id", "target_text").join(n, "source_id").select(F.col("id"), "language", F.col("target_text").alias("text"), F.col("file_path").alias("source_file"))
    bound = imports.bindings(statements, nodes, root).withColumnRenamed("source_file", "file_path").join(files, "file_path")
    return bound.join(edges.select("id", "line"), "id").select("file_id", F.col("id").alias("edge_id"), "line", "name", "alias", "target_id")


def import_edges(bound: DataFrame) -> DataFrame:
    """An edge from a file to each node that it imports."""
    e = bound.select(F.col("file_id").alias("source_id"), "target_id", F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"), "line", F.col("name").alias("target_text"))
    e = e.withColumn("id", short_id(F.col("source_id"), F.col("target_id"), F.col("kind")))
    columns = ["source_id", "target_id", "kind", "confidence", "line", "target_text"]
    return e.groupBy("id").agg(F.max_by(F.struct(*columns), "line").alias("e")).select("id", "e.*")


def typed(nodes: DataFrame, edges: DataFrame, variables: DataFrame, bound: DataFrame) -> DataFrame:
    """edges with resolved_target and type_context of calls whose receivers' types are known.

    A call that no name has bound gets the method as its target if there is only one.
    """
    parents = nodes.filter(F.col("kind").isin(*typing.TYPE_KINDS)).select(F.col("id").alias("parent_id"), F.col("id").alias("holder"))
    files = nodes.filter("kind = 'file'").select("file_path", F.col("id").alias("file_id"))
    place = nodes.select(F.col("id").alias("scope"), "file_path", "language", "parent_id").join(parents, "parent_id", "left").join(files, "file_path").select("scope", "holder", "file_id", "language")
    text = F.replace(F.replace("target_text", F.lit("->"), F.lit(".")), F.lit("::"), F.lit("."))
    calls = edges.filter("kind = 'calls'").select(F.col("id").alias("edge_id"), F.col("source_id").alias("scope"), text.alias("text")).join(place, "scope")
    found = typing.contexts(typing.infer(variables, calls, nodes, edges, bound), nodes)
    out = edges.join(found.select(F.col("edge_id").alias("id"), "resolved_target", "type_context", F.col("target_id").alias("_to")), "id", "left")
    take = F.col("_to").isNotNull() & F.col("target_id").startswith("unresolved:")
    return out.withColumns({
        "target_id": F.when(take, F.col("_to")).otherwise(F.col("target_id")), "confidence": F.when(take, 1.0).otherwise(F.col("confidence")),
        "resolved_target": F.coalesce("resolved_target", F.lit("")), "type_context": F.coalesce("type_context", F.lit("")),
    }).drop("_to")


def by_import(nodes: DataFrame, edges: DataFrame, bound: DataFrame) -> DataFrame:
    """edges whose text is a name that the file imports, or an alias, bound to the imported node."""
    files = nodes.filter("kind = 'file'").select("file_path", F.col("id").alias("file_id"))
    source = nodes.select(F.col("id").alias("source_id"), "file_path").join(files, "file_path").select("source_id", "file_id")
    names = bound.groupBy("file_id", F.col("alias").alias("target_text")).agg(F.min("target_id").alias("_to"))
    named = edges.filter(F.col("kind").isin("calls", "instantiates", "extends", "implements", "references", "reads"))
    found = named.select("id", "source_id", "target_text").join(source, "source_id").join(names, ["file_id", "target_text"]).select("id", "_to")
    out = edges.join(found, "id", "left")
    return out.withColumns({"confidence": F.when(F.col("_to").isNotNull(), 1.0).otherwise(F.col("confidence")), "target_id": F.coalesce("_to", "target_id")}).drop("_to")


#: Folders of a stored graph by the hash of their rows' file, so that a change rewrites the folders of its files only.
BUCKETS = 64


def bucketed(rows: DataFrame, column: str = "file_path") -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int"))


def store(rows: DataFrame, path: str, column: str = "file_path") -> None:
    bucketed(rows, column).write.mode("overwrite").partitionBy("bucket").parquet(path)


def with_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the file of their source."""
    return edges.join(nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id")


def named_edges(nodes: DataFrame, edges: DataFrame, bound: DataFrame) -> DataFrame:
    """edges bound by names and imports."""
    return by_import(nodes, resolved(nodes, edges), bound).select(*edges.columns)


def all_edges(nodes: DataFrame, named: DataFrame, variables: DataFrame, bound: DataFrame) -> DataFrame:
    """Edges bound by names, with those of imports, and the receivers of calls by their types."""
    more = with_file(import_edges(bound), nodes)
    return typed(nodes, cut(named.select(*more.columns).unionByName(more)), variables, bound)


def build(spark: SparkSession, root: str, out: str) -> None:
    """Writes the graph of the source tree under root as Parquet: nodes, edges, file dependencies, files, and what updates need."""
    files = code.discover(spark, root)
    nodes, edges, variables = code.tables(files)
    store(nodes, f"{out}/nodes")
    nodes = spark.read.parquet(f"{out}/nodes").drop("bucket")
    raw = cut(with_file(edges, nodes))
    variables = cut(variables)
    bound = cut(imported(nodes, raw, code.plain_path(root)))
    named = cut(named_edges(nodes, raw, bound))
    for name, table, column in (("raw", raw, "file_path"), ("named", named, "file_path"), ("variables", variables, "file_id"), ("bound", bound, "file_id")):
        store(table, f"{out}/{name}", column)
    store(all_edges(nodes, named, variables, bound), f"{out}/edges")
    edges = spark.read.parquet(f"{out}/edges")
    stats.file_node_deps(edges, nodes).write.mode("overwrite").parquet(f"{out}/file_node_deps")
    store(files.select(F.col("path").alias("file_path"), F.split("text", r"\r?\n").alias("lines")), f"{out}/files")


def replaced(spark: SparkSession, path: str, new: DataFrame, old: DataFrame, column: str = "file_path") -> None:
    """Writes the rows of new into the folders in which they differ from old."""
    every = new.columns
    sides = bucketed(new, column).withColumn("_side", F.lit(1)).unionByName(bucketed(old.select(*every), column).withColumn("_side", F.lit(-1)))
    differs = sides.groupBy("bucket", F.xxhash64(*every).alias("_h")).agg(F.sum("_side").alias("n")).filter("n <> 0").select("bucket").distinct()
    touched = [r["bucket"] for r in differs.collect()]  # BUCKETS at most
    rows = cut(bucketed(new, column).filter(F.col("bucket").isin(touched)))
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if gone := [b for b in touched if b not in left]:  # a folder without rows is no part of the rows that were written
        empty(spark, path, gone)


def empty(spark: SparkSession, path: str, buckets: list[int]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for b in buckets:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(conf).delete(folder, True)


def update(spark: SparkSession, out: str, root: str, changes: DataFrame) -> None:
    """Applies a batch of changes (path, op, content, ts) to a stored graph; paths are as in its files.

    Changed files are extracted anew.  References are resolved again if they are in a
    changed file, if a changed file has or had a node of that name, or if what the file
    imports by that name is another node now; all others keep their targets.  Types of
    receivers are inferred over the whole graph, since they flow through it.  Only
    folders whose rows changed are written; a batch that is run again changes nothing.
    """
    last = changes.groupBy("path").agg(F.max_by(F.struct("op", "content"), "ts").alias("c")).select(F.col("path").alias("file_path"), "c.*")
    last = cut(last)
    if last.isEmpty():
        return
    changed = last.select("file_path")
    old = {t: spark.read.parquet(f"{out}/{t}").drop("bucket") for t in ("nodes", "raw", "named", "variables", "bound", "edges", "files")}
    come = last.filter("op <> 'delete'").select(F.col("file_path").alias("path"), "content").withColumn("language", code.language())
    files = cut(come.filter("language <> 'unknown'").select("path", "language", F.coalesce("content", F.lit("")).alias("text")))
    nodes_, edges_, variables_ = code.tables(files)
    nodes_ = cut(nodes_)
    raw_ = cut(with_file(edges_, nodes_))

    gone = old["nodes"].join(changed, "file_path", "left_semi")
    nodes = cut(old["nodes"].join(changed, "file_path", "left_anti").select(*nodes_.columns).unionByName(nodes_))
    raw = cut(old["raw"].join(changed, "file_path", "left_anti").select(*raw_.columns).unionByName(raw_))
    old_files = gone.filter("kind = 'file'").select(F.col("id").alias("file_id"))
    variables = cut(old["variables"].join(old_files, "file_id", "left_anti").select(*variables_.columns).unionByName(variables_))

    bound = cut(imported(nodes, raw, code.plain_path(root)))
    keys = ["file_id", "alias", "target_id"]
    moved = old["bound"].select(*keys).exceptAll(bound.select(*keys)).unionByName(bound.select(*keys).exceptAll(old["bound"].select(*keys)))
    moved = moved.join(nodes.filter("kind = 'file'").select(F.col("id").alias("file_id"), "file_path"), "file_id").select("file_path", F.col("alias").alias("target_text")).distinct()
    names = gone.select("name", "qualified_name").unionByName(nodes_.select("name", "qualified_name"))
    names = names.select(F.explode(F.array("name", "qualified_name")).alias("target_text")).distinct()
    by_name = raw.join(names, "target_text", "left_semi").unionByName(raw.join(moved, ["file_path", "target_text"], "left_semi").select(*raw.columns)).unionByName(raw_)
    again = cut(by_name.select(*raw.columns).dropDuplicates(["id"]))
    kept = old["named"].join(changed, "file_path", "left_anti").join(again.select("id"), "id", "left_anti").select(*raw.columns)
    named = cut(kept.unionByName(named_edges(nodes, again, bound)))
    edges = cut(all_edges(nodes, named, variables, bound))
    lines = files.select(F.col("path").alias("file_path"), F.split("text", r"\r?\n").alias("lines"))
    lines = cut(old["files"].join(changed, "file_path", "left_anti").select("file_path", "lines").unionByName(lines))
    for name, table, column in (
        ("nodes", nodes, "file_path"), ("raw", raw, "file_path"), ("named", named, "file_path"), ("variables", variables, "file_id"), ("bound", bound, "file_id"),
        ("edges", edges, "file_path"), ("files", lines, "file_path"),
    ):
        replaced(spark, f"{out}/{name}", table, old[name], column)
    stats.file_node_deps(edges, nodes).write.mode("overwrite").parquet(f"{out}/file_node_deps")


class Index:
    """A stored graph: each question is a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.nodes, self.edges, self.files = (spark.read.parquet(f"{path}/{t}").drop("bucket") for t in ("nodes", "edges", "files"))
        self.edges = self.edges.filter(F.col("kind").isin(*EDGE_KINDS))  # rows of other kinds are passed over

    def views(self) -> None:
        """Temporary views nodes, edges and files for SQL."""
        for name in ("nodes", "edges", "files"):
            getattr(self, name).createOrReplaceTempView(name)

    def find(self, symbol: str) -> DataFrame:
        return lookup.definitions(self.nodes, self.spark.createDataFrame([(symbol,)], "q string")).select("id")

    def callers(self, symbol: str) -> DataFrame:
        return graph.callers(self.edges, self.nodes, self.find(symbol))

    def callees(self, symbol: str, limit: int | None = None) -> DataFrame:
        return graph.callees(self.edges, self.nodes, self.find(symbol), limit=limit)

    def impact(self, symbol: str, depth: int = 5) -> DataFrame:
        return graph.impact(self.edges, self.nodes, self.find(symbol), depth)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        found = search.search(self.nodes, query, limit)
        return found.join(self.nodes, "id").orderBy("rank")

    def ranked(self, query: str) -> DataFrame:
        """query, pos and the nodes that a search finds, then their neighbours, best first."""
        seeds = search.search(self.nodes, query)
        near = graph.neighbours(self.edges, self.nodes, seeds).groupBy("id").agg(F.max("score").alias("score")).join(seeds.select("id"), "id", "left_anti")
        both = seeds.select("id", "score", "rank").unionByName(near.select("id", "score", F.lit(None).cast("int").alias("rank")))
        pos = F.row_number().over(Window.orderBy(F.asc_nulls_last("rank"), F.desc("score"), "id"))  # a report of some dozens of nodes
        return both.withColumn("pos", pos).join(self.nodes, "id").withColumn("query", F.lit(query))

    def context(self, query: str, max_tokens: int = 1200, max_snippets: int = 3, per_file: int = 1, form: str = "xml") -> DataFrame:
        """The best symbols and their neighbours as snippets within the budget, in one text."""
        ranked = self.ranked(query)
        chosen = context.select(context.snippets(ranked, self.files), max_tokens, max_snippets, per_file)
        return self.written(query, ranked, chosen, form)

    def written(self, query: str, ranked: DataFrame, chosen: DataFrame, form: str) -> DataFrame:
        queries = self.spark.createDataFrame([(query,)], "query string")
        entries, related = ranked.filter("rank is not null"), ranked.filter("rank is null")
        forms = {
            "xml": lambda: context.as_xml(chosen), "markdown": lambda: context.as_markdown(chosen), "structured": lambda: outline.structured(queries, entries, related, chosen),
            "graph": lambda: outline.linearised(queries, entries, chosen, self.edges, self.nodes), "rows": lambda: chosen,
        }
        return forms[form]()

    def structural(self, query: str, depth: int = 2, max_nodes: int = 30) -> DataFrame:
        """id, score, rank: what a search finds and, for half of their score, what walks from there find."""
        seeds = cut(search.search(self.nodes, query))
        walk = graph.traverse(self.edges, self.nodes, seeds.select("id"), depth, max_nodes)
        found = walk.join(seeds.select(F.col("id").alias("root"), F.col("rank").alias("seed"), F.col("score").alias("own")), "root")
        found = found.withColumn("score", F.when(F.col("id") == F.col("root"), F.col("own")).otherwise(F.col("score") * 0.5))
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("depth") > 0, "seed", "seq"))
        found = found.withColumn("_n", first).filter("_n = 1")
        return found.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "seed", "seq", "id")).alias("rank"))

    def explore(self, query: str, max_nodes: int = 30) -> DataFrame:
        """query, text: entry points, related symbols and code around a query, and the relationships among the first nodes."""
        results = cut(self.structural(query))
        found = cut(graph.explore(self.edges, self.nodes, results, max_nodes=max_nodes))
        ranked = found.join(self.nodes, "id").withColumns({"query": F.lit(query), "rank": F.when((F.col("pos") <= 5) & (F.col("score") > 0), F.col("pos"))})
        chosen = context.select(context.snippets(ranked.filter("pos <= 15"), self.files), 64000, 10)
        body = self.written(query, ranked, chosen, "structured")
        related = outline.relationships(self.edges, found.select("id", F.col("pos").alias("rank")), self.nodes)
        among = related.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "target_id", "line"))), lambda x: x["line"]), "\n")).scalar()
        return body.select("query", F.concat("text", F.lit("\n## Relationship Map\n\n"), among).alias("text"))

    def status(self) -> DataFrame:
        return stats.totals(self.nodes, self.edges)
