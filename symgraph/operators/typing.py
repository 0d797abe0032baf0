"""Types of receivers, by pushing candidate types along assignments, calls and returns.

A value is a variable of a scope: (node id, name); the variable "" of a function is what
it returns, and attributes belong to the type around.  Declared types and constructors
are the first facts; every round joins the new facts with what flows out of their values
and with the methods of their types, until a round adds none.  A value keeps all types
that reach it, so a receiver of several types lists its candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.sources.shared import cut, kept

TYPE_KINDS = ("class", "struct", "interface", "trait", "enum")
FUNCTION_KINDS = ("function", "method")
#: Languages whose members need no this in front of them.
BASE_KINDS = ("extends", "implements")
BARE_MEMBERS = ("java", "kotlin", "swift", "cpp")
SELF = r"^(?:self|this)\.(\w+)$"
#: A name that more types of a language share says nothing about the type.
MOST_TYPES = 16


def spread(facts: DataFrame, flows: DataFrame) -> DataFrame:
    """key, value: all values that reach a key from facts (key, value) along flows (source, target)."""
    flows = kept(flows.select(F.col("source").alias("key"), "target"))
    seen = new = kept(facts.select("key", "value").distinct())
    while not new.isEmpty():
        onward = new.join(flows, "key").select(F.col("target").alias("key"), "value").distinct()
        new = kept(onward.join(seen, ["key", "value"], "left_anti").select("key", "value"))
        seen = seen.unionByName(new)
    return seen


def named_types(texts: DataFrame, nodes: DataFrame, imported: DataFrame, kinds: tuple[str, ...] = TYPE_KINDS) -> DataFrame:
    """file_id, language, text, target: the nodes of the kinds that a text may mean in a file.

    texts: file_id, language, text; imported: file_id, alias, target_id.  What the file
    imports by that name comes first, then its own, then those of its language; of those
    all are candidates, at most MOST_TYPES.
    """
    last = F.substring_index("text", ".", -1)
    t = texts.select("file_id", "language", "text").distinct().withColumn("name", last)
    n = nodes.filter(F.col("kind").isin(*kinds))
    file_of = nodes.filter("kind = 'file'").select("file_path", F.col("id").alias("file_id"))
    own = n.join(file_of, "file_path").groupBy("file_id", "name").agg(F.min("id").alias("own_id"))
    wide = n.groupBy("language", "name").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, MOST_TYPES).alias("ids"))
    by_import = imported.join(n.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy("file_id", F.col("alias").alias("name")).agg(F.min("target_id").alias("import_id"))
    out = t.join(by_import, ["file_id", "name"], "left").join(own, ["file_id", "name"], "left").join(wide.filter(F.col("n") <= MOST_TYPES), ["language", "name"], "left")
    ids = F.when(F.col("import_id").isNotNull(), F.array("import_id")).when(F.col("own_id").isNotNull(), F.array("own_id")).otherwise(F.col("ids"))
    return out.select("file_id", "language", "text", F.explode(ids).alias("target"))


def members(nodes: DataFrame, edges: DataFrame, fields: DataFrame, depth: int = 8) -> DataFrame:
    """type, name, method, key: methods and fields of each type, its own before those of its bases.

    fields: type, name.  key is the value that a method returns, or that a field has.
    Bases are followed over resolved extends and implements edges; the members of the
    nearest base that has the name count.
    """
    functions = nodes.filter(F.col("kind").isin(*FUNCTION_KINDS) & F.col("parent_id").isNotNull())
    own = functions.select(F.col("parent_id").alias("base"), "name", F.col("id").alias("method"), F.concat("id", F.lit(" ")).alias("key"))
    own = own.unionByName(fields.select(F.col("type").alias("base"), "name", F.lit(None).cast("string").alias("method"), F.concat_ws(" ", "type", "name").alias("key")).distinct())
    up = cut(edges.filter(F.col("kind").isin(*BASE_KINDS) & ~F.col("target_id").startswith("unresolved:")).select(F.col("source_id").alias("type"), F.col("target_id").alias("base")).distinct())
    types = nodes.filter(F.col("kind").isin(*TYPE_KINDS))
    seen = front = cut(types.select(F.col("id").alias("type"), F.col("id").alias("base"), F.lit(0).alias("far")))
    for i in range(1, depth + 1):
        front = front.select(F.col("type").alias("root"), F.col("base").alias("type")).join(up, "type").select(F.col("root").alias("type"), "base", F.lit(i).alias("far")).distinct()
        front = cut(front.join(seen.select("type", "base"), ["type", "base"], "left_anti").select("type", "base", "far"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    nearest = F.dense_rank().over(Window.partitionBy("type", "name").orderBy("far"))
    return seen.join(own, "base").withColumn("_n", nearest).filter("_n = 1").select("type", "name", "method", "key")


def variable(scope: Column, holder: Column, var: Column) -> Column:
    """The key of a variable: attributes of self or this belong to the type around."""
    attribute = F.regexp_extract(var, SELF, 1)
    return F.when((attribute != "") & holder.isNotNull(), F.concat_ws(" ", holder, attribute)).otherwise(F.concat_ws(" ", scope, var))


def infer(variables: DataFrame, calls: DataFrame, nodes: DataFrame, edges: DataFrame, imported: DataFrame) -> DataFrame:
    """edge_id, receiver (type node), method (node): what the calls may bind to, a row a candidate.

    variables: scope, holder, file_id, language, var, how, text.  calls: edge_id, scope,
    holder, file_id, language, text; those with a receiver in front of a dot are bound.
    """
    dotted = F.col("text").contains(".")
    receiver, method = F.regexp_replace("text", r"\.[^.]*$", ""), F.substring_index("text", ".", -1)
    v = variables.withColumn("key", variable(F.col("scope"), F.col("holder"), F.col("var")))
    attribute = F.when(F.col("scope") == F.col("holder"), F.col("var")).otherwise(F.regexp_extract("var", SELF, 1))
    own = cut(members(nodes, edges, v.select(F.col("holder").alias("type"), attribute.alias("name")).filter("type is not null AND name <> ''")))
    calls = calls.filter(dotted).select("edge_id", "scope", "holder", "file_id", "language", receiver.alias("receiver"), method.alias("method"))
    made = v.filter(F.col("how") == "call")
    # Facts: declared types, and results of constructors; a name of a type is its own receiver.
    texts = reduce(DataFrame.unionByName, [v.filter("how <> 'copy'").select("file_id", "language", "text"), calls.select("file_id", "language", F.col("receiver").alias("text"))])
    type_of = cut(named_types(texts, nodes, imported))
    typed = v.filter("how <> 'copy'").join(type_of, ["file_id", "language", "text"]).select("key", F.col("target").alias("value"))
    named = calls.withColumnRenamed("receiver", "text").join(type_of, ["file_id", "language", "text"]).select(F.concat_ws(" ", "scope", "text").alias("key"), F.col("target").alias("value"))
    around = calls.filter(F.col("receiver").isin("self", "this", "cls") & F.col("holder").isNotNull()).select(F.concat_ws(" ", "scope", "receiver").alias("key"), F.col("holder").alias("value"))
    bases = edges.filter(F.col("kind").isin(*BASE_KINDS) & ~F.col("target_id").startswith("unresolved:")).select(F.col("source_id").alias("holder"), F.col("target_id").alias("value"))
    above = calls.filter(F.col("receiver").isin("super()", "super")).join(bases, "holder").select(F.concat_ws(" ", "scope", "receiver").alias("key"), "value")
    facts = reduce(DataFrame.unionByName, [typed, named, around, above])

    # Flows: copies, results of functions, and members or globals where no local variable is meant.
    copies = v.filter("how = 'copy'").select(variable(F.col("scope"), F.col("holder"), F.col("text")).alias("source"), F.col("key").alias("target"))
    functions = named_types(made.filter(~dotted), nodes, imported, FUNCTION_KINDS)
    results = made.join(functions, ["file_id", "language", "text"]).select(F.concat(F.col("target"), F.lit(" ")).alias("source"), F.col("key").alias("target"))
    used = reduce(DataFrame.unionByName, [
        calls.select("scope", "holder", "file_id", "language", F.col("receiver").alias("var")), v.filter("how = 'copy'").select("scope", "holder", "file_id", "language", F.col("text").alias("var")),
        made.filter(dotted).select("scope", "holder", "file_id", "language", receiver.alias("var")),
    ]).distinct()
    local = v.select("scope", "var").distinct()
    free = used.join(local, ["scope", "var"], "left_anti").withColumn("target", variable(F.col("scope"), F.col("holder"), F.col("var")))
    bare = F.col("language").isin(*BARE_MEMBERS) & F.col("holder").isNotNull() & F.col("var").rlike(r"^\w+$")
    outer = free.select(F.explode(F.array_compact(F.array(F.when(bare, F.concat_ws(" ", "holder", "var")), F.when(F.col("scope") != F.col("file_id"), F.concat_ws(" ", "file_id", "var"))))).alias("source"), "target")
    flows = reduce(DataFrame.unionByName, [copies, results, outer]).filter("source <> target").distinct()
    # Results of methods and values of attributes flow once the receiver's type is known.
    waiting = made.filter(dotted).select(variable(F.col("scope"), F.col("holder"), receiver).alias("at"), method.alias("name"), F.col("key").alias("target"), F.lit(True).alias("called"))
    path = F.col("var").rlike(r"^\w+\.\w+$") & ~F.col("var").rlike(SELF)
    attributes = free.filter(path).select(F.concat_ws(" ", "scope", F.substring_index("var", ".", 1)).alias("at"), F.substring_index("var", ".", -1).alias("name"), "target", F.lit(False).alias("called"))
    found = spread_calls(facts, flows, waiting.unionByName(attributes), own)
    at = calls.withColumn("key", variable(F.col("scope"), F.col("holder"), F.col("receiver"))).withColumnRenamed("method", "name")
    hit = at.join(found, "key").withColumnRenamed("value", "type").join(own.filter("method is not null").drop("key"), ["type", "name"])
    return hit.select("edge_id", F.col("type").alias("receiver"), "method").distinct()


def spread_calls(facts: DataFrame, flows: DataFrame, waiting: DataFrame, own: DataFrame) -> DataFrame:
    """spread() with flows that open when the type of what they wait for is known.

    waiting: at, name, target, called; own: type, name, method, key.  What is called
    flows from the result of the type's method of that name, else from its field.
    """
    flows, waiting = cut(flows.select(F.col("source").alias("key"), "target")), cut(waiting.distinct())
    sources = own.select("type", "name", F.col("method").isNotNull().alias("called"), "key")
    seen = new = cut(facts.distinct())
    opened = None
    while not new.isEmpty():
        typed = new.select(F.col("key").alias("at"), F.col("value").alias("type")).join(waiting, "at")
        fresh = cut(typed.join(sources, ["type", "name", "called"]).select("key", "target").distinct())
        onward = [new.join(flows, "key"), seen.join(fresh, "key")]
        if opened is not None:
            onward.append(new.join(opened, "key"))
        opened = fresh if opened is None else opened.unionByName(fresh)
        reached = reduce(DataFrame.unionByName, [x.select(F.col("target").alias("key"), "value") for x in onward]).distinct()
        new = cut(reached.join(seen, ["key", "value"], "left_anti").select("key", "value"))
        seen = seen.unionByName(new)
    return seen


def contexts(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, resolved_target, type_context, target_id: of each call the one candidate, or all of them as ambiguous."""
    name = nodes.select(F.col("id").alias("method"), "qualified_name")
    kind = nodes.select(F.col("id").alias("receiver"), F.col("name").alias("type"))
    d = found.join(name, "method").join(kind, "receiver").groupBy("edge_id").agg(
        F.count_distinct("method").alias("n"), F.min("method").alias("one"), F.min("qualified_name").alias("q"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("receiver"), F.array_sort(F.collect_set("qualified_name")).alias("ambiguous")
    )
    only = F.col("n") == 1
    context = F.to_json(F.struct("receiver", F.when(~only, F.col("ambiguous")).alias("ambiguous"), F.lit("type_flow").alias("source")))
    return d.select("edge_id", F.when(only, F.col("q")).otherwise("").alias("resolved_target"), context.alias("type_context"), F.when(only, F.col("one")).alias("target_id"))
