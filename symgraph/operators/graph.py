"""Graph operators: neighbours, bounded walks, hop counts, best-first traversal, focus."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.operators import lookup
from symgraph.schema import DEPENDENCY_KINDS, DEPENDENT_KINDS, EDGE_WEIGHTS, OTHER_WEIGHT
from symgraph.sources.shared import cut, kept


def weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (EDGE_WEIGHTS if weights is None else weights).items() for x in kv])
    return F.coalesce(table[kind], F.lit(OTHER_WEIGHT))


def callers(edges: DataFrame, nodes: DataFrame, targets: DataFrame, kind: str = "calls") -> DataFrame:
    """target_id and the calling node, one row per edge."""
    e = edges.filter(F.col("kind") == kind).join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return e.select("target_id", "source_id", "line").join(nodes.withColumnRenamed("id", "source_id"), "source_id")


def callees(edges: DataFrame, nodes: DataFrame, sources: DataFrame, kind: str = "calls", limit: int | None = None) -> DataFrame:
    """source_id and the called node, at most limit per source in the order of edge ids."""
    e = edges.filter(F.col("kind") == kind).join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    if limit:
        e = e.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).filter(F.col("_n") <= limit)
    return e.select("source_id", "target_id", "line").join(nodes.withColumnRenamed("id", "target_id"), "target_id")


def adjacency(edges: DataFrame, direction: str, kinds: Sequence[str] = ()) -> DataFrame:
    """near, far, edge_id, kind, seq: what can be walked from near."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    fore = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"), F.col("id").alias("edge_id"), "kind", F.lit(0).alias("side"))
    back = edges.select(F.col("target_id").alias("near"), F.col("source_id").alias("far"), F.col("id").alias("edge_id"), "kind", F.lit(1).alias("side"))
    return {"forward": fore, "backward": back}.get(direction, fore.unionByName(back))


def hops(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both", kinds: Sequence[str] = ()) -> DataFrame:
    """root, id, hop: smallest number of steps from each root, up to depth."""
    step = adjacency(edges, direction, kinds).select("near", "far").distinct()
    step = cut(step)
    seen = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop")))
    front = seen
    for h in range(1, depth + 1):
        front = front.join(step, front["id"] == step["near"]).select("root", F.col("far").alias("id"), F.lit(h).alias("hop")).distinct()
        front = cut(front.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", "hop"))
        seen = seen.unionByName(front)
    return seen


def neighbours(edges: DataFrame, nodes: DataFrame, roots: DataFrame, direction: str = "forward", kinds: Sequence[str] = ()) -> DataFrame:
    """root, id, score: nodes one step away with the weight of the first edge that leads there.

    The roots come first: only what leaves them moves again to meet the nodes.
    """
    near = adjacency(edges, direction, kinds).filter("near <> far").join(roots.select(F.col("id").alias("near")), "near", "left_semi")
    hit = near.join(nodes.select(F.col("id").alias("far")), "far", "left_semi")
    first = hit.groupBy("near", "far").agg(F.min_by("kind", F.struct("side", "edge_id")).alias("kind"))
    return first.select(F.col("near").alias("root"), F.col("far").alias("id"), weight(F.col("kind")).alias("score"))


def best_path_score(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "forward", kinds: Sequence[str] = ()) -> DataFrame:
    """root, id, score: largest product of edge weights over walks of at most depth steps."""
    step = kept(adjacency(edges, direction, kinds).select("near", "far", weight(F.col("kind")).alias("w")))
    best = roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("score"))
    front = best
    for _ in range(depth):
        far = front.join(step, front["id"] == step["near"]).select("root", F.col("far").alias("id"), (F.col("score") * F.col("w")).alias("score"))
        front = kept(far.groupBy("root", "id").agg(F.max("score").alias("score")))
        best = best.unionByName(front)
    return best.groupBy("root", "id").agg(F.max("score").alias("score"))


#: Walks that are held as Python objects at once.
WALKS_AT_ONCE = 256
#: Types of ids.
ID_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def best_first(starts: list, lists: dict, hubs: set, max_depth: int, max_nodes: int, min_score: float) -> tuple[dict, object]:
    """One walk over adjacency lists ((far, edge_id, w) by node) from all of its starts: highest score first, then smallest id.

    What is found, in the order of discovery, as id: (depth, score, path).  A hub (without
    a list here) ends the walk when its turn comes; it is returned beside.  Nodes that
    lead nowhere get no turn.
    """
    found = {x: (0, 1.0, ()) for x in sorted(starts)}
    heap = [(-1.0, x) for x in found]
    while heap and len(found) < max_nodes:
        score, at = heapq.heappop(heap)
        depth, score, path = found[at]
        if depth >= max_depth or score < min_score:
            continue
        if at in hubs:
            return found, at
        for far, edge, w in lists.get(at, ()):
            if far not in found:
                found[far] = (depth + 1, score * w, (*path, edge))
                if depth + 1 < max_depth and (far in lists or far in hubs):
                    heapq.heappush(heap, (-score * w, far))
    return found, None


def plain(values: pa.Array) -> list:
    """Python values of a column, many times faster than to_pylist where nothing is null."""
    return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()


def laid_out(lists: pa.ListArray) -> tuple[pa.Array, list[int]]:
    """The values of a column of lists one after the other, and where each list begins and the last ends."""
    at = lists.offsets.to_numpy()
    return lists.values.slice(at[0], at[-1] - at[0]), (at - at[0]).tolist()


def walks(lists: DataFrame, max_depth: int, max_nodes: int, min_score: float, paths: bool = True) -> DataFrame:
    """root, id, depth, score, path, seq, open for lists (root, starts, near, out, hub): many walks to a batch, one at a time."""
    types = dict(lists.dtypes) | {"edge": lists.schema["out"].dataType.elementType["edge_id"].dataType.simpleString()}
    root_type, id_type, edge_type = (ID_TYPES[types[c]] for c in ("root", "near", "edge"))
    rows = lists.groupBy("root").agg(F.first("starts").alias("starts"), F.collect_list(F.struct("near", "out", "hub")).alias("lists"))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        (starts, start_at), (own, own_at) = laid_out(batch.column("starts")), laid_out(batch.column("lists"))
        starts, near, hub = plain(starts), plain(own.field("near")), plain(own.field("hub"))
        out, out_at = laid_out(own.field("out"))
        steps = list(zip(*(plain(out.field(c)) for c in ("far", "edge_id", "w")), strict=True))
        root, ids, depth, score, path, seq, last = [], [], [], [], [], [], []
        for r, x in enumerate(plain(batch.column("root"))):
            mine = range(own_at[r], own_at[r + 1])
            hubs = {near[i] for i in mine if hub[i]}
            of = {near[i]: steps[out_at[i] : out_at[i + 1]] for i in mine if out_at[i] < out_at[i + 1]}
            found, end = best_first(starts[start_at[r] : start_at[r + 1]], of, hubs, max_depth, max_nodes, min_score)
            root += [x] * len(found)
            ids += found
            for d, s, p in found.values():
                depth.append(d)
                score.append(s)
                path.append(p if paths else ())
            seq += range(len(found))
            last += [i == end for i in found] if hubs else [False] * len(found)
        ends = np.cumsum([0, *(len(p) for p in path)], dtype=np.int32)
        path = pa.ListArray.from_arrays(ends, pa.array([e for p in path for e in p], edge_type))
        columns = [pa.array(root, root_type), pa.array(ids, id_type), pa.array(depth, pa.int32()), pa.array(score, pa.float64()), path, pa.array(seq, pa.int32()), pa.array(last, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["root", "id", "depth", "score", "path", "seq", "open"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WALKS_AT_ONCE):
                yield some(batch.slice(at, WALKS_AT_ONCE))

    return rows.mapInArrow(walk, f"root {types['root']}, id {types['near']}, depth int, score double, path array<{types['edge']}>, seq int, open boolean")


def weighted_steps(edges: DataFrame, direction: str, kinds: Sequence[str], weights: dict[str, float] | None) -> DataFrame:
    """near, far, side, edge_id, w: what can be walked from near."""
    return adjacency(edges, direction, kinds).select("near", "far", "side", "edge_id", weight(F.col("kind"), weights).alias("w"))


def to_nodes(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """steps whose far is a node.

    Few edges lead nowhere as a rule, so the ids that are no nodes are looked for, which
    moves ids only, and the steps themselves stay where they are.
    """
    far = steps.select("far").filter("far IS NOT NULL").distinct()
    missing = kept(far.join(nodes.select(F.col("id").alias("far")), "far", "left_anti"))
    steps = steps.filter("far IS NOT NULL")
    return steps if missing.isEmpty() else steps.join(missing, "far", "left_anti")


#: Starts up to which only steps near them are stored.
FEW = 1000


def among(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """rows, few and stored, whose column is a node: their ids go to the nodes, not the nodes to them."""
    there = nodes.select(F.col("id").alias(column)).join(rows.select(column).distinct(), column, "left_semi")
    return rows.join(kept(there), column, "left_semi")


def steps_near(steps: DataFrame, nodes: DataFrame, start: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """All steps to nodes from those that walks from few starts (column id) may expand.

    Each round asks the edges for the steps from the nodes it has come to, which are
    stored and hence sent to the edges while they are few.  A hub leads no further.
    """
    seen = front = kept(start.select(F.col("id").alias("near")).distinct())
    found = None
    for depth in range(1, max(1, max_depth) + 1):
        out = kept(among(kept(steps.join(front, "near", "left_semi")), "far", nodes))
        found = out if found is None else found.unionByName(out)
        if depth < max_depth:
            onward = out.groupBy("near").agg(F.count_distinct("far").alias("n")).filter(F.col("n") < max_nodes)
            onward = out.join(onward, "near", "left_semi").select(F.col("far").alias("near")).distinct()
            front = kept(onward.join(seen, "near", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    return found


#: What orders the steps from a node, and then what a walk needs of one.
STEP = ("side", "edge_id", "w", "far")


def first_steps(steps: DataFrame) -> DataFrame:
    """near, far, step (side, edge_id, w, far): the first edge from each node to each other; a walk uses no more."""
    return steps.repartition("near").groupBy("near", "far").agg(F.min(F.struct(*STEP)).alias("step"))


def step_lists(steps: DataFrame, max_nodes: int) -> DataFrame:
    """near, out (far, edge_id, w in the order of steps), hub: lists of fewer than max_nodes other nodes; a hub has none.

    Only nodes with that many edges may be hubs; of these alone, parallel edges are told
    apart.  In the other lists they stay: a walk passes over the later ones.
    """
    out = F.transform(F.sort_array(F.collect_list("step")), lambda x: F.struct(x["far"].alias("far"), x["edge_id"].alias("edge_id"), x["w"].alias("w"))).alias("out")
    many = kept(steps.groupBy("near").agg(F.count("*").alias("n")).filter(F.col("n") >= max_nodes).select("near"))
    few = steps if many.isEmpty() else steps.join(many, "near", "left_anti")
    lists = few.select("near", F.struct(*STEP).alias("step")).groupBy("near").agg(out).withColumn("hub", F.lit(False))
    if many.isEmpty():
        return lists
    far = steps.join(many, "near", "left_semi").select("near", "far").distinct()
    hubs = kept(far.groupBy("near").agg(F.count("*").alias("n")).filter(F.col("n") >= max_nodes).select("near"))
    parallel = many.join(hubs, "near", "left_anti")
    if not parallel.isEmpty():
        firsts = first_steps(steps.join(parallel, "near", "left_semi"))
        lists = lists.unionByName(firsts.groupBy("near").agg(out).withColumn("hub", F.lit(False)))
    return lists.unionByName(hubs.select("near", F.lit(None).cast(lists.schema["out"].dataType).alias("out"), F.lit(True).alias("hub")))


def one_step(steps: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """Walks of one step from an only start each (root, id): the start, then all of its neighbours."""
    near = steps.join(start.select(F.col("id").alias("near")).distinct(), "near", "left_semi").filter("near <> far")
    out = start.withColumnRenamed("id", "near").join(first_steps(to_nodes(near, nodes)), "near")
    nth = F.row_number().over(Window.partitionBy("root").orderBy("step"))
    more = out.select("root", F.col("far").alias("id"), F.lit(1).alias("depth"), F.col("step.w").alias("score"), F.array("step.edge_id").alias("path"), nth.alias("seq"))
    none = F.array().cast(more.schema["path"].dataType)
    return start.select("root", "id", F.lit(0).alias("depth"), F.lit(1.0).alias("score"), none.alias("path"), F.lit(0).alias("seq")).unionByName(more)


def traverse(
    edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int = 3, max_nodes: int = 50, min_score: float = 0.01,
    direction: str = "forward", kinds: Sequence[str] = (), weights: dict[str, float] | None = None, paths: bool = True,
) -> DataFrame:
    """root, id, depth, score, path, seq of best-first walks; ids are strings, or numbers that stand for them in their order.

    roots: id, each the start of a walk of its own, or walk and id, where the starts of
    a walk share one heap and one count of found nodes (root is the walk then).  Starts
    that are no nodes are passed over.

    A node keeps the score of its first discovery; seq is the order of discovery.  A walk
    ends once max_nodes are found, so a node with that many neighbours (a hub) is the
    last that is expanded: lists are gathered for other nodes only, hence short, and the
    neighbours of a hub are joined to the finished walks.  Frontier joins find the lists
    within max_depth steps, and go on from a node only if what is certainly found before
    it (the starts, and the neighbours of an only start) and its own neighbours are too
    few to end the walk.  Joins by node move pairs of ids; what is known of a walk stays
    with its root.  Of few starts, only the steps near them are stored.  Whoever needs no
    paths gets some or all of them empty, without paths.
    """
    steps = weighted_steps(edges, direction, kinds, weights)
    walk_id = F.col("walk") if "walk" in roots.columns else F.col("id")
    given = roots.select((walk_id.cast("string") if "walk" in roots.columns else walk_id).alias("root"), "id").distinct()
    start = given.join(nodes.select("id"), "id", "left_semi")
    if max_depth == 1 and "walk" not in roots.columns and max_nodes > 1 and min_score <= 1:
        return one_step(steps, nodes, start.select("root", "id"))
    if roots.limit(FEW + 1).count() <= FEW:
        start = kept(among(kept(given), "id", nodes))
        steps = steps_near(steps, nodes, start, max_depth, max_nodes)
    else:
        steps = to_nodes(kept(steps), nodes)
    lists = kept(step_lists(steps, max_nodes))

    if "walk" in roots.columns:
        start = start.join(start.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("starts")), "root")
    else:
        start = start.withColumn("starts", F.array("id"))
    front = kept(start.join(lists, start["id"] == lists["near"], "left").select("root", F.col("id").alias("near"), "out", F.coalesce("hub", F.lit(False)).alias("hub"), "starts"))
    sure = F.when(F.size("starts") == 1, F.array_union("starts", F.coalesce(F.col("out.far"), F.array()))).otherwise(F.col("starts"))
    walk = front.select("root", "starts", sure.alias("base")).dropDuplicates(["root"])
    seen = front = front.drop("starts")
    for _ in range(max(0, max_depth - 1)):
        around = F.array_union(F.array_union("base", F.array("near")), F.col("out.far"))
        expanded = front.filter(~F.col("hub") & F.col("out").isNotNull())
        ahead = expanded.select(F.explode("out.far").alias("near")).distinct()
        if ahead.join(lists.select("near"), "near", "left_semi").isEmpty():
            break  # seen from the ids alone, before pairs of them move
        onward = expanded.join(walk.select("root", "base"), "root").filter(F.size(around) < max_nodes)
        onward = onward.select("root", F.explode("out.far").alias("near")).distinct().join(seen.select("root", "near"), ["root", "near"], "left_anti")
        front = kept(onward.join(lists, "near").select(*seen.columns))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)

    def walked(lists: DataFrame) -> DataFrame:
        return walks(lists.join(walk.select("root", "starts"), "root"), max_depth, max_nodes, min_score, paths)

    ending = kept(seen.filter("hub").select("root").distinct())
    if ending.isEmpty():
        return walked(seen).drop("open")
    ended = kept(walked(seen.join(ending, "root", "left_semi")))
    last = ended.filter("open").select("root", F.col("id").alias("near"), "depth", "score", "path")
    firsts = first_steps(steps.join(last.select("near").distinct(), "near", "left_semi"))
    ends = last.join(firsts, "near").select("root", F.col("far").alias("id"), (F.col("depth") + 1).alias("depth"), (F.col("score") * F.col("step.w")).alias("score"), F.array_append("path", F.col("step.edge_id")).alias("path"), "step")
    more = ends.join(ended.select("root", "id"), ["root", "id"], "left_anti")
    had = ended.groupBy("root").agg(F.count("*").alias("_had"))
    nth = F.row_number().over(Window.partitionBy("root").orderBy("step"))
    more = more.withColumn("_nth", nth).join(had, "root").withColumn("seq", (F.col("_had") + F.col("_nth") - 1).cast("int"))
    whole = walked(seen.join(ending, "root", "left_anti")).unionByName(ended).drop("open")
    return whole.unionByName(more.select(*whole.columns))


def dependents(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3, paths: bool = True) -> DataFrame:
    return traverse(edges, nodes, roots, depth, direction="backward", kinds=DEPENDENT_KINDS, paths=paths)


def dependencies(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    return traverse(edges, nodes, roots, depth, direction="forward", kinds=DEPENDENCY_KINDS)


def impact(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """What may break if a root changes, by file."""
    found = dependents(edges, nodes, roots, depth, paths=False).select("root", "id").join(nodes.select("id", "file_path", "kind", "name"), "id")
    item = F.concat_ws(" ", "kind", "name")
    return found.groupBy("root", "file_path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("symbols"))


def focus(edges: DataFrame, nodes: DataFrame, name_part: str, depth: int) -> DataFrame:
    """id, hop of nodes within depth undirected steps of those whose name holds name_part.

    Nodes must be filtered before; if no name matches, all of them are returned.
    """
    seeds = nodes.filter(F.lower("name").contains(name_part.lower())).select("id")
    ids = nodes.select("id")
    step = to_nodes(kept(adjacency(edges, "both").select("near", "far")), nodes)
    seen = seeds.withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, depth + 1):
        front = front.join(step, F.col("id") == F.col("near")).select(F.col("far").alias("id"), F.lit(h).alias("hop")).distinct()
        front = kept(front.join(seen.select("id"), "id", "left_anti").select("id", "hop"))
        seen = seen.unionByName(front)
    none = seeds.agg(F.count("*") == 0).scalar()
    return seen.unionByName(ids.withColumn("hop", F.lit(0)).filter(none))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: for each node the smallest id that it is connected with, over edges among the nodes.

    Each round joins a node's neighbours to the smallest of them, first the larger ones,
    then the smaller ones, until every node hangs on its component's smallest.
    """
    ids = nodes.select("id").distinct()
    ends = edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).filter("u <> v")
    ends = ends.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    stars = cut(ends.select("u", "v").distinct())
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        rows, named = now.agg(F.count("*"), F.count_distinct("u")).first()
        if rows == named and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        stars = now
    return ids.join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


#: Rounds that a search from some nodes takes at most, and how many nodes it may come to in one, before all components are told apart.
REACH_ROUNDS, REACH_NODES = 12, 1 << 20


def reached(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame | None:
    """The nodes (column id) connected with any of the ids, found from there; None if they are far or very many.

    A round sends the few nodes it stands at to the edges, which neither move nor are stored.
    """
    ends = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"))
    step = ends.union(ends.select("far", "near"))
    front = kept(among(kept(ids.select("id").distinct()), "id", nodes))
    seen = front
    for _ in range(REACH_ROUNDS):
        if front.limit(REACH_NODES + 1).count() > REACH_NODES:
            return None
        far = step.join(front.withColumnRenamed("id", "near"), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        front = kept(among(kept(far.join(seen, "id", "left_anti")), "id", nodes))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    return None


def component_focus(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, component of all nodes connected with any of the ids (column id).

    What is near is found from the ids; else the components of all nodes are told apart.
    """
    near = reached(edges, nodes, ids)
    if near is not None:
        near = kept(near)
        return components(kept(lookup.induced_edges(edges.select("source_id", "target_id"), near)), near)
    all_ = cut(components(edges, nodes))
    return all_.join(all_.join(ids.select("id").distinct(), "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id", "component")


def view(
    nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = (), languages: Sequence[str] = (), globs: Sequence[str] = (), name_part: str = "", depth: int = 3, component: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph view: filters, then the focus on a name, then the edges among what is left.

    The focus keeps what is within depth undirected steps of the nodes whose name holds
    name_part, or their whole components; if no name matches, all nodes stay.
    """
    shown = lookup.filter_nodes(nodes, kinds, languages, globs)
    if not name_part:
        return shown, lookup.induced_edges(edges, shown)
    seeds = lookup.filter_nodes(shown, name_part=name_part).select("id")
    if component and not seeds.isEmpty():
        near = component_focus(edges, shown, seeds)
    else:
        edges = kept(lookup.induced_edges(edges, shown))
        near = focus(edges, shown, name_part, depth)
    near = kept(near.select("id").distinct())
    return shown.join(near, "id", "left_semi"), lookup.induced_edges(edges, near)


def explore(edges: DataFrame, nodes: DataFrame, results: DataFrame, entries: int = 5, depth: int = 2, max_nodes: int = 30) -> DataFrame:
    """id, score, pos: ranked results (id, score, rank), then what walks from the first of them find, with score 0.

    Walks are taken in the order of the entries, their nodes in the order of discovery,
    until max_nodes nodes are there; all results stay.
    """
    own = cut(results.select("id", "score", "rank"))
    walks = traverse(edges, nodes, own.filter(F.col("rank") <= entries).select("id"), depth, max_nodes)
    more = walks.join(own.select(F.col("id").alias("root"), "rank"), "root").groupBy("id").agg(F.min(F.struct("rank", "seq")).alias("at"))
    more = more.join(own.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("score"), F.lit(1).alias("part"), "at.rank", "at.seq")
    every = own.select("id", "score", F.lit(0).alias("part"), "rank", F.lit(0).alias("seq")).unionByName(more)
    pos = F.row_number().over(Window.orderBy("part", "rank", "seq", "id"))  # a report of the walks' few nodes
    return every.withColumn("pos", pos).filter((F.col("part") == 0) | (F.col("pos") <= max_nodes)).select("id", "score", "pos")


def relationship_map(edges: DataFrame, ranked: DataFrame, sources: int = 5, targets: int = 15, limit: int = 10) -> DataFrame:
    """source_id, target_id, kind between the first nodes of a ranking (id, rank)."""
    e = edges.join(ranked.filter(F.col("rank") <= sources).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).filter(F.col("_n") <= limit)
    e = e.join(ranked.filter(F.col("rank") <= targets).select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return e.groupBy("source_id", "target_id").agg(F.min_by("kind", "id").alias("kind"))
