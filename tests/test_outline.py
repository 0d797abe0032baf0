"""Contexts of several sections against a plain version."""

import random

from symgraph.operators import outline

NODES = "id string, name string, kind string, visibility string, is_async boolean, is_exported boolean, file_path string, start_line int, signature string, docstring string"


def plain_structured(query, entries, related, chosen):
    out = ["## Code Context", "", f"**Query:** {query}", ""]
    if entries:
        out += ["### Entry Points", ""]
        for n in entries[:5]:
            more = (f" ({n['visibility']})" if n["visibility"] != "public" else "") + (" (async)" if n["is_async"] else "") + (" (exported)" if n["is_exported"] else "")
            out.append(f"- **{n['name']}** ({n['kind']}){more} - {n['file_path']}:{n['start_line']}")
            out += [f"  `{n['signature'][:120]}`"] * bool(n["signature"]) + [f"  {n['docstring'][:100]}"] * bool(n["docstring"])
        out.append("")
    if related:
        out += ["### Related Symbols", "", *dict.fromkeys((n["file_path"], n["name"]) for n in related[:15]), ""]
        first = {}
        for n in related[:15]:
            first.setdefault((n["file_path"], n["name"]), n["kind"])
        out = [f"- {x[0]}: {x[1]} ({first[x]})" if isinstance(x, tuple) else x for x in out]
    return "\n".join(out + plain_code(chosen))


def plain_code(chosen):
    return ["### Code", "", *(x for f, a, b, name, code in chosen for x in (f"#### {f}:{a}-{b} ({name})", "```", code, "```", ""))] if chosen else []


def plain_graph(query, entries, scores, chosen, calls, by_id):
    out = ["## Graph Context", "", f"**Query:** {query}", ""]
    bonus = lambda n: 5.0 * n["is_exported"] + {"function": 3.0, "method": 3.0, "class": 4.0, "interface": 4.0}.get(n["kind"], 0.0) + min(0.5 * sum(c[1] == n["id"] for c in calls), 10.0)
    ranked = sorted(entries[:10], key=lambda n: -(scores[n["id"]] + bonus(n)))
    if ranked:
        out += ["### Entry Points (ranked)", ""]
        for n in ranked[:5]:
            tags = [w for w, x in (("exported", n["is_exported"]), ("async", n["is_async"])) if x]
            out.append(f"- **{n['name']}** ({n['kind']}){f' [{chr(44).join(tags)}]'.replace(',', ', ') if tags else ''} - {n['file_path']}:{n['start_line']}")
            out += [f"  `{n['signature'][:120]}`"] * bool(n["signature"])
        out += ["", "### Call Chains", ""]
        for n in ranked[:3]:
            to = [by_id[c[2]] for c in sorted(calls) if c[1] == n["id"]][:10]
            if to:
                out += [f"**{n['name']}** ->", *(f"  - {t['name']} ({t['file_path']})" for t in to[:5]), ""]
    return "\n".join(out + plain_code(chosen))


def test_sections_equal_plain(spark):
    rng = random.Random(3)
    names = NODES.replace(" string", "").replace(" boolean", "").replace(" int", "").split(", ")
    nodes = [
        dict(zip(names, (f"n{i:02}", f"name{i % 9}", rng.choice(["function", "method", "class", "enum"]), rng.choice(["public", "private"]), rng.random() < 0.3, rng.random() < 0.3, f"f{i % 3}.py", i, rng.choice(["", "def x" * 40]), rng.choice(["", "words " * 30])), strict=True))
        for i in range(30)
    ]
    by_id = {n["id"]: n for n in nodes}
    calls = [(f"e{i:03}", rng.choice(nodes)["id"], rng.choice(nodes)["id"]) for i in range(160)]
    entries, related, chosen, scores = {}, {}, {}, {}
    for q in ("one", "two", "three"):
        some = rng.sample(nodes, 12 if q != "three" else 0)
        entries[q], scores[q] = some, {n["id"]: round(rng.random() * 3, 3) for n in some}
        related[q] = rng.sample(nodes, 20) if q == "one" else []
        chosen[q] = [(n["file_path"], 1, 4, n["name"], f"code <{i}>") for i, n in enumerate(some[:2])]
    row = lambda n: tuple(n[c] for c in names)
    e = spark.createDataFrame([(q, i, scores[q][n["id"]], *row(n)) for q in entries for i, n in enumerate(entries[q])], "query string, pos int, score double, " + NODES)
    r = spark.createDataFrame([(q, i, *row(n)) for q in related for i, n in enumerate(related[q])], "query string, pos int, " + NODES)
    c = spark.createDataFrame([(q, i, *x) for q in chosen for i, x in enumerate(chosen[q])], "query string, pos int, file_path string, from_line int, to_line int, name string, code string")
    queries = spark.createDataFrame([(q,) for q in entries], "query string")
    assert {x["query"]: x.text for x in outline.structured(queries, e, r, c).collect()} == {q: plain_structured(q, entries[q], related[q], chosen[q]) for q in entries}
    edges = spark.createDataFrame([(i, a, b, "calls", 0) for i, a, b in calls], "id string, source_id string, target_id string, kind string, line int")
    n = spark.createDataFrame([row(x) for x in nodes], NODES)
    assert {x["query"]: x.text for x in outline.linearised(queries, e, c, edges, n).collect()} == {q: plain_graph(q, entries[q], scores[q], chosen[q], calls, by_id) for q in entries}


def test_relationships(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    edges = spark.createDataFrame([("e", "a", "b", "calls"), ("f", "a", "c", "calls")], "id string, source_id string, target_id string, kind string")
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    assert [r.line for r in outline.relationships(edges, ranked, nodes).collect()] == ["  A --[calls]--> B"]
