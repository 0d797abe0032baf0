"""Context assembly: snippets of ranked symbols within a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.schema import SNIPPET_KINDS
from symgraph.sources.shared import cut

MAX_OVERLAP = 0.6


def window_of(start: Column, end: Column, n_lines: Column, max_lines: int, margin: int = 0) -> tuple[Column, Column]:
    """First line (1-based) and number of lines of a snippet, centred if it is too long."""
    first = F.greatest(F.lit(0), start - 1 - margin)
    last = F.least(n_lines, end + margin)
    extra = F.greatest(F.lit(0), last - first - max_lines)
    shift = F.ceil(extra / 2)
    size = F.least(last - first, F.lit(max_lines))
    return (first + shift + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")


def snippets(ranked: DataFrame, files: DataFrame, max_lines: int = 10, max_chars: int = 600, margin: int = 0) -> DataFrame:
    """Snippets of ranked symbols (query, id, name, kind, file_path, start_line, end_line, score).

    files: file_path, lines.  Trailing lines beyond max_chars are dropped.
    """
    d = ranked.filter(F.col("kind").isin(*SNIPPET_KINDS)).join(files, "file_path")
    first, size = window_of(F.col("start_line"), F.col("end_line"), F.size("lines"), max_lines, margin)
    d = d.withColumns({"from_line": first, "_n": size}).withColumn("part", F.expr("slice(lines, from_line, _n)"))
    kept = F.aggregate(
        "part",
        F.struct(F.lit(0).alias("chars"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"] | (a["chars"] + F.length(x) + 1 > max_chars), F.struct(a["chars"].alias("chars"), a["kept"].alias("kept"), F.lit(True).alias("full"))).otherwise(
            F.struct((a["chars"] + F.length(x) + 1).alias("chars"), F.concat(a["kept"], F.array(x)).alias("kept"), F.lit(False).alias("full"))
        ),
        lambda a: a["kept"],
    )
    code = F.array_join(kept, "\n")
    to = (F.col("from_line") + F.col("_n") - 1).cast("int")
    return d.select("query", "id", "name", "file_path", "score", "from_line", to.alias("to_line"), code.alias("code"), F.greatest(F.lit(1), F.floor(F.length(code) / 4)).cast("int").alias("tokens"))


def without_overlaps(found: DataFrame) -> DataFrame:
    """Snippets that overlap no better one of their query and file that stays itself.

    A group is what one query finds in one file; a snippet is compared with those that
    cover one of its lines, so a group takes time in proportion to its lines.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        covering: dict[int, list[tuple[int, int]]] = {}
        stays = []
        for i, (first, last) in enumerate(zip(rows["from_line"].tolist(), rows["to_line"].tolist(), strict=True)):
            near = {span for line in range(first, last + 1) for span in covering.get(line, ())}
            if not any((n := min(last - first, b - a)) > 0 and (min(last, b) - max(first, a)) / n >= MAX_OVERLAP for a, b in near):
                stays.append(i)
                for line in range(first, last + 1):
                    covering.setdefault(line, []).append((first, last))
        return rows.iloc[stays]

    return found.groupBy("query", "file_path").applyInPandas(keep, found.schema)


def select(found: DataFrame, max_tokens: int = 1200, max_snippets: int = 3, per_file: int = 1) -> DataFrame:
    """The snippets of each query that fit, best first, with their place (pos).

    One that overlaps a better one of its file is left out; a full file is passed
    over; the first snippet beyond the budget ends the choice, also one of a full file.
    So what is chosen are the first of each file up to the first that does not fit.  The
    few candidates of a query are ranked first; all other snippets only ask whether they
    end the choice, so no query's snippets are gathered.
    """
    kept = cut(without_overlaps(found))
    order = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    in_file = Window.partitionBy("query", "file_path").orderBy(F.desc("score"), "id")
    ranked = kept.withColumns({"_o": order, "_f": F.row_number().over(in_file)})
    place = Window.partitionBy("query").orderBy("_o")
    best = ranked.filter(F.col("_f") <= per_file).withColumn("pos", F.row_number().over(place)).filter(F.col("pos") <= max_snippets)
    best = best.withColumn("_before", F.coalesce(F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "_o", "tokens"))).alias("_list"))  # max_snippets entries
    # What stands before a snippet of a full file is what was chosen before it.
    passed = ranked.filter(F.col("_f") > per_file).select("query", "_o", "tokens").join(lists, "query")
    ahead = F.filter("_list", lambda x: x["_o"] < F.col("_o"))
    ends = (F.size(ahead) < max_snippets) & (F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]) + F.col("tokens") > max_tokens)
    stops = passed.filter(ends).select("query", "_o").unionByName(best.filter(F.col("_before") + F.col("tokens") > max_tokens).select("query", "_o"))
    first = stops.groupBy("query").agg(F.min("_o").alias("_stop"))
    out = best.join(first, "query", "left").filter(F.col("_stop").isNull() | (F.col("_o") < F.col("_stop")))
    return out.select(*found.columns, F.col("pos").cast("int").alias("pos"))


def relevance(score: Column) -> Column:
    """Two decimals; exact halves (odd eighths) go to the even digit."""
    return F.when((score * 8) % 2 == 1, F.format_string("%.2f", F.bround(score, 2))).otherwise(F.format_string("%.2f", score))


def as_xml(chosen: DataFrame) -> DataFrame:
    """query, xml: the chosen snippets of each query in one element."""

    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    item = F.concat(
        F.lit('<snippet file="'), escaped(F.col("file_path")), F.lit('" lines="'), F.concat_ws("-", "from_line", "to_line"), F.lit('" relevance="'),
        relevance(F.col("score")), F.lit('" source="bm25">\n'), escaped(F.col("code")), F.lit("\n</snippet>"),
    )
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"]), "\n")
    return chosen.groupBy("query").agg(parts.alias("body")).select(
        "query", F.concat(F.lit('<code_context query="'), escaped(F.col("query")), F.lit('">\n'), F.col("body"), F.lit("\n</code_context>")).alias("xml")
    )


def as_markdown(chosen: DataFrame) -> DataFrame:
    item = F.concat(F.lit("### "), "file_path", F.lit(":"), F.concat_ws("-", "from_line", "to_line"), F.lit(" ("), "name", F.lit(")\n```\n"), "code", F.lit("\n```"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"]), "\n\n")
    return chosen.groupBy("query").agg(F.concat(F.lit("## "), F.first("query"), F.lit("\n\n"), parts).alias("markdown"))
