"""Live updates: debounced change events, applied batch by batch.

An event names a path and what happened to it; moves become a deletion and an
update.  Deletions are passed on at once.  Updates of a path closer together than the
delay are one session, of which the last counts.  The watermark equals the delay, so a session comes out as soon as
later events show that it is over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgraph.schema import LANGUAGES


def expanded(events: DataFrame) -> DataFrame:
    """events (path, event_type, dest_path, ts, content) as path, op, ts, content of source files."""
    gone = F.struct(F.col("path").alias("path"), F.lit("delete").alias("op"))
    come = F.struct(F.coalesce(F.when(F.col("event_type") == "moved", F.col("dest_path")), F.col("path")).alias("path"), F.lit("upsert").alias("op"))
    both = F.when(F.col("event_type") == "moved", F.array(gone, come)).when(F.col("event_type") == "deleted", F.array(gone)).otherwise(F.array(come))
    out = events.withColumn("_x", F.explode(both)).select("_x.path", "_x.op", "ts", "content")
    return out.filter(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*LANGUAGES))


def debounced(changes: DataFrame, delay: str = "1 second", key: str = "path") -> DataFrame:
    """Deletions at once, and one row per key and session of other changes: the last of them and how many there were."""
    gone = changes.filter("op = 'delete'").select(key, "op", "content", "ts", F.lit(1).cast("long").alias("n"))
    rows = changes.filter("op <> 'delete'")
    rows = rows.withWatermark("ts", delay) if changes.isStreaming else rows
    last = F.max_by(F.struct("op", "content"), "ts")
    sessions = rows.groupBy(key, F.session_window("ts", delay).alias("s")).agg(last.alias("last"), F.max("ts").alias("ts"), F.count("*").alias("n")).select(
        key, "last.op", "last.content", "ts", "n"
    )
    return sessions.unionByName(gone)


def start(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 second") -> StreamingQuery:
    """Runs apply on every batch of debounced changes."""
    return debounced(changes, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def follow(changes: DataFrame, index: str, root: str, checkpoint: str, delay: str = "1 second") -> StreamingQuery:
    """Keeps a stored graph up to date with a stream of changes; a batch that is run again gives the same graph."""
    from symgraph.plans.index import update

    return start(changes, lambda batch, _: update(batch.sparkSession, index, root, batch), checkpoint, delay)
