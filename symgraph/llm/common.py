"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.sources.shared import spread

#: Words are runs of anything but ASCII white space (Java and RE2 syntax).
SPACE = r"[\x20\x09-\x0D]+"

#: Rows an Arrow batch may hold.  Texts reach 100 kB and more, so the default of
#: 10,000 rows could put a gigabyte into one batch.
ARROW_ROWS = "2000"

#: Rows that a side of a join has at most when it is sent to all tasks.
BROADCAST_ROWS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, dealt over all cores if it has fewer files than there are cores: a file may be one task."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings that the Python stages of this package count on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where neither that setting nor a checkpoint folder exists and the session
    runs on one machine, a temporary folder is made and set; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="symgraph-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symgraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """df, computed once, and marked for broadcast if it has at most BROADCAST_ROWS rows (of a few numbers each)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that are columns of df."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


def ascii_lower(column):
    """Lower-cases A-Z only, unlike lower(), which changes all of Unicode."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frequent(df: DataFrame, count_col: str, limit: int) -> DataFrame:
    """The rows of df with the highest counts, at most limit of them.

    All rows from some count upwards come in, so ties never split at random.  The
    driver only sees a histogram of the counts' logarithms.
    """
    step = F.floor(F.log2(F.col(count_col)) * 8)
    least = None
    total = 0
    for row in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > limit:
            break
        least = row["step"]
    return df.filter(F.lit(False)) if least is None else df.filter(step >= least)
