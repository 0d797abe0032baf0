"""The shared folder of the cluster, where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through the folder in spark.checkpoint.dir.

    A temporary folder is set only where no folder is and the session runs on one
    machine; a cluster must name one.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Computes df once and reads it back from Parquet files in the shared folder.

    Takes a fraction of a checkpoint's room and later plans know its true size, but it
    has to be dealt out again where a checkpoint would still lie by its keys.
    """
    path = f"{shared_dir(df.sparkSession)}/symgraph/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="symgraph-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes from fewer files than there are cores.

    A file of one row group is one task, however long its texts take; tables of many
    files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
