"""Loading of the driver's tables and a checkpoint that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: str | None = None) -> DataFrame:
    """The Parquet table ``name`` of a data folder; ``columns``, as DDL, may leave out columns and nested fields that are not to be read."""
    reader = spark.read if columns is None else spark.read.schema(columns)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def distinct_by(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Re-delivered rows are exact copies, so any copy will do; of rows that differ, which one is kept is not defined.

    ``first`` is combined before the shuffle: a group of copies leaves each map
    task as one row, however large it is. Rows with a null key form one group.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*[f"`{c}`" for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder, which
    goes when the process ends. Anywhere else a missing folder is an error: one
    that only the driver sees would lose what executors write.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="clauseloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


#: Bytes a task may get before small inputs are no longer spread by hand.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out to all cores, before work that costs much per row.

    A small file is one task, and small shuffles are joined to one. Tables
    estimated at more than ``SPREAD_BYTES`` per core have partitions enough and
    are left alone, so nothing large is ever shuffled for this.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
