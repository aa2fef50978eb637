"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Most bytes of rows that a Python worker gets at a time; a larger row is a batch of its own
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: list[str] = []


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir`` or the context's checkpoint
    directory.  Only a local session, where every task sees the same disk, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagewright-")
        context.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/pagewright/{purpose}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process has named so far; returns how many there were.

    Results are lazy and read them, so this is for the caller who is done with them.
    """
    jvm, found = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        found += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return found


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in a scratch folder: computed once, however often they are read."""
    folder = scratch_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def map_batches(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """`rows.mapInArrow` with batches of about `BATCH_BYTES` at most.

    A batch lies outside the heap of an executor, there several times over while it is built, and once more
    in its Python worker; 10 000 texts, Spark's bound, are tens of megabytes of which neither gives all back.
    Spark reads the setting when the rows are computed, so it stays in the session; one that the session
    already has is kept.
    """
    if rows.sparkSession.conf.get(_BATCH, None) is None:
        rows.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)
