"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set on a single machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared checkpoint folder, so a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As durable(), but as a Parquet table: compressed, and read back with column pruning and without a
    partitioning, so that a later join shuffles both its sides and Spark may split a hot key's partition."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table may be broadcast up to this many rows (counted before the plan is made); beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def small_or_shuffled(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within the limit; else leave it to a shuffle join."""
    return F.broadcast(table) if table.count() <= limit else table


#: Rows of an Arrow batch at most. Texts are long, and the JVM and a worker each hold whole batches.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Arrow batches of the session are held to ARROW_ROWS rows from here on (smaller ones stay)."""
    if not 0 < int(spark.conf.get(_ARROW)) <= ARROW_ROWS:
        spark.conf.set(_ARROW, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
