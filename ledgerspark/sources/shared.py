"""The folder that driver and executors share, and lineage that is cut there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only a local session (tests, one machine) may go without: there one temporary folder serves the whole session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_shared_dir", None) or tempfile.mkdtemp(prefix="spark-")
        spark._shared_dir = found
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage there, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, **options: str) -> DataFrame:
    """As cut(), by a table in the shared folder: for many rows, of which later steps read a part of the columns. options are the writer's."""
    at = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.parquet(at)
