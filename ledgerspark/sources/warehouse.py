"""Tables in folders: appends that may be repeated, files of bounded size, compaction, and a mark of what a table was made from."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Rows of a file at most.
ROWS_PER_FILE = 2_000_000


def dealt(df: DataFrame, by: str | None, order: tuple[str, ...], rows_per_file: int) -> DataFrame:
    """df in ranges of (by, order) of at most about rows_per_file rows, so that a large value of `by` is written by many tasks."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_file))
    keys = [c for c in (by, *order) if c]
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if keys else df


def append(df: DataFrame, path: str, by: str, order: tuple[str, ...] = (), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Put df's values of `by` into the table: partitions that df holds are replaced whole, all others stay.

    So an append that is repeated, after a lost job, say, changes nothing, and one batch holds all rows of its partitions.
    A null in `by` is a partition of its own; an empty df changes nothing.
    """
    held = dealt(df, by, order, rows_per_file)
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def compact(spark: SparkSession, path: str, by: str, order: tuple[str, ...] = (), rows_per_file: int = ROWS_PER_FILE) -> int:
    """Rewrite the partitions that have more files than their rows need; returns how many these were."""
    table = spark.read.parquet(path)
    files = table.select(by, F.col("_metadata.file_path").alias("file")).groupBy(by, "file").agg(F.count("*").alias("n"))
    per = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("n").alias("n")).filter(F.col("files") > F.ceil(F.col("n") / rows_per_file))
    crowded = cut(per.select(by))
    n = crowded.count()
    if n:
        # The rows are held in the shared folder before their partitions are replaced.
        held = cut(table.join(F.broadcast(crowded) if n <= 10_000 else crowded, table[by].eqNullSafe(crowded[by]), "left_semi"))
        single = held.repartition(by) if held.count() <= n * rows_per_file else dealt(held, by, order, rows_per_file)
        single.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)
    return n


def _status(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths: it changes when any of them does."""
    return hashlib.sha256(repr([_status(spark, p) for p in paths]).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
