"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..sources.shared import cut, shared_dir

__all__ = ["cut", "shared_dir"]  # used throughout the subpackage


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, by Spark's reader alone; only the named columns if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file into the shared folder, on whatever file system that is; returns its path."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, in rows and bytes, wherever the session has Spark's own defaults.

    A batch exists several times over (in the JVM, as Arrow and as Python strings), in each of an executor's tasks.
    """
    for name, default, own in (("maxRecordsPerBatch", "10000", "512"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame, below: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with an id of its own in every row, and what to select to get docs' own columns back.

    Joins on doc_id lose rows without one and mistake rows that share one. Where there are such rows, all get their places in
    the order of doc_id as ids: rows without a doc_id come after all others or before them, rows that share one in any order.
    """
    n, known = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == known:
        return docs, docs.columns
    held = docs.select(F.col("doc_id").cast("long").alias("own"), "text", F.struct("*").alias("row"))
    order = F.col("own").asc_nulls_first() if below else F.col("own").asc_nulls_last()
    return ranked(held, order, F.xxhash64("text"), name="doc_id").drop("own"), ["row.*"]


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, share: int = 1000, how: str = "inner") -> DataFrame:
    """left JOIN right ON key, where right has one row for each key and its number of left rows in weight.

    Keys with at least total/share rows are at most `share` many, whatever the data: these go out by broadcast, so
    that none of them gathers in one task; all the others meet in a shuffled join. how: inner or left.
    """
    least = max(2, -(-total // share))
    hot = F.broadcast(right.filter(F.col(weight) >= least))
    rest = right.filter(F.col(weight) < least)
    hot_keys = hot.select(*([key] if isinstance(key, str) else key))
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot_keys), key, "left_anti").join(rest, key, how))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Each round takes the least label among the neighbours and then follows labels once (pointer jumping), so the
    rounds grow with the logarithm of a component's width: 60 rounds would do for more nodes than there can be, so
    reaching them is an error. Nodes of many edges and labels of many nodes meet their rows by broadcast (join_hot), so
    neither a hub nor a large component gathers in one task. Nothing but counts reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n_edges = both.count()
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("degree")).withColumnRenamed("a", "node"))
    n_nodes = labels.count()
    for _ in range(max_rounds):
        near = join_hot(both, labels.select(F.col("node").alias("b"), "label", "degree"), "b", "degree", n_edges).groupBy("a").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, labels.node == near.a).select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        held = step.groupBy("label").agg(F.count("*").alias("n"))
        jump = held.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        new = cut(join_hot(step, jump, "label", "n", n_nodes).select("node", "degree", "old", F.least("label", "further").alias("label")))
        labels = new.select("node", "label", "degree")
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
