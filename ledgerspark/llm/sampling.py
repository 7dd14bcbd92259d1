"""Bounded samples of labelled rows, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, target: str, per_class: int, zeros: int = 1) -> DataFrame:
    """doc_id, text, y of rows that may be learned from: about per_class rows at most of each class, chosen by a hash of doc_id.

    Of the zeros, `zeros` times as many. The chosen labels are bounded by about (1 + zeros) x per_class rows, so they go out by broadcast and the texts stay where they are.
    """
    own = labels.filter(~held_out(F.col("doc_id")) & F.col(target).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("y")).dropDuplicates(["doc_id"])
    counts = dict(own.groupBy("y").count().collect())
    share = F.when(F.col("y") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, zeros * per_class / max(1, counts.get(0, 0))))
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
