"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row for each digest (partial
aggregation before the shuffle, so copies of one text never travel one by one), then anti-joined to the index by
sort-merge on the bucketing key, and what is new is appended; digests met again are appended as counts only. Texts count
as equal when their bytes are the same. A table that is to be deduplicated within itself goes through an index of its own
in BATCHES batches, large doc_ids first, so that the text's first row to arrive is the one with the largest doc_id; such
an index is dropped once the result is written to the shared folder.

Defined cases: a null text equals an empty one; of equal texts in a batch the row with the largest doc_id stays; of a
text that the index already holds from an earlier batch no row stays: keep_id is the earlier batch's row, and group_size
counts the rows of all batches; repeated doc_ids are rows (label marks all rows of a text's largest doc_id as kept, if it
repeats; keep_first keeps exactly one row of each text); rows without a doc_id give way to those with one (keep_first keeps
one of them where a text has no other); an empty batch appends nothing; texts are hashed whole, however long; other columns pass through untouched
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, identified, join_hot, partitions, table

DIGEST = "text_sha256"
#: Batches in which a table goes through an index of its own.
BATCHES = 2


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the lowercase hex SHA-256 of the text as it is."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias(DIGEST))


class DigestIndex:
    """A catalog table of (text_sha256, keep_id, n), bucketed and sorted by text_sha256.

    One row for each digest and batch that held it: the first has keep_id, the later ones only add to the count.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)

    @property
    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        """(text_sha256, keep_id, group_size) of every digest; buckets hold all rows of a digest, so nothing is shuffled."""
        return self.spark.table(self.name).groupBy(DIGEST).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))

    def known(self) -> DataFrame:
        return self.spark.table(self.name).filter("keep_id IS NOT NULL").select(DIGEST)

    def new_of(self, keepers: DataFrame) -> DataFrame:
        """Those of the digests that the index lacks, by sort-merge anti-join."""
        return keepers.hint("merge").join(self.known().hint("merge"), DIGEST, "left_anti") if self.exists else keepers

    def append(self, batch: DataFrame) -> None:
        """Add the digests of `batch` (doc_id, text_sha256). An append is one write job: it lands whole or not at all."""
        keepers = batch.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).repartition(self.buckets, DIGEST)
        own = self.new_of(keepers)
        if self.exists:
            again = keepers.hint("merge").join(self.known().hint("merge"), DIGEST, "left_semi")
            own = own.unionByName(again.withColumn("keep_id", F.lit(None).cast("long"))).repartition(self.buckets, DIGEST)
        own.write.bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def indexed(found: DataFrame, batches: int = BATCHES) -> DigestIndex:
    """An index of its own of `found` (doc_id, text_sha256), filled in batches, large doc_ids first; drop it after use."""
    spark = found.sparkSession
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    lo, hi = found.agg(F.min("doc_id"), F.max("doc_id")).first()
    ends = [lo + (hi - lo + 1) * k // batches for k in range(1, batches)] if lo is not None else []
    nth = sum((F.when(F.col("doc_id") >= e, 1).otherwise(0) for e in ends), F.lit(0))  # no doc_id: the last batch
    for k in range(len(ends), -1, -1):
        index.append(found.filter(nth == k))
    return index


def label(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs: within themselves, or as a new batch of an index."""
    found = cut(digests(docs))  # texts are read and hashed once
    own = index or indexed(found)
    if index:
        index.append(found)
    rows = own.rows()
    total = rows.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = join_hot(found, rows, DIGEST, "group_size", total)
    out = out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), DIGEST)
    if index is None:
        out = cut(out)
        own.drop()
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, columns = identified(docs, below=True)
    index = indexed(cut(digests(rows)))
    stays = cut(index.rows().select(F.col("keep_id").alias("doc_id")))
    index.drop()
    return rows.join(stays, "doc_id", "left_semi").select(*columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
