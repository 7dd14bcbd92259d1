"""Benchmark decontamination: short test items are found inside long documents.

An item is contained if at least THRESHOLD of its distinct five-word shingles occur in a document. Items are
partitioned by the size of their shingle set (powers of two). The partition sets the length k of its items' signatures,
the k smallest shingle hashes (bottom-k MinHash): one more than the partition's largest contained item may lack. Of the
signature of an item that may lack m shingles, at least k - m occur in every document that contains it, however long:
that is the least number of hits for a candidate, and the search loses nothing. Shingles that several items share come last in a
signature, so a line that many items carry makes no candidates of all documents with that line. Candidate pairs are then
verified by exact containment of the shingles themselves, not of their hashes.

Defined cases: words are lower-case runs of letters and digits; a text with one to four words is one shingle; null
and empty texts have none and match nothing; copies of items are rows of their own; rows that repeat a doc_id count as
one document (its best text); texts of any length are read whole; empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, identified, table, words

SHINGLE, THRESHOLD = 5, 0.8
#: Signatures and item shingles go out by broadcast up to this many rows (of some 100 bytes); beyond, by a shuffled join.
BROADCAST_ROWS = 200_000


def spans(w: str, made: str) -> Column:
    """made, a SQL expression over `s` (five words), for each shingle of the word column w."""
    return F.expr(f"CASE WHEN size({w}) = 0 THEN array() ELSE transform(sequence(1, greatest(1, size({w}) - {SHINGLE - 1})), i -> {made.replace('@', f'slice({w}, i, {SHINGLE})')}) END")


def hashes(w: str) -> Column:
    return spans(w, "xxhash64(@)").cast("array<bigint>")


def strings(w: str) -> Column:
    return spans(w, "array_join(@, ' ')").cast("array<string>")


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, n (size of the shingle set), size_class, need (least hits of a candidate), h, in_signature: a row for each distinct shingle of an item."""
    own = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(hashes("w")).alias("s"))
    each = own.select("item_id", F.size("s").alias("n"), F.explode("s").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("held"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("held") > 1, "h"))
    lacking = lambda n: n - F.ceil(n * THRESHOLD - 1e-9).cast("int")
    each = each.join(held, "h").withColumns({"size_class": F.floor(F.log2("n")).cast("int"), "rank": rank})
    k = F.least(F.col("n"), lacking(F.pow(F.lit(2), F.col("size_class") + 1).cast("int") - 1) + 1)
    return each.select("item_id", "n", "size_class", (k - lacking(F.col("n"))).alias("need"), "h", (F.col("rank") <= k).alias("in_signature"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for all contained items."""
    assert math.isclose(threshold, THRESHOLD), "signatures are sized for THRESHOLD"
    signatures = cut(item_shingles(items).filter("in_signature"))
    small = signatures.count() <= BROADCAST_ROWS
    out = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    # Only hashes leave the scan. A document meets the items whose signature it hits, by the rule of their size class.
    seen = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(hashes("w"))).alias("h"))
    hits = seen.join(out(signatures.select("h", "item_id", "size_class", "need")), "h")
    candidates = cut(hits.groupBy("doc_id", "item_id", "size_class").agg(F.count("*").alias("hits"), F.first("need").alias("need")).filter("hits >= need").select("doc_id", "item_id"))
    wanted = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(strings("w")).alias("item"))
    pairs = docs.select("doc_id", "text").join(candidates, "doc_id").select("item_id", "doc_id", words(F.col("text")).alias("w"))
    both = pairs.join(out(wanted), "item_id").select("doc_id", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("item", strings("w"))).cast("long").alias("n_shared"))
    both = both.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9)).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return both.select("doc_id", "item_id", "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that contain an item."""
    rows, columns = identified(docs)
    return rows.join(contained(rows, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP6_SQL = r"""
WITH words AS (
  SELECT 'd' AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT k, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT k, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), items AS (SELECT id, count(*) AS n FROM shingles WHERE k = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n) AS n_item, round(count(*) / any_value(n), 6) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.k = 'd' AND b.k = 'b' JOIN items ON items.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= ceil(any_value(n) * 0.8 - 1e-9)
"""
