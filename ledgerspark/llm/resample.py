"""Importance resampling towards a target distribution, on hashed n-grams.

Texts are handled as UTF-8 bytes: a table of 256 bytes lower-cases A-Z and blanks what separates words, bytes.split
yields the words, and the CRC of a run of words grows by one word at a time (crc32(b" " + word, CRC of the run before
it)). Counters reduce the runs of a batch before buckets are counted, so a task hands on at most one row a bucket.

A bucket's gain is the logarithm of how much more often the target has it, smoothed by one in each bucket; a document's
weight is the sum of its features' gains. Documents are drawn without replacement with probabilities that follow the
weights: noise from a hash of the doc_id is added (Gumbel's trick), and the highest scores win. Ranks are taken over
ranges of scores, so no task orders them all.

Defined cases: null and empty texts have no features, weight 0 and a score (the noise alone), and count among the
documents to draw from only if they have enough words; very long texts are read whole; repeated rows are counted and
scored each; ties go to the smaller doc_id, then to the smaller weight and fewer features; a row without a doc_id gets
the noise of an empty id and comes after its ties; an empty table gives an empty result, and an empty target gives all
buckets of a size the same gain; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import ranked
from .common import cut, small_batches, table

#: Buckets, words in a feature (least, most), words a document needs to be drawn, and documents drawn in a hundred.
BUCKETS, SHORTEST, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 1, 20, 10, 2024
#: Distinct words whose gain a task remembers before it starts anew.
REMEMBERED = 500_000
#: Lower-cases A-Z; all bytes of ASCII but letters and digits become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def features(own: list[bytes], shortest: int, longest: int) -> Counter:
    """How often the words have each feature, by its CRC."""
    out: Counter = Counter()
    run = list(map(zlib.crc32, own))
    if shortest <= 1:
        out.update(run)
    for k in range(1, longest):
        run = [zlib.crc32(b" " + w, c) for c, w in zip(run, own[k:], strict=False)]
        if k + 1 >= shortest:
            out.update(run)
    return out


def bucket_counts(df: DataFrame, n_buckets: int, shortest: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_buckets, np.int64)
        for b in batches:
            own: Counter = Counter()
            texts = b.column(0).to_pylist()
            if longest == 1:
                found: Counter = Counter()
                for t in texts:
                    found.update(words(t))
                for w, k in found.items():
                    own[zlib.crc32(w)] += k
            else:
                for t in texts:
                    own.update(features(words(t), shortest, longest))
            if own:
                np.add.at(n, np.fromiter(own, np.int64, len(own)) % n_buckets, np.fromiter(own.values(), np.int64, len(own)))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    counts = df.select(F.col("text").cast("binary")).mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in counts.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds to a weight."""
    m, s_all, t_all = len(docs), int(docs.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)]


def weigh(docs: DataFrame, gain: list[int], shortest: int, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = held.value, {}
        m = len(gain)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                own = words(text)
                if longest == 1:
                    counts = Counter(own)
                    known.update((w, gain[zlib.crc32(w) % m]) for w in counts if w not in known)
                    weight = sum(map(mul, map(known.__getitem__, counts), counts.values()))
                    rows.append((len(own), len(own), weight))
                else:
                    counts = features(own, shortest, longest)
                    rows.append((len(own), counts.total(), sum(gain[c % m] * k for c, k in counts.items())))
            if len(known) > REMEMBERED:
                known.clear()
            columns = np.array(rows, np.int64).reshape(-1, 3).T.copy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    n_buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; those with a rank are drawn."""
    if not 1 <= shortest <= longest or n_buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("features of one word or more, at least one bucket, and a percentage")
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, n_buckets, shortest, longest), bucket_counts(target, n_buckets, shortest, longest))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weigh(docs, gain, shortest, longest).withColumn("score", F.col("weight") + noise))
    enough = F.col("n_words") >= least_words
    n_drawn = percent * scored.filter(enough).count() // 100
    places = ranked(scored.filter(enough), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return places.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank"))).unionByName(rest).drop("n_words")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


#: The same in SQL: CRCs come from the 256 remainders that eight halvings give, word by distinct word.
OP12_SQL = """
WITH remainders AS (
  SELECT list(r ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
),
texts AS (
  SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
),
split AS (
  SELECT side, row, doc_id,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts
),
counted AS (SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM split) GROUP BY side, row, word),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counted)),
bytes AS (SELECT word, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM hexed),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[CAST((xor(c, v) & 255) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket
  FROM bytes, remainders
),
sides AS (
  SELECT bucket, COALESCE(sum(n) FILTER (side = 's'), 0) AS s, COALESCE(sum(n) FILTER (side = 't'), 0) AS t
  FROM counted JOIN buckets USING (word) GROUP BY bucket
),
totals AS (SELECT COALESCE(sum(s), 0) AS s_all, COALESCE(sum(t), 0) AS t_all FROM sides),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM sides, totals
),
weights AS (
  SELECT row, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row
),
noise AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features,
    CAST('0x' || substr(sha256('2024:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM split WHERE side = 's'
),
scored AS (
  SELECT doc_id, n_features, COALESCE(weight, 0) AS weight,
    COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (row)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
