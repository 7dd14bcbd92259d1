"""Sharding by balanced label propagation.

Documents that share a link (here: equal texts) are neighbours. Each starts in the shard its doc_id hashes to. Then,
for some rounds, the members of a link that sit in one shard form a block; the blocks of a link vote, weighted by
their sizes, for the shard that holds most of it, and blocks elsewhere ask to move there. A shard admits movers up to
its quota of free rows: where more ask than fit, a fixed share of them, chosen by hash, is admitted. A last step makes
the law `rows` hold exactly: linked documents keep their places first, and what exceeds a shard's count fills the
vacancies of others. Votes run on blocks, never on pairs of documents, so a link with a third of all rows is at most
n_shards rows here.

Law: `rows`. Shard counts differ by one at most; slots are gapless from 0 in each shard; grown_shard is null.
Links with a thousandth of all rows or more meet their blocks by broadcast (at most a thousand links, a row for each shard), so
none of them gathers in 24 tasks.

Defined cases: texts of any length count whole; a link larger than a shard fills one and flows over into vacancies; other
columns do not matter; a null text has size 8 and CRC 0 and is linked with empty texts; an empty table gives an empty result;
rows that repeat a doc_id, or have none, are rows like any other (copies get slots in an undefined order among themselves).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_hot, partitions, table

SHARDS, ROUNDS = 24, 4


def propagate(docs: DataFrame, n_shards: int, rounds: int) -> DataFrame:
    """(link, start, shard, n, size) of the blocks of links with two members or more, after the rounds. docs: link, start."""
    blocks = docs.groupBy("link", "start").agg(F.count("*").alias("n"))
    links = blocks.groupBy("link").agg(F.sum("n").alias("size")).filter("size > 1")
    blocks = cut(blocks.join(links, "link").withColumn("shard", F.col("start")))
    singles = {r["start"]: r["n"] for r in docs.groupBy("start").agg(F.count("*").alias("n")).collect()}  # n_shards rows
    for r in blocks.groupBy("start").agg(F.sum("n").alias("n")).collect():
        singles[r["start"]] -= r["n"]
    cap = -(-(sum(singles.values()) + (blocks.agg(F.sum("n")).first()[0] or 0)) // n_shards)
    for turn in range(rounds):
        held = blocks.groupBy("link", "shard").agg(F.sum("n").alias("here"))
        # Ties go to a shard that the link's hash picks, else low shards would fill first.
        order = F.struct("here", F.pmod(F.xxhash64("link", "shard", F.lit(turn)), F.lit(1 << 20)).alias("tie"))
        goal = held.groupBy("link").agg(F.max_by("shard", order).alias("goal"))
        asked = cut(blocks.join(goal, "link"))
        now = dict(asked.groupBy("shard").agg(F.sum("n")).collect())
        wish = dict(asked.filter("shard <> goal").groupBy("goal").agg(F.sum("n")).collect())
        if not wish:
            break
        # Singles give way in the last step, so a shard's quota is what its linked documents leave free.
        free = {s: max(0, cap - now.get(s, 0)) for s in range(n_shards)}
        share = F.element_at(F.expr("map(" + ", ".join(f"{s}, {min(1.0, free[s] / wish[s]) if s in wish else 1.0}D" for s in range(n_shards)) + ")"), F.col("goal"))
        lot = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(1_000_000)) / 1e6
        blocks = asked.withColumn("shard", F.when((F.col("shard") != F.col("goal")) & (lot < share), F.col("goal")).otherwise(F.col("shard"))).drop("goal")
    return blocks.select("link", "start", "shard", "size", "n")


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, link, other columns, shard, slot for docs (doc_id, link and others that are carried along), balanced by rows."""
    spark = docs.sparkSession
    taken = {"start", "shard", "size", "n", "c1", "c2", "c3", "r", "before", "rank", "quota", "nth", "slot"}
    assert not taken & set(docs.columns), "a column's name is used inside"
    columns = ["doc_id", "link", *(c for c in docs.columns if c not in ("doc_id", "link"))]
    own = cut(docs.select(*columns, F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("start")))
    blocks = propagate(own, n_shards, rounds)
    placed = join_hot(own, blocks, ["link", "start"], "n", own.count(), how="left").select(*columns, F.coalesce("shard", "start").alias("shard"), F.coalesce("size", F.lit(1)).alias("size"))
    # Rank within a shard in two levels: cells, whose counts are summed up in order, and rows within a cell. Large links are
    # dealt over cells by doc_id, so a cell stays small whatever the data.
    cells = max(64, partitions(spark))
    large = F.when(F.col("size") > 1000, F.pmod(F.xxhash64("doc_id"), F.lit(cells))).otherwise(F.lit(0)).cast("int")
    key = [
        (F.col("size") == 1).cast("int").alias("c1"),
        F.when(F.col("size") == 1, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(cells))).otherwise(F.pmod(F.xxhash64("link"), F.lit(cells))).cast("int").alias("c2"),
        large.alias("c3"),
    ]
    by = ["shard", "c1", "c2", "c3"]
    placed = cut(placed.select(*columns, "shard", *key))
    counts = placed.groupBy(*by).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("c1", "c2", "c3").rowsBetween(W.unboundedPreceding, -1)))
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("link", "doc_id")) - 1)
    ranked = ranked.join(before.select(*by, F.coalesce("before", F.lit(0)).alias("before")), by).withColumn("rank", F.col("r") + F.col("before"))

    load = dict(counts.groupBy("shard").agg(F.sum("n")).collect())  # n_shards rows
    total = sum(load.values())
    base, extra = divmod(total, n_shards)
    fullest = sorted(range(n_shards), key=lambda s: (-load.get(s, 0), s))
    quota = {s: base + (i < extra) for i, s in enumerate(fullest)}
    given, taken, over_at, holes = 0, 0, {}, []
    for s in range(n_shards):
        have = load.get(s, 0)
        over_at[s] = given  # index of its first surplus row among all
        given += max(0, have - quota[s])
        if have < quota[s]:
            holes.append((taken, taken + quota[s] - have, s, have))
            taken += quota[s] - have
    pick = lambda of: F.element_at(F.expr("map(" + ", ".join(f"{s}, {of(s)}L" for s in range(n_shards)) + ")"), F.col("shard"))
    ranked = ranked.withColumn("quota", pick(lambda s: quota[s])).withColumn("nth", pick(lambda s: over_at[s]) + F.col("rank") - F.col("quota"))
    to, slot = F.col("shard"), F.col("rank")
    for lo, hi, s, have in holes:
        there = (F.col("rank") >= F.col("quota")) & (F.col("nth") >= lo) & (F.col("nth") < hi)
        to, slot = F.when(there, F.lit(s)).otherwise(to), F.when(there, F.col("nth") - lo + have).otherwise(slot)
    return ranked.select(*columns, to.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("link"))
    return shard(facts).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
