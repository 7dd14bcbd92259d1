"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into two 32-bit segments. Two fingerprints within three bits agree on one of the segments up
to one bit, so each distinct fingerprint looks up the Hamming ball of radius one (33 values) around each of its
segments in a table keyed by (segment, value); what it fetches is verified over all 64 bits. Links join distinct
fingerprints, so exact copies of a text cost one row however many there are; components are then found by label
propagation with pointer jumping.

A key that many fingerprints share (near copies of one text) is looked up more finely: there the other segment,
which may hold at most three differing bits, is cut into four bytes, one of which must be equal; see `links`.

Defined cases: words are separated by ASCII white space and only A-Z is lower-cased; fewer than three words make one
shingle; null, empty and blank texts have fingerprint zero and are linked like any other; repeated doc_ids are rows, each in the
class of its own text; a class whose rows all lack a doc_id has none; keep_first keeps exactly one row of each class, one
without a doc_id only where the class has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, identified, join_hot, small_batches, table

BITS, RADIUS, SHINGLE = 64, 3, 3
#: Keys of more fingerprints than this are looked up with a byte of the other segment.
CROWDED = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at a time, which bounds a task's memory for long texts.
CHUNK = 50_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n, counts = max(1, len(words) - SHINGLE + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + SHINGLE - 1]
        grams = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(part) >= SHINGLE else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t) for t in b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fp long")


def _keys(radius: int) -> F.Column:
    """Keys (segment in bit 32, value below) of a fingerprint: itself, and with radius 1 all values one bit away."""
    low, high = "(fp & 4294967295)", "(shiftrightunsigned(fp, 32))"
    flips = [0] + [1 << i for i in range(32)] * radius
    each = chain(((f"({low} ^ {m}L)") for m in flips), ((f"(({high} ^ {m}L) + 4294967296L)") for m in flips))
    return F.expr(f"array({', '.join(each)})")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, named by their `rep`, at most RADIUS bits apart, whose classes are those of all such pairs.

    fps: fp, rep (distinct). Of a crowded key, the fingerprint of least rep is the pivot. Two fingerprints that are both near the
    pivot are linked through it, so of the pairs that meet under that key only those with the pivot are given: near copies that
    share a segment cost one link each, not one for each pair. A pair (p, t) left out at key k has t and the pivot v under k, where (v, t) is
    met; p and v are met under k or, if v comes first, under p's own key, whose pivot w stands for them in turn: (p, w) is
    met there, and (v, w) there or under k, either time with a pivot on the posted side. So no class falls apart.
    """
    posted = fps.select("fp", "rep", F.explode(_keys(0)).alias("key"))
    crowd = cut(posted.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "fp")).alias("pivot")).filter(F.col("n") > CROWDED).select("key", "pivot"))
    probes = fps.select("fp", "rep", F.explode(_keys(1)).alias("key"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = (F.col("t.rep") > F.col("p.rep")) & (apart("t.fp", "p.fp") <= RADIUS)
    plain = posted.join(crowd, "key", "left_anti").alias("t").join(probes.alias("p"), F.col("t.key") == F.col("p.key")).filter(near)
    # In a crowded key the other segment holds at most three differing bits, so at least one of its four bytes is equal.
    other = "if(key >= 4294967296L, fp & 4294967295, shiftrightunsigned(fp, 32))"
    byte = F.explode(F.expr("array(" + ", ".join(f"(shiftrightunsigned({other}, {8 * i}) & 255) + {256 * i}L" for i in range(4)) + ")")).alias("byte")
    finer_posted = posted.join(crowd, "key").select("fp", "rep", "key", F.col("pivot.rep").alias("first"), (apart("fp", "pivot.fp") <= RADIUS).alias("at_pivot"), F.col("pivot.fp").alias("pivot_fp"), byte)
    finer_probes = probes.join(crowd, "key", "left_semi").select("fp", "rep", "key", byte)
    both = F.col("t.at_pivot") & (apart("p.fp", "t.pivot_fp") <= RADIUS)
    needed = (F.col("t.rep") == F.col("t.first")) | (F.col("p.rep") == F.col("t.first")) | ~both
    dense = finer_posted.alias("t").join(finer_probes.alias("p"), (F.col("t.key") == F.col("p.key")) & (F.col("t.byte") == F.col("p.byte"))).filter(near & needed)
    pair = [F.col("p.rep").alias("a"), F.col("t.rep").alias("b")]
    return plain.select(*pair).unionByName(dense.select(*pair)).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    own = cut(fingerprints(docs))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # Fingerprints name themselves here, since texts that share a doc_id may share the least doc_id of their rows too.
    found = components(links(fps.select("fp", F.col("fp").alias("rep"))))
    member = cut(fps.join(found, fps.fp == found.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component")))
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    named = cut(join_hot(member, least, "component", "size", member.count()).select("fp", "n", "component_id"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(own, named, "fp", "n", total).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; rows without one give way to those with one."""
    rows, columns = identified(docs)
    stays = classes(rows.select("doc_id", "text")).filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return rows.join(stays, "doc_id", "left_semi").select(*columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
