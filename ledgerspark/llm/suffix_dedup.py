"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a LENGTH-byte string over it also starts earlier (in a smaller doc_id, or earlier in the same
document). Suffixes are judged by their first LENGTH bytes, never across documents, in three steps over one layout:
documents are dealt to blocks of bounded size by a hash of doc_id.

1. Cover sample. D is a difference cover modulo V: any two positions have a common shift below V that puts both on
   sampled positions. So two equal strings always hold two sampled suffixes, at the same shift, whose first
   LENGTH - V + 1 bytes lie inside the strings and are equal. Sampled suffixes are sorted by (a hash of) that prefix,
   one bucket at a time, and ranked as single or shared. Only strings with a shared sample can repeat; the rest of the
   corpus goes no further. Shared ranks thus settle most suffixes without their text leaving its block.
2. Suffix buckets. What remains is first sorted within its block, where all but the first of equal strings are
   settled, so that a passage in a third of all documents is sent once from a block, not once from a document. The
   first ones go to suffix buckets: a string belongs to the bucket of the least-hashed PREFIX bytes in its head, which
   depends on nothing but the string, and neighbouring strings with the same head travel together as one piece of
   text. Each bucket is sorted by a 64-bit key of all LENGTH bytes; ties are compared byte by byte.
3. Each block cuts the settled strings out of its documents.

Suffixes are thus ordered by hashes of their heads, not by their letters, and a tie between equal hashes is settled by the
bytes themselves; ranks of the cover sample decide which strings are ordered at all.

All steps handle packed arrays (a row is a block's share of a bucket), so memory is bounded by a block or a bucket,
whose numbers follow from the bytes of the input.

Defined cases: an empty table gives no rows; a very long text makes its block as large as itself (some 40 bytes of memory a
byte); other columns do not matter; null counts as empty; texts under LENGTH bytes lose nothing; doc_ids are taken as unique (rows that
share one count as one after the other, in the order of their blocks and texts, and each gets the document's row); rows without
a doc_id come after all others, and get their rows back without one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A perfect difference set, a fixed value: every residue modulo V is a difference of two members in one way.
V, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
LENGTH = 100
PREFIX = LENGTH - V + 1
#: What rows without a doc_id are ordered by: they come last.
LAST = (1 << 63) - 1
#: Bytes of text of a block; sampled suffixes of a bucket follow from it.
BLOCK_BYTES = 4 << 20
IN_COVER = np.isin(np.arange(V), COVER)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def words_at(buffer: bytes) -> np.ndarray:
    """The eight bytes at each position, as unaligned numbers."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, 0, (1,))


#: Positions handled at a time, so that what is between stays in a core's cache.
AT_ONCE = 1 << 14
OFFSETS = (*range(0, LENGTH - 8, 8), LENGTH - 8)


def in_parts(f, dtype, *arrays: np.ndarray) -> np.ndarray:
    """f of the arrays, some thousand members at a time."""
    out = np.empty(len(arrays[0]), dtype)
    for k in range(0, len(out), AT_ONCE):
        out[k : k + AT_ONCE] = f(*(a[k : k + AT_ONCE] for a in arrays))
    return out


def prefix_keys(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of the PREFIX bytes at each of the positions."""

    def keys(at):
        h = w[at] * _ODD[0]
        for k, o in ((1, 8), (2, 16), (0, PREFIX - 8)):
            h = mix(h + w[at + o] * _ODD[k])
        return h

    return in_parts(keys, np.uint64, at)


def string_keys(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of the LENGTH bytes at each of the positions."""

    def keys(at):
        h = w[at] * _ODD[1]
        for k, o in enumerate(OFFSETS[1:]):
            h = (h ^ w[at + o]) * _ODD[k % 3]
            if k % 2:
                h ^= h >> np.uint64(31)
        return mix(h)

    return in_parts(keys, np.uint64, at)


def equal_strings(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at a and at b are the same."""

    def same(a, b):
        differ = w[a] ^ w[b]
        for o in OFFSETS[1:]:
            differ |= w[a + o] ^ w[b + o]
        return differ == 0

    return in_parts(same, bool, a, b)


def repeats(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For positions in order of occurrence: whether an earlier one holds the same LENGTH bytes."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    keys = string_keys(w, at)
    order = np.argsort(keys)
    ranked = keys[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    begin = np.flatnonzero(head)
    if len(begin) == len(keys):
        return out
    first = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.r_[begin, len(keys)]))  # of the run each stands in
    tied = order != first
    a, b = at[order[tied]], at[first[tied]]
    same = equal_strings(w, a, b)
    out[order[tied]] = same
    if not same.all():  # equal keys of different strings: compare those runs by their bytes
        runs = np.cumsum(head) - 1
        for r in np.unique(runs[tied][~same]):
            seen: set[bytes] = set()
            for i in np.sort(order[runs == r]):
                text = b"".join(w[at[i] + o].tobytes() for o in OFFSETS)
                out[i] = text in seen
                seen.add(text)
    return out


class Block:
    """The documents of a block, end to end, in the order of doc_id."""

    def __init__(self, rows: pd.DataFrame):
        texts = [(t or "").encode() for t in rows["text"]]
        ids = rows["doc_id"].to_numpy(np.int64)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts, self.known = ids[order], [texts[i] for i in order], rows["known"].to_numpy(bool)[order]
        self.size = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.start = np.cumsum(self.size) - self.size
        self.buffer = b"".join(self.texts) + bytes(8)
        self.w, self.n = words_at(self.buffer), int(self.size.sum())

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position: its place in its document, and the bytes from it to the document's end."""
        place = (np.arange(self.n, dtype=np.int64) - np.repeat(self.start, self.size)).astype(np.int32)
        return place, (np.repeat(self.size, self.size) - place).astype(np.int32)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose prefix is whole, in order, and their keys."""
        place, left = self.place()
        at = np.flatnonzero(IN_COVER[place % V] & (left >= PREFIX) & (place + left >= LENGTH))
        return at, prefix_keys(self.w, at)


def pack(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    """Arrays of one length by byte planes, then data, compressed."""
    head = np.array([len(arrays), len(arrays[0]), *(a.dtype.itemsize for a in arrays)], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes + data)


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw, np.int64, 2)
    sizes, at, out = np.frombuffer(raw, np.int64, k, 16), 16 + 8 * k, []
    for s in sizes:
        planes = np.frombuffer(raw, np.uint8, s * n, at).reshape(s, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{s}").ravel())
        at += s * n
    return out, raw[at:]


def steps(at: np.ndarray) -> np.ndarray:
    """Increasing numbers as differences."""
    return np.diff(at, prepend=0).astype(np.uint32)


def split_by(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, from, to) of each that occurs."""
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, int)
    return order, list(zip(ranked[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranked)], strict=True)) if len(ranked) else []


def sample_block(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 1, in a block: each distinct key of its sample once, by bucket: 40 bits of the key and the sample's number."""
    at, keys = Block(rows).samples()
    keys, number = np.unique(keys, return_index=True)
    number, keys = (lambda o: (number[o], keys[o]))(np.argsort(number))
    order, parts = split_by((keys % np.uint64(buckets)).astype(np.int64))
    rest = keys // np.uint64(buckets)
    block, out = int(rows["block"].iloc[0]), []
    for bucket, a, b in parts:
        own = order[a:b]
        out.append((bucket, block, pack((rest[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((rest[own] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8), steps(number[own]))))
    return pd.DataFrame(out, columns=["bucket", "block", "data"])


def rank_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 1, in a bucket: to each block the numbers of its samples that another block has too."""
    keys, numbers, owner = [], [], []
    for k, data in enumerate(rows["data"]):
        (low, high, number), _ = unpack(data)
        keys.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        numbers.append(np.cumsum(number, dtype=np.int64))
        owner.append(np.full(len(low), k, np.int32))
    keys, numbers, owner = map(np.concatenate, (keys, numbers, owner))
    order = np.argsort(keys)
    ranked = keys[order]
    tie = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(keys), bool)
    shared[order] = np.r_[tie, False] | np.r_[False, tie]
    out, cuts = [], np.searchsorted(owner[shared], np.arange(len(rows) + 1))
    found = numbers[shared]
    for k, block in enumerate(rows["block"]):
        if cuts[k] < cuts[k + 1]:
            out.append((int(block), pack(steps(found[cuts[k] : cuts[k + 1]]))))
    return pd.DataFrame(out, columns=["block", "data"])


def heads(keys: np.ndarray, most: int = 1 << 28) -> np.ndarray:
    """For each position the place of the least key among the V from it on, the leftmost on ties; `most` places, which 28 bits hold, at a time."""
    if len(keys) > most:
        step = most - V
        return np.concatenate([heads(keys[k : k + most], most)[: step if k + most < len(keys) else None] + k for k in range(0, len(keys) - V, step)])
    least = (keys & ~np.uint64(0xFFFFFFF)) | np.arange(len(keys), dtype=np.uint64)
    whole, width = least, 1
    while width * 2 <= V:
        least = np.minimum(least, np.r_[least[width:], np.full(width, ~np.uint64(0))][: len(least)])
        width *= 2
    rest = V - width
    least = np.minimum(least, np.r_[least[rest:], np.full(rest, ~np.uint64(0))][: len(whole)])
    return (least & np.uint64(0xFFFFFFF)).astype(np.int64)


def pieces(rows: pd.DataFrame, ranks: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 2, in a block: settle repeats within it; send its first strings to their buckets.

    A row without text (bucket chosen by block) carries what the block has settled itself.
    """
    block, b = int(rows["block"].iloc[0]), Block(rows)
    at, keys = b.samples()
    shared = np.zeros(len(at), bool)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    for data in ranks["data"]:
        (number,), _ = unpack(data)
        shared[np.cumsum(number, dtype=np.int64)] = True
    hit = np.zeros(len(count), bool)
    hit[back[shared]] = True
    marks = np.zeros(b.n + V + 1, np.int32)
    marks[at[hit[back] | (count > 1)[back]] + 1] = 1
    below = np.cumsum(marks)
    _, left = b.place()
    string = np.flatnonzero((below[V : V + b.n] > below[: b.n]) & (left >= LENGTH))
    none = pd.DataFrame({"bucket": [], "block": [], "own": [], "data": []}).astype({"bucket": "int64", "block": "int64", "own": "bool", "data": "object"})
    if not len(string):
        return none
    again = repeats(b.w, string)
    out = []
    if again.any():
        out.append((block % buckets, block, True, spans(string[again])))
    first = string[~again]
    if len(first):
        need = np.zeros(b.n + V + 1, np.int8)  # positions whose prefix may be a head: V from each string on
        need[first] += 1
        need[first + V] -= 1
        place = np.flatnonzero(np.cumsum(need[: b.n]) > 0)
        h = np.full(b.n, ~np.uint64(0))
        h[place] = prefix_keys(b.w, place)
        head = np.empty(len(first), np.int64)
        for lo, hi in chunks(first):
            a, z = first[lo], first[hi - 1] + V
            head[lo:hi] = heads(h[a:z])[first[lo:hi] - a] + a
        new = np.r_[True, (np.diff(first) != 1) | (np.diff(head) != 0)]
        begin = np.flatnonzero(new)
        n_strings = np.diff(np.r_[begin, len(first)])
        start, key = first[begin], h[head[begin]]
        doc = np.searchsorted(b.start, start, side="right") - 1
        order, parts = split_by((mix(key) % np.uint64(buckets)).astype(np.int64))
        ids = b.ids[doc]
        for bucket, lo, hi in parts:
            own = order[lo:hi]
            text = b"".join(b.buffer[s : s + n + LENGTH - 1] for s, n in zip(start[own].tolist(), n_strings[own].tolist(), strict=True))
            out.append((bucket, block, False, pack(ids[own], start[own].astype(np.uint32), n_strings[own].astype(np.uint8), data=text)))
    return pd.DataFrame(out, columns=["bucket", "block", "own", "data"])


def chunks(first: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring strings that lie close together, so that heads are sought only where strings are."""
    cuts = np.flatnonzero(np.diff(first) > 4096) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True))


def spans(at: np.ndarray) -> bytes:
    """Packed begins and ends of the maximal runs covered by the strings at the positions (increasing)."""
    new = np.r_[True, np.diff(at) > LENGTH]
    begin = at[new]
    end = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + LENGTH
    return pack(begin.astype(np.uint32), end.astype(np.uint32))


def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 2, in a bucket: to each block the runs of its strings that occurred earlier in another block."""
    done = rows[rows["own"]][["block", "data"]]
    rows = rows[~rows["own"]]
    if not len(rows):
        return done
    parts = [unpack(d) for d in rows["data"]]
    ids, start, n = (np.concatenate([p[0][k] for p in parts]) for k in range(3))
    n = n.astype(np.int64)
    block = np.repeat(rows["block"].to_numpy(np.int64), [len(p[0][0]) for p in parts])
    buffer = b"".join(p[1] for p in parts) + bytes(8)
    at = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    order = np.lexsort((start, block, ids.view(np.int64)))  # pieces in order of occurrence; a document lies in one block
    n, at, start, block = n[order], at[order], start[order].astype(np.int64), block[order]
    piece = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    again = repeats(words_at(buffer), at[piece] + inside)
    block, where = block[piece[again]], start[piece[again]] + inside[again]
    order = np.lexsort((where, block))
    block, where = block[order], where[order]
    own, cuts = np.unique(block, return_index=True)
    found = [(int(x), spans(w)) for x, w in zip(own, np.split(where, cuts[1:]), strict=True)] if len(own) else []
    return pd.concat([done, pd.DataFrame(found, columns=["block", "data"])])


def cut_block(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Step 3: what is left of a block's documents."""
    b = Block(rows)
    edge = np.zeros(b.n + 1, np.int32)
    for data in found["data"]:
        (begin, end), _ = unpack(data)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
    gone = np.cumsum(edge[: b.n]) > 0
    raw = np.frombuffer(b.buffer, np.uint8, b.n)
    out = []
    for k, (s, n) in enumerate(zip(b.start.tolist(), b.size.tolist(), strict=True)):
        g = gone[s : s + n]
        removed = int(g.sum())
        runs = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0
        kept = raw[s : s + n][~g].tobytes() if removed else b.texts[k]
        out.append((int(b.ids[k]), bool(b.known[k]), n, removed, runs, kept))
    return pd.DataFrame(out, columns=["doc_id", "known", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    buckets = blocks
    doc_id = F.col("doc_id").cast("long")
    block = F.pmod(F.when(doc_id.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(doc_id)), F.lit(blocks))
    own = docs.select(block.alias("block"), F.coalesce(doc_id, F.lit(LAST)).alias("doc_id"), doc_id.isNotNull().alias("known"), "text")
    # All three steps read the same shuffled layout, which Spark makes once.
    sample = own.groupBy("block").applyInPandas(lambda r: sample_block(r, buckets), "bucket long, block long, data binary")
    ranks = sample.groupBy("bucket").applyInPandas(rank_bucket, "block long, data binary")
    sent = own.groupBy("block").cogroup(ranks.groupBy("block")).applyInPandas(
        lambda r, k: pieces(r, k, buckets) if len(r) else NOTHING.copy(), "bucket long, block long, own boolean, data binary"
    )
    found = sent.groupBy("bucket").applyInPandas(sort_bucket, "block long, data binary")
    out = own.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        lambda r, f: cut_block(r, f), "doc_id long, known boolean, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


NOTHING = pd.DataFrame({"bucket": pd.Series(dtype="int64"), "block": pd.Series(dtype="int64"), "own": pd.Series(dtype="bool"), "data": pd.Series(dtype="object")})


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same by a set of all strings met so far; for tests."""
    seen: set[bytes] = set()
    out = []
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
