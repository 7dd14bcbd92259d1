"""Alignment of two tokenizers' tokens over the same bytes.

Each tokenizer's tokens and the bytes that they cover make an incidence matrix (tokens x bytes), laid out by hand in
compressed sparse rows. The product A x B^T, formed row by row after Gustavson, has an entry for every pair of an A and a
B token whose bytes overlap: the links. Bytes where a token of both ends part the text into groups; the product of the
two group incidences has an entry for every pair that shares a group.

Both tokenizers begin a token at a space after a character that is no white space, so texts are cut there, the products
are formed over the distinct chunks of a batch, and documents are put together from their chunks' rows. Texts are
tokenized once: each document's row, with its linked pairs of ids, goes to the shared folder. From there it is counted in
how many documents each pair is linked (pre-aggregated in each batch, then in Spark), and these counts are added up for
each document.

Counts of pairs go to the tasks as one mapped file while there are at most `MAPPED` pairs; beyond that each document's
pairs are joined to them by a shuffle. Both ways give the same rows.

Defined cases: null and empty texts, and texts whose joined token bytes are not a space and the text (such as those with
U+2581, which B takes for a space), have no tokens: zeros and an empty digest. Very long texts are cut like others; a
very long chunk is merged with a heap and not remembered. Repeated rows count as documents of their own, with or without
a doc_id. Ties for an A id's highest count are all best. An empty table gives an empty result. Columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pieces
from .bpe import LONGEST, SPLIT, Vocabulary, groups
from .common import cut, join_hot, shared_dir, small_batches, table, write_file
from .pieces import SPACE, Pieces

#: Pairs of ids whose counts go to the tasks as a file: 12 bytes each.
MAPPED = 4_000_000
#: Chunks a task remembers before it starts anew.
REMEMBERED = 450_000
#: A space after other white space, or first: there the text needs a closer look.
CLOSE = regex.compile(r"\s ")
#: Where both tokenizers begin a token in any case.
BOTH = regex.compile(r"(?<=\S)(?= )")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row i has columns[start[i]:start[i + 1]] with values at the same places."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def incidence(lengths: np.ndarray) -> Rows:
    """Tokens x bytes, for tokens of these lengths one after another."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int64))


def transposed_incidence(lengths: np.ndarray) -> Rows:
    """Bytes x tokens."""
    n = int(lengths.sum())
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64))


def membership(group: np.ndarray) -> Rows:
    """Tokens x groups, for tokens in these groups."""
    return Rows(np.arange(len(group) + 1), group, np.ones(len(group), np.int64))


def transposed_membership(group: np.ndarray, n_groups: int) -> Rows:
    """Groups x tokens, for tokens in these (ascending) groups."""
    return Rows(np.searchsorted(group, np.arange(n_groups + 1)), np.arange(len(group)), np.ones(len(group), np.int64))


def product(left: Rows, right: Rows, n_columns: int) -> Rows:
    """left x right after Gustavson: row i is the sum of right's rows k, weighted by left[i, k], over left's entries of row i."""
    times = right.start[left.columns + 1] - right.start[left.columns]  # entries that each entry of left brings along
    entry = np.repeat(np.arange(len(left.columns)), times)
    at = right.start[left.columns][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    row = np.repeat(np.arange(len(left.start) - 1), np.diff(left.start))[entry]
    key = row * n_columns + right.columns[at]
    value = left.values[entry] * right.values[at]
    if (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    value = np.add.reduceat(value, first) if len(first) else value
    return Rows(np.searchsorted(key, np.arange(len(left.start)) * n_columns), key % max(1, n_columns), value)


class Chunks(NamedTuple):
    """Some chunks' tokens, links and groups, each laid out one chunk after another, and where each chunk begins in them."""

    a: np.ndarray
    b: np.ndarray
    links: Rows
    shared: Rows
    groups: str  # as in groups_sha256, but with a semicolon after each group
    at_a: np.ndarray
    at_b: np.ndarray
    at_link: np.ndarray
    at_group: np.ndarray
    at_text: np.ndarray


class Pair:
    """The two vocabularies, and how their ids are written in groups."""

    def __init__(self, a: Vocabulary, b: Pieces):
        self.a, self.b = a, b
        # An id and what follows it: another one of its group, or (A) the group's B ids, or (B) the next group.
        self.written = [f"{i}{end}" for vocabulary, last in ((a, "|"), (b, ";")) for i in range(len(vocabulary.bytes)) for end in (",", last)]
        self.width = np.fromiter(map(len, self.written), np.int64, len(self.written))

    def align(self, cells: list[str]) -> Chunks:
        """The tokens, links and groups of each cell, none of which is empty or holds U+2581."""
        a, b = self.a, self.b
        # Letters alone are one word; str.isalpha knows no letter that the pattern does not.
        words = [[c] if c[1:].isalpha() else SPLIT.findall(c) for c in cells]
        each = list(set().union(*words))
        ids = dict(zip(each, a.merge([w.encode() for w in each]), strict=True))
        own_a, own_b = [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in words], b.encode(cells)
        at_a, at_b = (np.cumsum([0, *map(len, own)]) // 4 for own in (own_a, own_b))
        all_a, all_b = (np.frombuffer(b"".join(own), "<u4").astype(np.int64) for own in (own_a, own_b))
        length_a, length_b = a.length[all_a], b.length[all_b]
        if length_a.sum() != length_b.sum():
            raise ValueError("the tokenizers disagree about the bytes of a text")
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        overlap = product(incidence(length_a), transposed_incidence(length_b), len(all_b))
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        shared = product(membership(group_a), transposed_membership(group_b, len(ends)), len(all_b))
        at_group = np.append(group_a, len(ends))[at_a]
        # A's tokens are the first entries of `written`, two for each id.
        last_a, last_b = (np.diff(g, append=len(ends)) != 0 for g in (group_a, group_b))
        items = np.concatenate([2 * all_a + last_a, 2 * len(a.bytes) + 2 * all_b + last_b])
        items = items[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        at_text = np.concatenate([[0], np.cumsum(self.width[items])])[at_a + at_b]
        text = "".join(map(self.written.__getitem__, items.tolist()))
        return Chunks(all_a, all_b, overlap, shared, text, at_a, at_b, overlap.start[at_a], at_group, at_text)


def rows_of(m: Rows) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on for size[0] places, then the same for the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def cells_of(text: str | None) -> list[str]:
    """A space and the text, cut where both tokenizers begin a token; nothing for a text without tokens."""
    if not text or SPACE in text:
        return []
    text = " " + text
    if CLOSE.search(text):
        return BOTH.split(text)
    return [" " + c for c in text[1:].split(" ")]


class Aligner:
    """Aligns texts; remembers the cells it has met."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}  # a cell's place in the following
        self.text: list[str] = []
        self.n = np.zeros((0, 4), np.int64)  # A and B tokens, groups, links
        self.links = np.zeros(0, np.int64)  # pairs of ids
        self.first = np.zeros(0, np.int64)  # where a cell's begin
        self.long = False

    def meet(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the texts' cells, and where each text begins among them."""
        if self.long or len(self.at) > REMEMBERED:
            self.forget()
        split = [cells_of(t) for t in texts]
        new = list(set().union(*split).difference(self.at))
        if new:
            self.learn(new)
        size = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, size.sum()), np.cumsum(size) - size

    def learn(self, new: list[str]) -> None:
        got = self.pair.align(new)
        links = got.a[rows_of(got.links)] * len(self.pair.b.bytes) + got.b[got.links.columns]
        self.first, self.links = np.concatenate([self.first, len(self.links) + got.at_link[:-1]]), np.concatenate([self.links, links])
        self.n = np.concatenate([self.n, np.column_stack([np.diff(x) for x in (got.at_a, got.at_b, got.at_group, got.at_link)])])
        self.at.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        at = got.at_text.tolist()
        self.text += [got.groups[i:j] for i, j in zip(at, at[1:], strict=False)]
        self.long |= max(map(len, new)) > LONGEST

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups and n_links, and its groups_sha256; its linked pairs of ids, where each text's end, and how often each is linked."""
        cell, first = self.meet(texts)
        size = np.diff(first, append=len(cell))
        n = np.zeros((len(texts), 4), np.int64)
        if len(cell):
            n[size > 0] = np.add.reduceat(self.n[cell], first[size > 0])
        each, get = cell.tolist(), self.text.__getitem__
        spans = zip(first.tolist(), (first + size).tolist(), strict=True)
        digests = [hashlib.sha256("".join(map(get, each[i:j]))[:-1].encode()).hexdigest() if j > i else "" for i, j in spans]
        return n, digests, *self._pairs(np.repeat(np.arange(len(texts)), size), cell, len(texts))

    def _pairs(self, text: np.ndarray, cell: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = max(1, len(self.text))
        key, times = np.unique(text * known + cell, return_counts=True)
        text, cell = np.divmod(key, known)
        size = self.n[cell, 3]
        bits = (len(self.pair.a.bytes) * len(self.pair.b.bytes)).bit_length()
        key, times = np.repeat(text << bits, size) | self.links[spread(self.first[cell], size)], np.repeat(times, size)
        order = np.argsort(key)
        key, times = key[order], times[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, new) if len(new) else times
        ends = np.searchsorted(key[new], np.arange(n_texts + 1) << bits)
        return key[new] & ((1 << bits) - 1), ends, times


def links(text: str, pair: Pair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """One text's overlap links (place among A's tokens, among B's, bytes shared) and shared-group links (places)."""
    got = pair.align(cells_of(text))
    overlap = zip(rows_of(got.links).tolist(), got.links.columns.tolist(), got.links.values.tolist(), strict=True)
    return list(overlap), list(zip(rows_of(got.shared).tolist(), got.shared.columns.tolist(), strict=True))


def tokenized(docs: DataFrame, held: Broadcast) -> DataFrame:
    """ALIGNED for every row of docs: its numbers and digest, and its linked pairs of ids with how often each is linked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            for own in groups(texts):
                n, digests, pairs, ends, times = aligner.rows(own)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                columns = [batch.column("doc_id").slice(at, len(own)), *map(pa.array, n.T.copy()), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in ALIGNED.split(", ")])
                at += len(own)

    return docs.mapInArrow(each, ALIGNED)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of the A id has a higher n)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = cut(aligned.select("pairs").mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    own = F.expr(f"pair div {size_b}")
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))  # at most as many rows as A has ids
    return counts.withColumn("a", own).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def mapped(spark: SparkSession, counts: DataFrame) -> str:
    """Write the counts (bounded by MAPPED) as one file for all executors; returns its name there."""
    got = counts.toArrow().sort_by("pair")
    name = f"pairs-{uuid.uuid4().hex[:12]}.bin"
    columns = (got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy().astype(np.int64))
    path = write_file(spark, name, b"".join([np.array([len(got)]).tobytes(), *(c.astype(np.int64).tobytes() for c in columns)]))
    spark.sparkContext.addFile(path)
    return name


def alignment(docs: DataFrame, a_path: str, b_path: str, max_mapped: int = MAPPED) -> DataFrame:
    """Per row of docs: its numbers of tokens, groups and links, how its links count over all docs, and a digest of its groups.

    Texts are tokenized once; their rows lie in the shared folder while pairs are counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pair = Pair(Vocabulary(a_path), Pieces(b_path))
    held = spark.sparkContext.broadcast(pair)  # as large as the vocabularies
    at = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex[:12]}"
    tokenized(docs.select(F.col("doc_id").cast("long"), "text"), held).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)
    aligned = spark.read.parquet(at)
    counts = cut(pair_counts(aligned, len(pair.b.bytes)))
    if counts.count() > max_mapped:
        return _joined(aligned, counts)
    name = mapped(spark, counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.memmap(SparkFiles.get(name), np.int64, "r").view(np.ndarray)
        n = int(whole[0])
        known, count, best = whole[1 : n + 1], whole[n + 1 : 2 * n + 1], whole[2 * n + 1 :]
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            place = np.searchsorted(known, pairs)
            size = batch.column("pairs").value_lengths().to_numpy()
            first = np.cumsum(size) - size
            sums = np.zeros((2, len(size)), np.int64)
            if len(pairs):
                sums[:, size > 0] = np.add.reduceat(np.stack([best[place] * times, count[place] * times]), first[size > 0], axis=1)
            kept = [batch.column(c) for c in RESULT_NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1]), batch.column("groups_sha256")], RESULT_NAMES)

    return aligned.drop("row").mapInArrow(each, RESULT)


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The result, with the counts joined to each document's pairs."""
    each_pair = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # as many rows as each_pair has
    met = join_hot(each_pair, counts, "pair", "n", total)
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    out = aligned.drop("pairs", "times").join(sums, "row", "left").withColumns({"n_best": F.coalesce("best", F.lit(0)), "count_sum": F.coalesce("total", F.lit(0))})
    return out.select(*RESULT_NAMES)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents", "doc_id", "text"), bpe.default_path(), pieces.default_path())
