"""Byte-level BPE encoding and decoding with a lexicon transducer.

The most frequent words of the corpus (counted over all of it) are compiled, with their token ids as outputs, into a
minimal acyclic automaton whose common prefixes and suffixes are shared. A state keeps how many words end in or below
it, so the words a path leaves behind on its left add up to the word's number, which finds its ids. The automaton is
one flat file that Spark hands to every executor and that workers map into memory. Words that it lacks are merged
exactly, by the merge ranks of the vocabulary.

Text is split as the vocabulary's byte-level pre-tokenizer does; the string of the end-of-text token is matched
first, as in the library. Distinct space-delimited chunks are looked up once in a task.

Defined cases: null counts as empty (no tokens, the hash of nothing); very long words are merged with a heap in
n log n steps; repeated rows are encoded each; an empty corpus has an empty lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, write_file

#: Frequent words that the lexicon holds, and how often a word must occur to get in.
LEXICON, LEAST = 300_000, 4
#: Chunks a task remembers before it starts anew, and chunks beyond this length that it never remembers.
REMEMBERED, LONGEST = 300_000, 200
#: Words longer than this are merged with a heap; of others, this many take a step at a time.
LONG, ROWS = 64, 16_384
#: No merge, and the bits of a token's id.
NONE, ID = 1 << 62, (1 << 20) - 1
#: The pre-tokenizer's pattern, a fixed value of the vocabulary.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space around a space, where chunks would part what the pattern keeps together.
KNIT = regex.compile(r"\s (?:\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, single bytes' ids, merge ranks by pair of ids, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        self.merges = {ids[a] << 20 | ids[b]: (rank << 20 | ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.singles = np.array(self.single, np.int64)
        self._index()

    def _index(self) -> None:
        """Arrays over the merges and over the tokens' bytes."""
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.fromiter(self.merges.values(), np.int64, len(keys))[order]
        length = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.letters, self.length, self.start = np.frombuffer(b"".join(self.bytes), np.uint8), length, np.cumsum(length) - length

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The ids from which merging starts, one for each item of the words."""
        return self.singles[np.frombuffer(b"".join(words), np.uint8)]

    def first(self, ranks: np.ndarray) -> np.ndarray:
        """Where the next merge of each row is: the least rank, leftmost."""
        return ranks.argmin(axis=1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers: always merge the pair of least rank, leftmost first.

        Words of like length take a step at a time: one row of ids each, and one row of the ranks of neighbours.
        """
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for lo, hi in ((0, 1), (1, 6), (6, 12), (12, 24), (24, LONG)):
            own = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(own), ROWS):
                self._merge_rows(own[k : k + ROWS], size, words, hi, out)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = np.array(self._merge_long(self.symbols([words[i]]).tolist()), "<u4").tobytes()
        return out

    def _merge_rows(self, own: np.ndarray, size: np.ndarray, words: list[bytes], width: int, out: list[bytes]) -> None:
        n, column = size[own], np.arange(width)
        ids = np.zeros((len(own), width), np.int64)
        ids[column < n[:, None]] = self.symbols([words[i] for i in own.tolist()])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pair = column[:-1] < (n - 1)[:, None]
        ranks = np.full((len(own), max(1, width - 1)), NONE)
        ranks[:, : width - 1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(own):
            at = self.first(ranks)
            best = ranks[np.arange(len(own)), at]
            stop = best == NONE
            if stop.any():
                done.append((own[stop], ids[stop], n[stop]))
                go = ~stop
                own, ids, n, ranks, at, best = own[go], ids[go], n[go], ranks[go], at[go], best[go]
                if not len(own):
                    break
            row = np.arange(len(own))
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), width - 1), axis=1)
            edge = column[: ranks.shape[1]]
            ranks = np.take_along_axis(ranks, np.minimum(edge + (edge >= at[:, None]), ranks.shape[1] - 1), axis=1)
            ids[row, at] = best & ID
            n = n - 1
            ranks[row, n - 1] = NONE
            for left in (at - 1, at):  # the pairs on either side of the merged one
                has = (left >= 0) & (left + 1 < n)
                r, c = row[has], left[has]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        for rows, found, length in done:
            flat = found[column < length[:, None]].astype("<u4").tobytes()
            at = 0
            for i, k in zip(rows.tolist(), length.tolist(), strict=True):
                out[i] = flat[at : at + 4 * k]
                at += 4 * k

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair in one number, NONE where the vocabulary does not merge it."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 20, i, m & ID, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := find(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (m >> 20, k, m & ID, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: list[bytes], outputs: list[bytes]) -> bytes:
    """The minimal acyclic automaton of the words (sorted, distinct) and their outputs (32-bit ids) as one file of 32-bit numbers."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)), in the order in which they are frozen
    path_nodes: list[list] = [[False, []]]  # the unfrozen path of the last word: [final, edges]
    last = b""

    def freeze(depth: int) -> None:
        while len(path_nodes) - 1 > depth:
            final, edges = path_nodes.pop()
            key = (final, tuple(edges))
            at = register.get(key)
            if at is None:
                at = register[key] = len(states)
                states.append(key)
            path_nodes[-1][1][-1] = (path_nodes[-1][1][-1][0], at)

    for w in words:
        common = len(os.path.commonprefix([w, last]))
        freeze(common)
        for b in w[common:]:
            path_nodes[-1][1].append((b, -1))
            path_nodes.append([False, []])
        path_nodes[-1][0] = True
        last = w
    freeze(0)
    states.append((path_nodes[0][0], tuple(path_nodes[0][1])))
    below: list[int] = []
    keys, targets, skipped = [], [], []
    for s, (final, edges) in enumerate(states):  # targets are frozen before their sources
        count = int(final)
        for b, t in edges:
            keys.append(s << 8 | b)
            targets.append(t)
            skipped.append(count)
            count += below[t]
        below.append(count)
    ends = np.cumsum([0] + [len(o) // 4 for o in outputs])
    flat = np.frombuffer(b"".join(outputs), "<i4")
    arrays = [np.array(a, np.int32) for a in (keys, targets, skipped, [f for f, _ in states], ends, flat)]
    return b"".join([np.array([len(a) for a in arrays] + [len(states) - 1, 0], np.int32).tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int32, "r").view(np.ndarray)  # still mapped, without memmap's costly slices
        sizes, at, parts = whole[:6].tolist(), 8, []
        for n in sizes:
            parts.append(whole[at : at + n])
            at += n
        self.keys, self.targets, self.skipped, self.final, self.ends, self.flat = parts
        self.root = int(whole[6])
        self.outputs = memoryview(self.flat).cast("B") if len(self.flat) else memoryview(b"")

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that the automaton lacks. All words take a step at a time."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max(initial=0))
        if not len(self.keys) or not width:
            return np.full(len(words), -1)
        start = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, number, live = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        for i in range(width):
            live = live[length[live] > i]
            if not len(live):
                break
            key = state[live] << 8 | raw[start[live] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            number[live] += self.skipped[at]
        return np.where((state >= 0) & (self.final[state] == 1), number, -1)


class Coder:
    """Encodes and decodes texts; remembers the chunks it has met. Ids are kept as little-endian 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.v, self.lexicon = vocabulary, lexicon
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, bytes] = {}  # what stands between spaces, the space before it included
        self.words: dict[str, bytes] = {}
        self.long = False

    def learn_words(self, words: set[str]) -> None:
        """Ids of words not met before: through the automaton, else by merging."""
        new = list(words.difference(self.words))
        self.long |= max(map(len, new), default=0) > LONGEST
        raw = [w.encode() for w in new]
        number = self.lexicon.find(raw) if self.lexicon and new else np.full(len(new), -1)
        if self.lexicon:
            ends, outputs = self.lexicon.ends, self.lexicon.outputs
            hit = np.flatnonzero(number >= 0)
            a, b = (4 * ends[number[hit]]).tolist(), (4 * ends[number[hit] + 1]).tolist()
            for i, x, y in zip(hit.tolist(), a, b, strict=True):
                self.words[new[i]] = bytes(outputs[x:y])
        miss = np.flatnonzero(number < 0).tolist()
        self.words.update(zip([new[i] for i in miss], self.v.merge([raw[i] for i in miss]), strict=True))

    def learn(self, chunks: set[str]) -> None:
        """Ids of chunks (given without the space before them) not met before."""
        new = list(chunks.difference(self.chunks))
        self.long |= max(map(len, new), default=0) > LONGEST
        # Letters alone are one word; str.isalpha knows no letter that the pattern does not.
        split = [(" " + c,) if c.isalpha() else SPLIT.findall(" " + c) for c in new]
        self.learn_words(set().union(*split))
        get = self.words.__getitem__
        self.chunks.update(zip(new, [get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split], strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.chunks) > REMEMBERED:
            self.forget()
        parts: list[list[tuple[str | list[str], str]]] = []  # of each text: (what, how it is looked up)
        chunks, words = [], []
        for t in texts:
            spans = self.special.split(t) if self.special and any(s in t for s in self.v.special) else [t]
            own = []
            for i, s in enumerate(spans):
                if i % 2:
                    own.append((s, "special"))
                elif KNIT.search(s):
                    own.append((SPLIT.findall(s), "words"))
                    words.append(own[-1][0])
                else:  # chunks whose splits, joined, are the text's split
                    first, *rest = s.split(" ")
                    head = SPLIT.findall(first)
                    own += [(head, "words"), (rest, "chunks")]
                    words.append(head)
                    chunks.append(rest)
            parts.append(own)
        self.learn(set().union(*chunks))
        self.learn_words(set().union(*words))
        of = {"words": self.words.__getitem__, "chunks": self.chunks.__getitem__}
        out = [b"".join([self.v.special[x].to_bytes(4, "little") if how == "special" else b"".join(map(of[how], x)) for x, how in p]) for p in parts]
        if self.long:
            self.forget()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the decoded text in UTF-8; what is no UTF-8 is replaced."""
        each = np.frombuffer(ids, "<u4")
        length = self.v.length[each]
        ends = np.cumsum(length)
        raw = self.v.letters[np.repeat(self.v.start[each] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def frequent_words(docs: DataFrame, n: int = LEXICON) -> list[str]:
    """The words (runs of letters, after a space) that occur most often in all documents; at most n."""
    each = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    counts = each.groupBy("w").count().filter(F.col("count") >= LEAST)
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(n).select("w").collect()]


def publish(spark: SparkSession, vocabulary: Vocabulary, words: list[str]) -> str:
    """Compile the lexicon into the shared folder and hand its file to all executors; returns its name there."""
    raw = sorted({(" " + w).encode() for w in words} | {w.encode() for w in words[: len(words) // 8]})
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = write_file(spark, name, compile_lexicon(raw, vocabulary.merge(raw)))
    spark.sparkContext.addFile(path)
    return name


#: Texts of a batch encoded together: at most this many characters (or one text).
TOGETHER = 2_000_000


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        t = t or ""
        if own and size + len(t) > TOGETHER:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def encode(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with full also ids and the decoded text."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(path)
    name = publish(spark, vocabulary, frequent_words(docs))
    held = spark.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value, Lexicon(SparkFiles.get(name)))
        for b in batches:
            rows, all_ids, all_texts = [], [], []
            for texts in groups(b.column("text").to_pylist()):
                for ids in coder.encode_batch(texts):
                    decoded = coder.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    if full:
                        all_ids.append(np.frombuffer(ids, "<i4"))
                        all_texts.append(decoded.decode())
            n, a, d = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if full:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)


def default_path() -> str:
    """The vocabulary's place here; a parameter everywhere else."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), default_path())
