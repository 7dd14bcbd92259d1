"""Token counts by a piece vocabulary (byte-pair merges of characters, with byte fallback), with a whole-token shortcut.

Before any text is read, two things are proven about the vocabulary by looking at all of it:

- which of its strings encode alone as one token (`Pieces.whole`), by merging every string of the vocabulary; and
- between which characters no merge can ever reach (`Pieces.joined` marks the other ones): where no piece of the
  vocabulary holds the two side by side, a text can be cut. No piece holds a space after another character, so texts
  are cut before every run of spaces first of all.

A text is cut into pre-tokens by the second, those that are in the first count as one token at once, and only the rest
is merged. What a space-delimited chunk counts is remembered within a task.

Defined cases: null counts as empty, and an empty text has no tokens; a text's own U+2581 is a space to the vocabulary;
very long chunks are cut as all others and merged with a heap in n log n steps, and are not remembered; repeated rows
and rows without a doc_id are counted each; an empty table gives an empty result; columns other than doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LONGEST, REMEMBERED, Vocabulary, groups
from .common import small_batches, table

#: How the vocabulary writes a space: a fixed value.
SPACE = "▁"
#: Runs of spaces with what follows them.
CELLS = regex.compile(r" +[^ ]*")
#: Tokens beyond which op11 marks a text.
LIMIT = 4096


class Pieces(Vocabulary):
    """Pieces, merge ranks by pair of ids, and what is proven of them. Equal scores merge leftmost first.

    A word is a str here, whose characters all are pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a\téﬁ Ａ é "
        if read.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only vocabularies that put a space first and leave texts else as they are")
        special = {i for i in range(read.vocab_size()) if read.is_control(i) or read.is_unknown(i) or read.is_unused(i)}
        octet = {i for i in range(read.vocab_size()) if read.is_byte(i)}
        pieces = {read.id_to_piece(i): i for i in range(read.vocab_size()) if i not in special | octet}
        if any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or len(octet) != 256:
            raise ValueError("only vocabularies with byte fallback whose pieces hold spaces at their start")
        self.special = {}
        self.pieces = pieces
        self.bytes = [read.id_to_piece(i).replace(SPACE, " ").encode() for i in range(read.vocab_size())]
        single = {}
        for i in octet:
            b = int(read.id_to_piece(i)[3:5], 16)
            self.bytes[i], single[b] = bytes([b]), i
        self.single = [single[b] for b in range(256)]
        rank = {s: k for k, s in enumerate(sorted({read.get_score(i) for i in pieces.values()}, reverse=True))}
        self.merges = {}
        for p, i in pieces.items():
            value = rank[read.get_score(i)] << 20 | i
            for k in range(1, len(p)):
                left, right = pieces.get(p[:k]), pieces.get(p[k:])
                if left is not None and right is not None:
                    self.merges[left << 20 | right] = value
        self._index()
        single = {ord(c): i for c, i in pieces.items() if len(c) == 1}
        self.id_of = np.full(0x110000, -1, np.int32)  # the symbol of each character
        self.id_of[list(single)] = list(single.values())
        pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        inner = {c: k + 1 for k, c in enumerate(sorted({ord(c) for p in pairs for c in p}))}
        self.kind = np.zeros(0x110000, np.int16)  # characters by their place in joined; 0: never joined
        self.kind[list(inner)] = list(inner.values())
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for x, y in pairs:
            self.joined[inner[ord(x)], inner[ord(y)]] = True
        alone = list(pieces)
        self.whole = {p: pieces[p].to_bytes(4, "little") for p, ids in zip(alone, self.merge(alone), strict=True) if len(ids) == 4}

    def symbols(self, words: list[str]) -> np.ndarray:
        return self.id_of[codes("".join(words))].astype(np.int64)

    def first(self, ranks: np.ndarray) -> np.ndarray:
        return (ranks >> 20).argmin(axis=1)

    def parts(self, cells: list[str]) -> tuple[list[str], np.ndarray]:
        """The cells, cut where no merge reaches, and where each cell's parts begin among them."""
        text = "".join(cells)
        kind = self.kind[codes(text)]
        start = np.cumsum([0, *map(len, cells)])
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        cut[start] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        return [text[i:j] for i, j in zip(ends, ends[1:], strict=False)], np.searchsorted(at, start[:-1])

    def encode(self, cells: list[str]) -> list[bytes]:
        """The ids of each cell (a run of spaces and what follows, not empty), as little-endian 32-bit numbers."""
        if not cells:
            return []
        parts, first = self.parts([c.replace(" ", SPACE) for c in cells])
        distinct = set(parts)
        rest = list(distinct.difference(self.whole))
        known = {p: self.whole[p] for p in distinct.difference(rest)}
        # A character that the vocabulary lacks is a part by itself: its bytes. All the others are merged.
        raw = [p for p in rest if len(p) == 1 and self.id_of[ord(p)] < 0]
        known.update((p, np.array([self.single[b] for b in p.encode()], "<u4").tobytes()) for p in raw)
        merged = [p for p in rest if p not in known]
        known.update(zip(merged, self.merge(merged), strict=True))
        ids, ends = list(map(known.__getitem__, parts)), [*first.tolist(), len(parts)]
        return [ids[i] if j - i == 1 else b"".join(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def chunks(text: str) -> list[str]:
    """The text, a space put before it, cut before every run of spaces; each chunk without its first space."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [c[1:] for c in CELLS.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    """Counts tokens; remembers the chunks it has met."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.n = {p[1:].replace(SPACE, " "): 1 for p in self.v.whole if p[0] == SPACE}
        self.seeded = len(self.n)

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        split = [chunks(t.replace(SPACE, " ")) for t in texts]
        new = list(set().union(*split).difference(self.n))
        self.n.update(zip(new, [len(ids) // 4 for ids in self.v.encode([" " + c for c in new])], strict=True))
        get = self.n.__getitem__
        out = [sum(map(get, s)) for s in split]
        for c in new:
            if len(c) > LONGEST:
                del self.n[c]
        if len(self.n) > self.seeded + REMEMBERED:
            self.forget()
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(Pieces(path))  # as large as the vocabulary, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(held.value)
        for b in batches:
            n = [k for texts in groups(b.column("text").to_pylist()) for k in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return own.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def default_path() -> str:
    """The vocabulary's place here; a parameter everywhere else."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), default_path())
