"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a hashed-word vector and, for either length of GRAMS, the mean of its hashed character (UTF-8 byte) n-gram vectors. Texts are cut into
windows of WINDOW words that overlap by half (the last one ends with the text), every window is scored, and a text's
score is that of its most toxic window. A run without white space of more than LONG bytes (scripts written without spaces, words
joined by commas or slashes) is no single word: it is split after punctuation, and what is still long into overlapping pieces.
Training is on at most about 3 x PER_CLASS labelled rows outside the held-out fold, and looks at all their windows: in each of
TURNS turns every window is scored (first by its words' log-odds), and the text's label falls on its most toxic window (for
clean texts on the WORST most toxic ones).

Defined cases: null, empty and blank texts have one window of padding only, which scores as the network scores
nothing; without labelled rows of both classes every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .sampling import held_out, labelled

PER_CLASS, THRESHOLD = 1_500, 0.5
#: The threshold is chosen on scores of networks fitted without the row's fold, for this share of toxic texts and loss of clean ones.
FOLDS, TOXIC_SHARE, CLEAN_LOSS = 3, 0.1, 0.05
WINDOW, STEP = 32, 16
HIDDEN, EMBED, WORDS = 8, 8, 1 << 14
#: Table sizes by the length of character n-grams: short ones meet all words, long ones tell stems and endings apart.
GRAMS = {3: 1 << 11, 5: 1 << 13}
WIDTH = (1 + len(GRAMS)) * EMBED
TURNS, EPOCHS, WORST, BATCH, STEPS, RATE, SEED = 3, 4, 2, 256, 16, 0.01, 11
#: Words of fewer sample texts than this have no vector of their own (only their n-grams'), at any size of the sample.
SEEN_IN = 3
#: Windows scored at a time; bounds a task's memory.
AT_ONCE = 4096
#: Distinct words whose inputs a task keeps; beyond, it starts anew.
KEPT_WORDS = 150_000
#: Words whose inputs are computed at a time.
WORDS_AT_ONCE = 20_000
#: Runs of more bytes than this are split; pieces of what punctuation leaves long have PIECE characters and overlap by half.
LONG, PIECE = 38, 12
_EDGES = ".,;:!?|#$%&*\"'()[]{}<>-_=+/0123456789"


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1 of every i, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def bare(word: str) -> bytes:
    """A word without case or outer punctuation, its ends marked, padded to the longest n-gram."""
    return f"<{word.lower().strip(_EDGES) or word}>".encode().ljust(max(GRAMS), b"\0")


def ngrams(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of the n-grams of all words, one word after another, and how many each word has."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    letters, h = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.uint32(0)
    for i in range(n):
        h = h * np.uint32(0x01000193) + letters[i : len(letters) - n + 1 + i] + np.uint32(1)
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(8)
    return h[spread(np.cumsum(size) - size, size - n + 1)].astype(np.int64) % GRAMS[n], size - n + 1


def all_ngrams(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """ngrams of many words, kept small, some words at a time."""
    parts = [ngrams(raw[k : k + WORDS_AT_ONCE], n) for k in range(0, len(raw), WORDS_AT_ONCE)]
    return np.concatenate([flat.astype(np.uint16) for flat, _ in parts]), np.concatenate([size for _, size in parts])


@cache
def separates(c: str) -> bool:
    return unicodedata.category(c)[0] in "PSZ"


def pieces(run: str) -> list[str]:
    """A long run: split after punctuation, then into overlapping pieces; every character is in one of them at least."""
    cuts = [0, *(i for i in range(1, len(run)) if separates(run[i - 1]) and not separates(run[i])), len(run)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi - lo <= PIECE or len(run[lo:hi].encode()) <= LONG:
            out.append(run[lo:hi])
        else:
            out += [run[k : k + PIECE] for k in range(lo, hi - PIECE, PIECE // 2)] + [run[hi - PIECE : hi]]
    return out


def words(text: str) -> list[str]:
    runs = text.split()
    if not any(4 * len(w) > LONG and len(w.encode()) > LONG for w in set(runs)):
        return runs
    return [p for w in runs for p in (pieces(w) if len(w.encode()) > LONG else (w,))]


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words start."""
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW, STEP))
    return out + [n - WINDOW]


class Vocabulary:
    """Distinct words met so far: ids, word hashes, letters. Word 0 is padding."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}
        self.word, self.raw = [0], [bare("")]

    def encode(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
            raw = bare(w)
            self.word.append(1 + zlib.crc32(raw) % (WORDS - 1))
            self.raw.append(raw)
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        f = lambda *s, k=1.0: rng.normal(0, k / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"word": rng.normal(0, 0.1, (WORDS, EMBED)).astype(np.float32)} | {f"gram{n}": rng.normal(0, 0.1, (size, EMBED)).astype(np.float32) for n, size in GRAMS.items()}
        self.common = np.zeros(WORDS, bool)
        for d in "fb":
            self.p |= {f"w{d}": f(WIDTH, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"q": f(2 * HIDDEN), "o": f(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}
        self.shift, self.trained, self.kept = 0.0, False, None

    def inputs(self, word: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """A vector for each word: its own and the means of its n-grams'."""
        out = np.empty((len(word), WIDTH), np.float32)
        out[:, :EMBED] = self.p["word"][word]
        self._grams = []
        for j, n in enumerate(GRAMS):
            flat, count = ngrams(raw, n)
            out[:, (1 + j) * EMBED : (2 + j) * EMBED] = np.add.reduceat(self.p[f"gram{n}"][flat], np.cumsum(count) - count) / count[:, None]
            self._grams.append((flat, count))
        return out

    def run(self, d: str, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (time, window, HIDDEN) in one direction. x: gate inputs by word; at: word of (time, window)."""
        steps, b = at.shape
        u, h = self.p[f"u{d}"], np.zeros((b, HIDDEN), np.float32)
        out, saved = np.empty((steps, b, HIDDEN), np.float32), [None] * steps
        whole = mask.all(axis=1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, gh = x[at[t]], h @ u
            rz = sigmoid(g[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not whole[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved[t] = (h, rz, n, gh[:, 2 * HIDDEN :])
            h = out[t] = new
        return (out, saved) if keep else out

    def gates(self, inputs: np.ndarray, d: str) -> np.ndarray:
        return inputs @ self.p[f"w{d}"] + self.p[f"c{d}"]

    def word_gates(self, vocabulary: Vocabulary, first: int = 0) -> dict[str, np.ndarray]:
        """Gate inputs of both directions for the words from number `first` on."""
        n = len(vocabulary.word)
        out = {d: np.empty((n - first, 3 * HIDDEN), np.float32) for d in "fb"}
        for k in range(first, n, WORDS_AT_ONCE):
            x = self.inputs(np.array(vocabulary.word[k : k + WORDS_AT_ONCE]), vocabulary.raw[k : k + WORDS_AT_ONCE])
            for d in "fb":
                out[d][k - first : k - first + len(x)] = self.gates(x, d)
        self._grams = None
        return out

    def pooled(self, f: np.ndarray, b: np.ndarray, mask: np.ndarray):
        e = f @ self.p["q"][:HIDDEN] + b @ self.p["q"][HIDDEN:]
        e = np.where(mask, e, -30.0)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        of, ob = f @ self.p["o"][:HIDDEN], b @ self.p["o"][HIDDEN:]
        return (a * (of + ob)).sum(axis=0) + self.p["bias"][0], a, of + ob

    def logits(self, gates: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        mask = at > 0
        return self.pooled(self.run("f", gates["f"], at, mask), self.run("b", gates["b"], at, mask), mask)[0]

    def gradients(self, word, raw, at, y, weight) -> tuple[float, dict]:
        mask, x = at > 0, self.inputs(word, raw)
        places = self._grams
        runs = {d: self.run(d, self.gates(x, d), at, mask, True) for d in "fb"}
        f, b = runs["f"][0], runs["b"][0]
        logit, a, value = self.pooled(f, b, mask)
        p = sigmoid(logit)
        dl = ((p - y) * weight / len(y)).astype(np.float32)
        de = a * (value - (a * value).sum(axis=0)) * dl
        dv = a * dl
        q, o = self.p["q"], self.p["o"]
        grad = {"bias": np.array([dl.sum()]), "q": np.concatenate([np.einsum("tb,tbh->h", de, s) for s in (f, b)]), "o": np.concatenate([np.einsum("tb,tbh->h", dv, s) for s in (f, b)])}
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = self.p[f"u{d}"]
            du, dh, each = np.zeros_like(u), np.zeros((at.shape[1], HIDDEN), np.float32), np.empty((*at.shape, 3 * HIDDEN), np.float32)
            for t in range(len(at) - 1, -1, -1) if d == "f" else range(len(at)):
                h, rz, n, ghn = runs[d][1][t]
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                dh = dh + de[t][:, None] * q[part] + dv[t][:, None] * o[part]
                live = np.where(mask[t][:, None], dh, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dg = np.concatenate([dr, dz, dn], axis=1)
                dgh = np.concatenate([dr, dz, dn * r], axis=1)
                each[t] = dg
                du += h.T @ dgh
                dh = np.where(mask[t][:, None], live * z + dgh @ u.T, dh)
            order = np.argsort(at, axis=None, kind="stable")
            found, first = np.unique(at.ravel()[order], return_index=True)
            dgates = np.zeros((len(word), 3 * HIDDEN), np.float32)
            dgates[found] = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order], first)
            grad |= {f"u{d}": du, f"w{d}": x.T @ dgates, f"c{d}": dgates.sum(axis=0)}
            dx += dgates @ self.p[f"w{d}"].T
        grad["word"] = gw = np.zeros_like(self.p["word"])
        np.add.at(gw, word, dx[:, :EMBED])
        gw[~self.common] = 0
        for j, (n, (flat, count)) in enumerate(zip(GRAMS, places, strict=True)):
            part = np.repeat(dx[:, (1 + j) * EMBED : (2 + j) * EMBED] / count[:, None], count, axis=0)
            grad[f"gram{n}"] = np.stack([np.bincount(flat, part[:, k], GRAMS[n]) for k in range(EMBED)], axis=1)
        return float(np.mean(-weight * np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1)))), grad

    def train(self, at: np.ndarray, y: np.ndarray, vocabulary: Vocabulary, epochs: int, state: dict) -> None:
        """Adam over windows at (window, time) with labels y; both classes weigh the same."""
        rng, word = np.random.default_rng(SEED), np.array(vocabulary.word)
        weight = np.where(y > 0, 0.5 / max(1e-6, y.mean()), 0.5 / max(1e-6, 1 - y.mean()))
        weight = np.sqrt(weight)
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH, min(STEPS, len(y) // 16))):
                own, local = np.unique(at[pick], return_inverse=True)
                if own[0] != 0:
                    own, local = np.r_[0, own], local + 1
                _, grad = self.gradients(word[own], [vocabulary.raw[i] for i in own], local.reshape(at[pick].shape).T, y[pick], weight[pick])
                state["t"] = state.get("t", 0) + 1
                for k, g in grad.items():
                    m, v = state.setdefault(k, [np.zeros_like(self.p[k]), np.zeros_like(self.p[k])])
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (RATE * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-6)).astype(np.float32)
        self.trained = True

    def score_texts(self, texts: list[str]) -> np.ndarray:
        """The highest logit among the windows of each text."""
        out, at = np.full(len(texts), -np.inf, np.float32), 0
        while at < len(texts):
            if self.kept is None or len(self.kept[0].ids) > KEPT_WORDS:
                self.kept = (Vocabulary(), {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"})
            vocabulary, gates = self.kept
            ids, owner, total = [], [], 0
            while at < len(texts) and total < AT_ONCE * 4:
                code = vocabulary.encode(words(texts[at]))
                s = np.array(starts(len(code)))
                code = np.pad(code, (0, max(0, WINDOW - len(code))))
                ids.append(code[s[:, None] + np.arange(WINDOW)])
                owner += [at] * len(s)
                total, at = total + len(s), at + 1
            known = len(gates["f"])
            if known < len(vocabulary.word):
                new = self.word_gates(vocabulary, known)
                for d in "fb":
                    gates[d] = np.vstack([gates[d], new[d]])
                vocabulary.raw[known:] = [None] * (len(vocabulary.word) - known)
            rows = np.concatenate(ids)
            for k in range(0, len(rows), AT_ONCE):
                np.maximum.at(out, owner[k : k + AT_ONCE], self.logits(gates, np.ascontiguousarray(rows[k : k + AT_ONCE].T)))
        return out


def fitted(texts: list[str], y: np.ndarray) -> Network:
    """A network fitted to a bounded sample, its scores not shifted yet; untrained if a class lacks."""
    net = Network()
    if not len(y) or y.min() == y.max():
        return net
    vocabulary, rows, owner = Vocabulary(), [], []
    codes = [vocabulary.encode(words(t)) for t in texts]
    seen = {"word": np.zeros((2, WORDS))} | {f"gram{n}": np.zeros((2, size)) for n, size in GRAMS.items()}  # sample texts of either class that have it
    found = {"word": (np.array(vocabulary.word), np.ones(len(vocabulary.word), int))} | {f"gram{n}": all_ngrams(vocabulary.raw, n) for n in GRAMS}
    begin = {k: np.cumsum(size) - size for k, (_, size) in found.items()}
    for i, code in enumerate(codes):
        own = np.unique(code)
        for k, (flat, size) in found.items():
            seen[k][y[i], np.unique(flat[spread(begin[k][own], size[own])])] += 1
        s = np.array(starts(len(code)))
        code = np.pad(code, (0, max(0, WINDOW - len(code))))
        rows.append(code[s[:, None] + np.arange(WINDOW)])
        owner += [i] * len(s)
    net.common = seen["word"].sum(axis=0) >= SEEN_IN
    net.common[0] = False
    for k, (neg, pos) in seen.items():  # the vectors' first number starts as a shrunken log-odds ratio
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        net.p[k][:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - 1) * (pos + neg) / (pos + neg + 8) / 2
    net.p["word"][~net.common] = 0
    at, owner, state = np.concatenate(rows), np.array(owner), {}
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.maximum(0, net.p["word"][vocabulary.word, 0])[at].sum(axis=1)
    for turn in range(TURNS):
        if turn:
            gates = net.word_gates(vocabulary)
            place = np.concatenate([net.logits(gates, np.ascontiguousarray(at[k : k + AT_ONCE].T)) for k in range(0, len(at), AT_ONCE)])
        nth = np.empty(len(at), int)  # rank of each window in its text, the most toxic first
        nth[np.lexsort((-place, owner))] = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        pick = np.flatnonzero(nth < np.where(y[owner] > 0, 1, WORST))
        net.train(at[pick], y[owner[pick]].astype(np.float32), vocabulary, EPOCHS, state)
    return net


def folds(texts: list[str], y: np.ndarray) -> np.ndarray:
    """The fold of each row: the distinct texts of either class are dealt out evenly, equal texts together."""
    order = {t: None for _, _, t in sorted((int(c), zlib.crc32(t.encode()), t) for t, c in zip(texts, y, strict=True))}
    at = {t: i % FOLDS for i, t in enumerate(order)}
    return np.array([at[t] for t in texts], int)


def unseen(texts: list[str], y: np.ndarray, k: int) -> np.ndarray:
    """Logits of the rows of fold k by a network that is fitted to the other folds; zeros if those lack a class."""
    own = folds(texts, y) == k
    net = fitted([t for t, o in zip(texts, own, strict=True) if not o], y[~own])
    return net.score_texts([t for t, o in zip(texts, own, strict=True) if o]) if net.trained else np.zeros(own.sum(), np.float32)


def best_cut(logit: np.ndarray, truth: np.ndarray) -> float:
    """The logit above which F1 is best at TOXIC_SHARE of toxic texts, of those that at most CLEAN_LOSS of the clean ones exceed.

    It depends on the rates of either class only, so neither on the number of rows nor on their shares.
    """
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(truth[order]) / truth.sum()
    lost = np.cumsum(1 - truth[order]) / (1 - truth).sum()
    f1 = 2 * hit * TOXIC_SHARE / (hit * TOXIC_SHARE + lost * (1 - TOXIC_SHARE) + TOXIC_SHARE)
    after = np.r_[logit[order[1:]], -np.inf]
    allowed = np.flatnonzero((lost <= CLEAN_LOSS) & (logit[order] > after))
    if not len(allowed):  # clean texts lead, and one of them is more than the share
        return float(logit.max()) + 1e-3
    best = allowed[np.argmax(f1[allowed])]
    return float((logit[order[best]] + after[best]) / 2) if np.isfinite(after[best]) else float(logit.min())


def part(texts: list[str], y: np.ndarray, k: int) -> Network | np.ndarray:
    """What one task learns: the network of all rows (k = FOLDS), or the logits of fold k by a network without it."""
    return fitted(texts, y) if k == FOLDS else unseen(texts, y, k)


def learn(texts: list[str], y: np.ndarray, run=map) -> Network:
    """A network fitted to a bounded sample. Its scores are shifted so that 0.5 is where F1 is best for the sample's rows, each scored by a network that has not seen it.

    Copies of a text count once there: they fall into one fold together, so a network that has not seen them may take all of them wrongly.
    """
    if not len(y) or y.min() == y.max():
        return Network()
    fold, logit = folds(texts, y), np.zeros(len(y), np.float32)
    net, *others = run(lambda k: part(texts, y, k), [FOLDS, *range(FOLDS)])
    for k, own in enumerate(others):
        logit[fold == k] = own
    once = list({(t, int(c)): i for i, (t, c) in enumerate(zip(texts, y, strict=True))}.values())
    net.shift, net.kept = best_cut(logit[once], y[once]), None
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    sample = labelled(docs, labels, "toxic", PER_CLASS, 2).select("doc_id", "text", "y").toPandas().sort_values("doc_id")
    sc = docs.sparkSession.sparkContext
    texts, y = sample["text"].tolist(), sample["y"].to_numpy()
    held = sc.broadcast((texts, y))

    def in_tasks(_, ks) -> list:
        """One task for each network, so that the driver holds the sample only."""
        return sc.parallelize(ks, len(ks)).map(lambda k: part(*held.value, k)).collect()

    return learn(texts, y, in_tasks)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            net = held.value
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores = sigmoid((net.score_texts(texts) - net.shift).astype(float)) if net.trained and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            net = held.value
            logit = net.score_texts([t or "" for t in b.column("text").to_pylist()])
            stays = sigmoid((logit - net.shift).astype(float)) < threshold if net.trained else np.ones(len(logit), bool)
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(each, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
