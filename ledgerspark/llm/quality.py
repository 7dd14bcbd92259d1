"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of the whole text (lengths, character classes, repetition) are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel. Each partition of the sample sums its part of the
normal equations, the parts are added up in Spark, and the ridge solution is one small solve. The raw scores are made
probabilities by isotonic regression over bins of scores.

Learned from at most about 2 x PER_CLASS labelled rows outside the held-out fold; everything is scored.
Defined cases: null counts as an empty text, whose statistics are zero and which is scored like any other; without
labelled rows of both classes every score is the share of ones (0.5 if there are none); repeated rows are scored each.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .sampling import held_out, labelled

PER_CLASS, FEATURES, GAMMA, RIDGE, BINS, SEED, THRESHOLD = 10_000, 192, 0.08, 1e-2, 200, 7, 0.3
#: Symbols that are counted each for itself.
SYMBOLS = b"$%#&*|!.,"


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * STATS
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, wide = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    seen = Counter(words)
    length = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    top = seen.most_common(3)
    again = sum(map(operator.eq, words, words[1:]))
    per_line = np.fromiter(map(len, lines), np.int32, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), length.mean(), length.std(), np.log1p(length.max()),
        upper / n, lower / n, digit / n, wide / n, upper / max(1, upper + lower), *(np.sqrt(count[c] / k) for c in SYMBOLS),
        len(seen) / k, np.log1p(len(seen)) - np.log1p(k), again / k, *([c / k for _, c in top] + [0.0] * 3)[:3],
        len(set(lines)) / len(lines), per_line.mean() / 1000, per_line.std() / 1000, float((per_line < 25).mean()),
    ]


STATS = 11 + len(SYMBOLS) + 3 + 3 + 4


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.drop(columns="text").assign(x=[list(map(float, statistics(t))) for t in b["text"]])


class Model:
    """Standardisation, random features, weights, calibration steps."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, prior: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.std, self.prior = mean, std, prior
        self.w = rng.normal(0, np.sqrt(2 * GAMMA / len(mean) * 10), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.theta, self.edges, self.steps = None, None, None

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), z * 0.2, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.theta is None else self.phi(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(raw if self.steps is None else np.interp(raw, self.edges, self.steps), 0, 1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to means y of weights n (pool adjacent violators)."""
    pools: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, k = pools.pop()
            u = pools[-1]
            pools[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k]
    return np.concatenate([np.full(k, v) for v, _, k in pools]) if pools else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    spark = docs.sparkSession
    sample = cut(labelled(docs, labels, target, PER_CLASS).select("doc_id", "y", "text").mapInPandas(_stats, "doc_id long, y int, x array<double>"))
    m = sample.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg("y").alias("prior")).orderBy("i").toPandas()
    if not len(m):
        return Model(np.zeros(STATS), np.ones(STATS), 0.5)
    model = Model(m["mean"].to_numpy(), np.maximum(m["std"].to_numpy(), 1e-6), float(m["prior"][0]))
    if model.prior in (0.0, 1.0):
        return model
    held = spark.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                z = held.value.phi(np.stack(b["x"].to_numpy()))
                y = b["y"].to_numpy(float)
                own = np.vstack([z.T @ z, z.T @ y])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": [r.tobytes() for r in total]})

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum([np.frombuffer(v) for v in b["v"]], axis=0).tobytes()]})

    sums = sample.select("y", "x").mapInPandas(part, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").orderBy("i").toPandas()
    a = np.stack([np.frombuffer(v) for v in sums["v"]])
    gram, moment = a[:-1], a[-1]
    n = gram[-1, -1]
    model.theta = np.linalg.solve(gram / n + RIDGE / len(gram) * np.eye(len(gram)), moment / n)
    final = spark.sparkContext.broadcast(model)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"bin": np.floor(np.clip(final.value.raw(np.stack(b["x"].to_numpy())), -0.5, 1.5) * BINS).astype(int), "y": b["y"]})

    bins = sample.select("y", "x").mapInPandas(raw, "bin int, y int").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    model.edges, model.steps = (bins["bin"].to_numpy() + 0.5) / BINS, isotonic(bins["y"].to_numpy(), bins["n"].to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            scores = held.value.score(np.array(x, float)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
