"""Mean ranks of many rows without joining them back: bounds that a sample has drawn part the values, and each range is ranked by itself.

A bound is itself a place: what equals it has its rank from counts alone, so that a frequent value never meets in one task.
Only the values between two bounds travel, about PER_RANGE rows of each range. The sample decides how even the ranges are,
never a rank: every row is counted and ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range, ranges at least (if they have a thousand rows each) and at most, values sampled for each, rows of a task that ranks.
PER_RANGE, LEAST, MOST, SAMPLED, PER_TASK = 250_000, 64, 4096, 200, 500_000
#: Rows that a task looks at together, and places for each pair or test in a key: one number, by which Spark sorts without comparing rows.
TOGETHER, KEYS = 100_000, 4 * MOST


def ranges_for(n: int) -> int:
    """Ranges into which n rows are parted."""
    return max(1, min(n // 1000, MOST, max(LEAST, n // PER_RANGE)))


def bounds(rows: DataFrame, n: int, columns: dict, *keys: str) -> dict[tuple, np.ndarray]:
    """(keys..., name) -> the different bounds of a column, from a sample of rows: a bounded number of values, whatever n is."""
    k = ranges_for(n)
    own = rows.sample(min(1.0, k * SAMPLED / n), seed=7) if n > k * SAMPLED else rows
    grid = [i / k for i in range(k + 1)]
    found = own.groupBy(*keys).agg(*(F.percentile_approx(c, grid, 10_000).alias(name) for name, c in columns.items())).collect()
    return {(*(r[key] for key in keys), name): np.unique(np.array(r[name] or [], dtype="float64")) for r in found for name in columns}


def place(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each value: 2 i + 1 if it is bound i, 2 i if it lies before bound i and after the one before."""
    if not len(at):
        return np.zeros(len(x), dtype="int64")
    i = np.searchsorted(at, x)
    return 2 * i + (at[np.minimum(i, len(at) - 1)] == x)


def mids(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the rows at each place: the rows before it, and the mean rank of a place that is one value."""
    before = np.cumsum(counts) - counts
    return before, before + (counts + 1) / 2


def mean_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean ranks (from 1) of x, and how often each of its different values occurs."""
    order = np.argsort(x)
    own = x[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(x) else np.zeros(0, dtype="int64")
    times = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (times + 1) / 2, times)
    return out, times


def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to some TOGETHER rows, however small the session makes them."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b] if held else [b], n + b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def tasks(df: DataFrame, n: int) -> int:
    """Tasks among which n rows are ranked."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PER_TASK))


def spearman(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pair (index), n and rho, Spearman's coefficient of each pair of double columns over the rows that have both.

    Rows travel twice at most: to the range of a, where they get their rank and go on to the range of b, where ranks are
    multiplied. A value that is a bound needs no travel.
    """
    total = rows.count()
    spark = rows.sparkSession
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    drawn = bounds(rows, total, {f"{k} {p}": both(*side) for p, (a, b) in enumerate(pairs) for k, side in enumerate(((a, b), (b, a)))}) if total else {}
    at = {(p, k): drawn.get((f"{k} {p}",), np.zeros(0)) for p in range(len(pairs)) for k in (0, 1)}

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for t in together(batches):
            x = {c: t[c].to_numpy() for c in t.column_names}
            valid = {c: t[c].is_valid().to_numpy() for c in t.column_names}
            for p, (a, b) in enumerate(pairs):
                ok = valid[a] & valid[b]
                yield p, x[a][ok], x[b][ok]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {key: np.zeros(2 * len(own) + 1, dtype="int64") for key, own in at.items()}
        for p, *sides in met(batches):
            for k, x in enumerate(sides):
                seen[p, k] += np.bincount(place(x, at[p, k]), minlength=len(seen[p, k]))
        for (p, k), n in seen.items():
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, "int32")), pa.array(np.full(len(own), k, "int32")), pa.array(own.astype("int32")), pa.array(n[own])], ["pair", "side", "place", "n"])

    counts = {key: np.zeros(2 * len(own) + 1, dtype="int64") for key, own in at.items()}
    for r in rows.mapInArrow(count, "pair int, side int, place int, n long").groupBy("pair", "side", "place").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"], r["side"]][r["place"]] = r["n"]
    size = [int(counts[p, 0].sum()) for p in range(len(pairs))]
    known = {key: mids(n) for key, n in counts.items()}
    middle = [(n + 1) / 2 for n in size]
    moved = [sum(int(counts[p, k][::2].sum()) for p in range(len(pairs))) for k in (0, 1)]
    schema = "key int, x double, y double"
    sums = {"product": KEYS - 1, "a": KEYS - 2, "b": KEYS - 3}  # places of rows that are parts of a sum: of products, of squares of a's and of b's ranks

    def batch(p: int, where: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((p * KEYS + where).astype("int32")), pa.array(x), pa.array(y)], ["key", "x", "y"])

    def part(p: int, **found: float) -> pa.RecordBatch:
        return batch(p, np.array([sums[k] for k in found]), np.array(list(found.values()), dtype="float64"), np.zeros(len(found)))

    def onward(p: int, rank: np.ndarray, y: np.ndarray, **found: float) -> Iterator[pa.RecordBatch]:
        where = place(y, at[p, 1])
        go = where % 2 == 0
        yield batch(p, where[go], y[go], rank[go])
        yield part(p, product=float(((rank[~go] - middle[p]) * (known[p, 1][1][where[~go]] - middle[p])).sum()), **found)

    def to_a(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x, y in met(batches):
            where = place(x, at[p, 0])
            go = where % 2 == 0
            if go.any():
                yield batch(p, where[go], x[go], y[go])

    def to_b(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x, y in met(batches):
            where = place(x, at[p, 0])
            own = where % 2 == 1
            if own.any():
                yield from onward(p, known[p, 0][1][where[own]], y[own])

    def ranked_a(key: tuple, t: pa.Table) -> pa.Table:
        p, where = divmod(key[0].as_py(), KEYS)
        rank = mean_ranks(t["x"].to_numpy())[0] + known[p, 0][0][where]
        return pa.Table.from_batches(list(onward(p, rank, t["y"].to_numpy(), a=float(((rank - middle[p]) ** 2).sum()))))

    def ranked_b(key: tuple, t: pa.Table) -> pa.Table:
        p, where = divmod(key[0].as_py(), KEYS)
        x = t["x"].to_numpy()
        if where in sums.values():
            return pa.Table.from_batches([batch(p, np.array([where]), np.array([x.sum()]), np.zeros(1))])
        rank = mean_ranks(x)[0] + known[p, 1][0][where] - middle[p]
        return pa.Table.from_batches([part(p, product=float((rank * (t["y"].to_numpy() - middle[p])).sum()), b=float((rank**2).sum()))])

    first = rows.mapInArrow(to_a, schema).repartition(tasks(rows, moved[0]), "key").groupBy("key").applyInArrow(ranked_a, schema)
    second = rows.mapInArrow(to_b, schema).unionByName(first).repartition(tasks(rows, moved[1]), "key").groupBy("key").applyInArrow(ranked_b, schema)
    squares = lambda p, k: float((counts[p, k][1::2] * (known[p, k][1][1::2] - middle[p]) ** 2).sum())
    told = spark.createDataFrame([(p, size[p], squares(p, 0), squares(p, 1)) for p in range(len(pairs))], "pair int, n long, a double, b double").filter("n > 0")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("key") % KEYS == sums[k], F.col("x"))), F.lit(0.0)).alias(f"sum_{k}")
    parts = second.groupBy(F.expr(f"key div {KEYS}").alias("pair")).agg(*(of(k) for k in sums))
    whole = lambda k: F.col(k) + F.coalesce(f"sum_{k}", F.lit(0.0))
    return told.join(F.broadcast(parts), "pair", "left").select("pair", "n", (F.col("sum_product") / F.nullif(F.sqrt(whole("a") * whole("b")), F.lit(0.0))).alias("rho"))
