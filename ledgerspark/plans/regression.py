"""Least squares with robust errors, and pairwise comparisons, from sums that Spark gathers.

A row has numbers and one level for each factor. Sums of products are partial aggregates keyed by the combination of
levels, so what is shuffled grows with the number of combinations and what reaches the driver with the number of pairs
of levels, not of rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from . import model

FACTORS = {"category": "product_category", "segment": "customer_segment", "region": "region", "year": "CAST(year AS STRING)"}
NUMBERS = {"const": "1.0E0", "discount_pct": "CAST(discount AS DOUBLE) * 100", "log_quantity": "LN(CAST(quantity AS DOUBLE))", "log_unit_price": "LN(CAST(gross_revenue AS DOUBLE) / quantity)"}
MARGIN = "CAST(profit AS DOUBLE) * 100.0E0 / CAST(revenue AS DOUBLE)"


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, a column for each number and factor, and all of them as terms, for every line with positive revenue and quantity."""
    levels = {k: f"concat('{k}=', COALESCE({v}, 'Unknown'))" for k, v in FACTORS.items()}
    terms = [f"struct('{k}' AS term, {v} AS x)" for k, v in NUMBERS.items()] + [f"struct({v} AS term, 1.0E0 AS x)" for v in levels.values()]
    columns = ", ".join(f"{v} AS {k}" for k, v in (NUMBERS | levels).items())
    sql = f"SELECT {MARGIN} AS y, {columns}, array({', '.join(terms)}) AS terms FROM fact_transactions WHERE revenue > 0 AND quantity > 0"
    model.register(spark, sf_dir, sql)
    return spark.sql(sql)


def cross(rows: DataFrame, numbers: list[str], weight: Column) -> list[tuple[str, str, float]]:
    """(a, b, s): the weighted sum of products for each pair of terms that meet in a row."""
    products = {(a, b): f"p_{a}_{b}" for a, b in combinations_with_replacement(numbers, 2)}
    cells = rows.withColumn("w", weight).groupBy(*FACTORS).agg(*(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(name) for (a, b), name in products.items()))
    pair = lambda a, b, s: F.struct(a.alias("a"), b.alias("b"), F.col(s).alias("s"))
    each = [pair(F.lit(a), F.lit(b), name) for (a, b), name in products.items()]
    each += [pair(F.lit(n), F.col(f), products["const", n]) for n in numbers for f in FACTORS]
    each += [pair(F.col(f), F.col(g), products["const", "const"]) for f, g in combinations_with_replacement(FACTORS, 2)]
    return [tuple(r) for r in cells.select(F.explode(F.array(*each)).alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.s")).collect()]


def symmetric(sums: list, names: list[str]) -> np.ndarray:
    at, out = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for a, b, s in sums:
        if a in at and b in at:
            out[at[a], at[b]] = out[at[b], at[a]] = s
    return out


def lookup(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table to broadcast; by Arrow, which Spark keeps as a local relation and plans without a job."""
    return F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))))


def residuals(rows: DataFrame, levels: dict[str, list[str]], names: list[str], beta: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """rows with residual e and leverage h. What a level or a pair of levels adds is looked up in broadcast tables with a row for each."""
    spark, k, at = rows.sparkSession, len(NUMBERS), {n: i for i, n in enumerate(names)}
    z, part = [F.col(c) for c in NUMBERS], lambda t, u: float(inverse[at[t], at[u]]) if t in at and u in at else 0.0
    fit = [z[i] * float(beta[i]) for i in range(k)]
    lever = [z[i] * z[j] * float(inverse[i, j] * (1 + (i < j))) for i, j in combinations_with_replacement(range(k), 2)]
    for f, own in levels.items():
        table = [(t, float(beta[at[t]]) if t in at else 0.0, part(t, t), *(2 * part(t, n) for n in NUMBERS)) for t in own]
        rows = rows.join(lookup(spark, [f, f"b_{f}", f"h_{f}", *(f"h_{f}_{n}" for n in NUMBERS)], table), f)
        fit.append(F.col(f"b_{f}"))
        lever += [F.col(f"h_{f}"), *(F.col(f"h_{f}_{n}") * F.col(n) for n in NUMBERS)]
    for f, g in combinations(levels, 2):
        table = [(t, u, 2 * part(t, u)) for t in levels[f] for u in levels[g]]
        rows = rows.join(lookup(spark, [f, g, f"h_{f}_{g}"], table), [f, g])
        lever.append(F.col(f"h_{f}_{g}"))
    total = lambda xs: reduce(add, xs)
    return rows.withColumn("e", F.col("y") - total(fit)).withColumn("h", total(lever))


def least_squares(rows: DataFrame) -> DataFrame:
    """term, estimate, std_error (HC3), z, p_value, low, high (95 %), and n, r2, adjusted_r2, f_statistic, f_p_value and
    condition of the whole; the first level of each factor is the base.

    F is that of all terms but the constant, from the gathered products alone; condition is the ratio of the largest to the
    least singular value of the terms, each scaled to one, infinite where terms depend on each other (their number then
    counts less in F and adjusted_r2).

    Without rows the result is empty. Rows that alone determine a level have a leverage of 1 and a residual of 0; their
    share of the error is 0.
    """
    spark, rows = rows.sparkSession, rows.select("y", *NUMBERS, *FACTORS)
    sums = cross(rows, [*NUMBERS, "y"], F.lit(1.0))  # one row for each pair of levels
    schema = "term string, estimate double, std_error double, z double, p_value double, low double, high double, n long, r2 double, adjusted_r2 double, f_statistic double, f_p_value double, condition double"
    if not sums:
        return spark.createDataFrame([], schema)
    levels: dict[str, list[str]] = {f: [] for f in FACTORS}
    for t in sorted({b for _, b, _ in sums} - {"y"} - set(NUMBERS)):
        levels[t.split("=")[0]].append(t)
    names = [*NUMBERS, *(t for own in levels.values() for t in own[1:])]
    p, whole = len(names), symmetric(sums, [*names, "y"])
    inverse = np.linalg.pinv(whole[:p, :p], hermitian=True)
    beta = inverse @ whole[:p, p]
    n, y_sum, y_square = whole[0, 0], whole[0, p], whole[p, p]
    own = residuals(rows, levels, names, beta, inverse)
    weight = F.when(F.col("h") < 1 - 1e-9, F.pow(F.col("e") / (1 - F.col("h")), 2)).otherwise(0.0)
    meat = symmetric(cross(own, [*NUMBERS], weight), names)
    error = np.sqrt(np.clip(np.diag(inverse @ meat @ inverse), 0, None))
    r2 = 1 - (y_square - beta @ whole[:p, p]) / max(y_square - y_sum * y_sum / n, 1e-300)
    rank, adjusted, f, f_p, condition = overall(whole[:p, :p], int(n), float(r2))
    wide = 1.959963984540054  # of 95 % of a normal distribution
    out = [
        (t, float(b), float(s), float(b / s) if s else None, 2 * dist.normal_sf(abs(b / s)) if s else None, float(b - wide * s), float(b + wide * s), int(n), float(r2), adjusted, f, f_p, condition)
        for t, b, s in zip(names, beta, error, strict=True)
    ]
    return spark.createDataFrame(out, schema)


def overall(gram: np.ndarray, n: int, r2: float) -> tuple[int, float | None, float | None, float | None, float]:
    """Rank, adjusted R2, F with its p-value (of all terms but the constant), and condition of a regression's terms."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    own = np.linalg.eigvalsh(gram / np.outer(scale, scale))
    rank = int((own > own.max() * 1e-12).sum())
    condition = float(np.sqrt(own.max() / own.min())) if rank == len(gram) else math.inf
    if n <= rank or rank < 2:
        return rank, None, None, None, condition
    adjusted = 1 - (1 - r2) * (n - 1) / (n - rank)
    if r2 >= 1:
        return rank, adjusted, None, None, condition
    f = r2 / (rank - 1) / ((1 - r2) / (n - rank))
    return rank, adjusted, f, dist.f_sf(f, rank - 1, n - rank), condition


def t18_ols_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drives the margin of a line."""
    return least_squares(design(spark, sf_dir))


def pairwise(groups: list[tuple[str, int, float, float]]) -> list[tuple]:
    """(a, b, difference, q, p_value) by Tukey and Kramer for groups (name, n, mean, variance) of two rows or more."""
    groups = sorted(g for g in groups if g[1] > 1)
    df = sum(g[1] - 1 for g in groups)
    within = sum((g[1] - 1) * g[3] for g in groups) / df if df else 0.0
    out = []
    for a, b in combinations(groups, 2):
        half = math.sqrt(within / 2 * (1 / a[1] + 1 / b[1]))
        q = abs(a[2] - b[2]) / half if half else None
        out.append((a[0], b[0], b[2] - a[2], q, dist.studentized_range_sf(q, len(groups), df) if half else None))
    return out


def t16_tukey_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue of a line, each region against each other."""
    sql = "SELECT region, COUNT(*) AS n, AVG(CAST(revenue AS DOUBLE)) AS mean, VAR_SAMP(CAST(revenue AS DOUBLE)) AS var FROM fact_transactions GROUP BY region"
    moments = [tuple(r) for r in model.ask(spark, sf_dir, sql).collect()]  # one row for each region
    return spark.createDataFrame(pairwise(moments), "region_a string, region_b string, difference double, q double, p_value double")


QUERIES = {"t16_tukey_pairs": t16_tukey_pairs, "t18_ols_hc3": t18_ols_hc3}
