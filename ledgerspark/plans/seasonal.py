"""Robust seasonal decomposition, its outliers, unit-root tests and resampled intervals.

A series has one row a month, after aggregation, so a group of applyInPandas is some hundred rows whatever the size of
the ledger. Series with a missing or non-positive value (no logarithm), or of fewer than 24 months give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..operators import order
from . import analytics, model

LEAST, THRESHOLD = 24, 2.5
BLOCKS, DRAWS = 1_000, 10_000


def by_series(long: DataFrame, each: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """each(months, logarithms) of every series (series, month_start, value) that has a logarithm.

    Months that a series lacks between its first and last one are put in, their logarithms on the line between their
    neighbours', so that a season stays where it is; they have no value, and rows for them are left out of the result.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("month_start").reset_index(drop=True)
        value = df["value"].to_numpy(float)
        month = pd.to_datetime(df["month_start"])
        index = (month.dt.year * 12 + month.dt.month).to_numpy()
        if len(df) < LEAST or not (value > 0).all() or not (np.diff(index) > 0).all():
            return pd.DataFrame(columns=names, dtype=object)
        whole = np.arange(index[0], index[-1] + 1)
        filled = df.set_index(index).reindex(whole).reset_index(drop=True)
        filled["series"] = df["series"].iloc[0]
        out = each(filled, np.interp(whole, index, np.log(value)))
        return out[out["value"].notna()][names] if "value" in out else out[names]

    return long.select("series", "month_start", F.col("value").cast("double").alias("value")).groupBy("series").applyInPandas(run, schema)


#: Cells into which a bootstrap of quantiles parts the values.
CELLS = 512


def bootstrap_quantile(rows: DataFrame, x: Column, q: float = 0.5, draws: int = DRAWS, cells: int = CELLS, seed: int = 42) -> DataFrame:
    """estimate, low, high (95 %), draws, n of a quantile of x: a bootstrap over value cells.

    A sketch parts the values into `cells` cells of like numbers. A row's Poisson(1) weights add up to a Poisson count of its
    cell, so a draw needs no rows: it weighs each cell by such a count (the normal approximation, from hashes of cell, draw
    and seed; exact sums of Poisson(1) hashes for cells of under 30 rows), finds the cell in which the weighted quantile
    falls, and goes the same part of the way through it. An end of the interval is thus as fine as a cell, that is 1 / cells
    of the rows. The cost past two passes over the rows is draws x cells, at any number of rows. The estimate is exact.
    Without rows it is null.
    """
    own = rows.select(x.cast("double").alias("x")).filter("x IS NOT NULL")
    exact = order.quantiles(own, "x", {"m": q}).first()
    schema = "estimate double, low double, high double, draws long, n long"
    if not exact["n"]:
        return rows.sparkSession.createDataFrame([(None, None, None, 0, 0)], schema)
    ends = sorted(set(own.select(F.percentile_approx("x", [k / cells for k in range(1, cells)], 10_000).alias("s")).first()["s"]))
    cell = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("x")))
    table = own.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    each = table.repartition(min(cells, max(rows.sparkSession.sparkContext.defaultParallelism, 1))).select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    uniform = lambda *by: (F.pmod(F.xxhash64("cell", "draw", F.lit(seed), *map(F.lit, by)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(uniform("u"))) * F.cos(2 * math.pi * uniform("v"))
    single = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + poisson((F.pmod(F.xxhash64("cell", "draw", F.lit(seed), i), F.lit(1 << 40)) + 0.5) / float(1 << 40)))
    weighed = each.withColumn("w", F.when(F.col("n") < 30, single).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt(F.col("n")) * normal))))
    upto = Window.partitionBy("draw").orderBy("cell")  # `cells` rows at most
    run = weighed.select("*", F.sum("w").over(upto).alias("upto"), F.sum("w").over(Window.partitionBy("draw")).alias("total"))
    place = F.col("total") * q
    hit = run.filter((F.col("w") > 0) & (F.col("upto") >= place) & (F.col("upto") - F.col("w") <= place))
    value = F.col("least") + (F.col("most") - F.col("least")) * (place - F.col("upto") + F.col("w")) / F.col("w")
    drawn = hit.groupBy("draw").agg(F.min(value).alias("r"))
    low, high = F.percentile("r", 0.025), F.percentile("r", 0.975)
    return drawn.agg(F.lit(exact["m"]).alias("estimate"), low.alias("low"), high.alias("high"), F.count("r").alias("draws"), F.lit(exact["n"]).cast("long").alias("n"))


def complete(df: DataFrame, *keys: str) -> DataFrame:
    """df (keys, month_start and values) with a row for every month from each series' first to its last; a month put in has no values.

    `present` tells the rows that were there. Lags over such rows are lags by date (see lagged).
    """
    ends = df.groupBy(*keys).agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    spine = ends.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH")).cast("array<date>")).alias("month_start"))
    return spine.join(df.withColumn("present", F.lit(True)), [*keys, "month_start"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def lagged(df: DataFrame, x: str, months: int, *keys: str) -> Column:
    """x as it was so many months before, in a complete series: the row before is the month before."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return F.lag(x, months).over(own.orderBy("month_start"))


def ts12_complete_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue of dear sales by region and category, gaps put in, with growth against the month and the year before by date."""
    keys = ("region", "product_category")
    sql = "SELECT region, product_category, month_start, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM fact_transactions WHERE quantity >= 48 GROUP BY 1, 2, 3"
    own = complete(model.ask(spark, sf_dir, sql), *keys)
    before = {k: lagged(own, "revenue", k, *keys) for k in (1, 12)}
    growth = {k: F.round(F.col("revenue") / F.nullif(b, F.lit(0.0)) - 1, 6) for k, b in before.items()}
    return own.select(*keys, "month_start", "present", "revenue", growth[1].alias("mom"), growth[12].alias("yoy"))


_COMPLETE = """WITH m AS (SELECT region, product_category, month_start, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM fact_transactions WHERE quantity >= 48 GROUP BY 1, 2, 3),
s AS (SELECT region, product_category, CAST(unnest(generate_series(MIN(month_start), MAX(month_start), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM m GROUP BY 1, 2),
j AS (SELECT s.region, s.product_category, s.month_start, a.revenue, a.revenue IS NOT NULL AS present, b.revenue AS r1, c.revenue AS r12 FROM s
  LEFT JOIN m a ON a.region = s.region AND a.product_category = s.product_category AND a.month_start = s.month_start
  LEFT JOIN m b ON b.region = s.region AND b.product_category = s.product_category AND b.month_start = s.month_start - INTERVAL 1 MONTH
  LEFT JOIN m c ON c.region = s.region AND c.product_category = s.product_category AND c.month_start = s.month_start - INTERVAL 12 MONTH)
SELECT region, product_category, month_start, present, revenue, ROUND(revenue / NULLIF(r1, 0) - 1, 6) AS mom, ROUND(revenue / NULLIF(r12, 0) - 1, 6) AS yoy FROM j"""


def decompose(long: DataFrame) -> DataFrame:
    """Trend, seasonal part and remainder of the logarithms, what they let expect, and the remainder's robust score."""

    def each(df: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        trend, seasonal, rest = series.stl(y)
        scale = series.residual_scale(rest)
        score = rest / scale if scale > 0 else np.zeros(len(y))
        return df.assign(trend=trend, seasonal=seasonal, residual=rest, expected=np.exp(trend + seasonal), score=score)

    return by_series(long, each, "series string, month_start date, value double, trend double, seasonal double, residual double, expected double, score double")


def stationarity(long: DataFrame) -> DataFrame:
    """Unit-root, trend-stationarity and whiteness tests of the logarithms; nulls where a test has no variance to work on."""

    def each(df: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        found = {"adf": series.adf(y), "kpss_trend": series.kpss(y), "adf_of_difference": series.adf(np.diff(y))}
        found |= {f"ljung_box_{k}": series.ljung_box(y, k) if np.ptp(y) > 1e-12 else None for k in (6, 12)}
        rows = [(df["series"].iloc[0], test, *(r or (None, None, None))) for test, r in found.items()]
        return pd.DataFrame(rows, columns=["series", "test", "statistic", "p_value", "lags"]).astype({"lags": "Int64"})

    return by_series(long, each, "series string, test string, statistic double, p_value double, lags long")


def correlogram(long: DataFrame) -> DataFrame:
    """Autocorrelation and partial autocorrelation of the logarithms at up to 18 lags."""

    def each(df: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        k = min(18, len(y) // 2 - 1) if np.ptp(y) > 1e-12 else -1
        return pd.DataFrame({"series": df["series"].iloc[0], "lag": np.arange(k + 1), "acf": series.acf(y, k) if k >= 0 else [], "pacf": series.pacf(y, k) if k >= 0 else []})

    return by_series(long, each, "series string, lag long, acf double, pacf double")


def poisson(u: Column) -> Column:
    """The Poisson(1) count at a uniform number, by its cumulative distribution."""
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return sum((F.when(u >= float(e), 1).otherwise(0) for e in ends), F.lit(0))


def bootstrap(rows: DataFrame, key: Column, above: Column, below: Column, draws: int = DRAWS, blocks: int = BLOCKS, seed: int = 42) -> DataFrame:
    """estimate, low, high (95 %), draws of sum(above) / sum(below): a bootstrap over random groups of rows.

    Rows are dealt into blocks by a hash of their key and summed in one pass; a draw weighs blocks by Poisson(1) counts,
    which are hashes of (block, draw, seed), so results do not depend on partitioning. Groups are random, so their
    spread is that of single rows; the cost past the first pass is draws x blocks, at any number of rows. Row-wise draws
    would cost draws x rows. Without rows the estimate is null.
    """
    summed = rows.select((F.pmod(F.xxhash64(key), F.lit(blocks))).alias("block"), above.cast("double").alias("a"), below.cast("double").alias("b")).groupBy("block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    summed = summed.repartition(min(blocks, max(rows.sparkSession.sparkContext.defaultParallelism, 1)))  # few rows, much work each
    each = summed.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))  # draw 0 is the data as they are
    uniform = F.pmod(F.xxhash64("block", "draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weight = F.when(F.col("draw") == 0, 1).otherwise(poisson(F.col("u")))
    ratio = each.withColumn("u", uniform).withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("a")) / F.sum(F.col("w") * F.col("b"))).alias("r"))
    drawn = F.when(F.col("draw") > 0, F.col("r"))
    return ratio.agg(F.max(F.when(F.col("draw") == 0, F.col("r"))).alias("estimate"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.count(drawn).alias("draws"))


def ts05_stl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(model.ask(spark, sf_dir, analytics.LONG))


def d03_seasonal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that the trend and the season do not explain."""
    found = decompose(model.ask(spark, sf_dir, analytics.LONG)).filter(F.abs("score") >= THRESHOLD)
    found = found.withColumn("deviation_pct", (F.col("value") / F.col("expected") - 1) * 100).select("series", "month_start", "value", "expected", "score", "deviation_pct")
    return found.withColumn("severity", F.expr(analytics.GRADE))


def ts09_stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stationarity(model.ask(spark, sf_dir, analytics.LONG))


def ts09_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlogram(model.ask(spark, sf_dir, analytics.LONG))


def t07_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the mean revenue of a line."""
    rows = model.ask(spark, sf_dir, "SELECT order_id, line_number, product_id, revenue FROM fact_transactions")
    return bootstrap(rows, F.struct("order_id", "line_number", "product_id"), F.col("revenue"), F.lit(1))


def t07_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the median revenue of a line."""
    rows = model.ask(spark, sf_dir, "SELECT revenue FROM fact_transactions")
    return bootstrap_quantile(rows, F.col("revenue"), draws=2_000)


ORACLES = {"ts12_complete_series": model.oracle(_COMPLETE)}
QUERIES = {"ts12_complete_series": ts12_complete_series, "ts05_stl": ts05_stl, "d03_seasonal_residual": d03_seasonal_residual, "ts09_stationarity": ts09_stationarity, "ts09_correlogram": ts09_correlogram, "t07_bootstrap": t07_bootstrap, "t07_median": t07_median}
