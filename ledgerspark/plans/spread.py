"""Medians, fences, ranks and group statistics whose plans adapt to the data (operators/order.py).

The same questions stand as SQL in library.py and analytics.py, which is what other engines are given; here no task
orders a whole group, whatever its values: quantiles come from ranges that a sketch has drawn, ranks from ranges of
different values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import FEW, quantiles
from ..operators.ranges import bounds, spearman
from ..sources.shared import cut, kept
from . import analytics, library, model

PRODUCTS = "SELECT product_id, units_sold, revenue, profit_margin_pct, discount_rate_pct FROM v_product_summary"


def median(df: DataFrame, x: str) -> Column:
    """The median as a literal: one number."""
    return F.lit(quantiles(df, x, {"m": 0.5}).first()["m"]).cast("double")


def investigation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut(model.ask(spark, sf_dir, PRODUCTS))
    found = p.filter((F.col("revenue") > median(p, "revenue")) & (F.col("profit_margin_pct") < median(p, "profit_margin_pct")))
    return found.select("product_id", "revenue", F.expr(library.R("profit_margin_pct")).alias("profit_margin_pct"))


def product_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut(model.ask(spark, sf_dir, PRODUCTS))
    many, rich = F.col("units_sold") >= median(p, "units_sold"), F.col("profit_margin_pct") >= median(p, "profit_margin_pct")
    name = F.when(many & rich, "Star").when(many, "Fix").when(rich, "Grow").otherwise("Review")
    s = p.groupBy(name.alias("quadrant")).agg(F.count("*").alias("products"), F.sum(F.expr(library.money("revenue"))).cast("double").alias("revenue"))
    return s.select("quadrant", "products", "revenue", F.expr(library.pct("revenue", "SUM(revenue) OVER ()")).alias("share_pct"))


def discount_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut(model.ask(spark, sf_dir, PRODUCTS))
    found = p.filter(F.col("units_sold") >= 0.25 * median(p, "units_sold")).orderBy(F.desc("discount_rate_pct"), "product_id").limit(20)
    return found.select("product_id", "units_sold", F.expr(library.R("discount_rate_pct", 4)).alias("discount_pct"))


def revenue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = kept(model.ask(spark, sf_dir, "SELECT CAST(revenue AS DOUBLE) AS x FROM fact_transactions WHERE revenue > 0"))
    ends = quantiles(v, "x", {"lo": 0.0, "hi": 0.98}).first()
    own = v.filter(F.col("x") <= F.lit(ends["hi"]).cast("double")).withColumns({"lo": F.lit(ends["lo"]).cast("double"), "hi": F.lit(ends["hi"]).cast("double")})
    counts = own.groupBy(F.expr("CAST(LEAST(79, FLOOR((x - lo) * 80 / (hi - lo))) AS BIGINT)").alias("bin"), "lo", "hi").agg(F.count("*").alias("transactions"))
    return counts.select("bin", F.expr(library.R("lo + bin * (hi - lo) / 80", 4)).alias("from_value"), "transactions")


def _work(x: str, log: bool) -> tuple[str, str]:
    return (f"LN(CAST({x} AS DOUBLE))" if log else f"CAST({x} AS DOUBLE)"), (f"{x} > 0" if log else f"{x} IS NOT NULL")


def _fences(rows: DataFrame) -> DataFrame:
    found = quantiles(rows, "x", {"q1": 0.25, "q3": 0.75}, "grp")
    return cut(found.withColumns({"upper": F.expr("q3 + 1.5E0 * (q3 - q1)"), "lower": F.expr("q1 - 1.5E0 * (q3 - q1)")}))


def tukey(group: str, x: str, log: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of each group and how many rows are out."""
    v, keep = _work(x, log)
    rows = kept(model.ask(spark, sf_dir, f"SELECT {group} AS grp, {v} AS x FROM fact_transactions WHERE {keep}"))
    fences = _fences(rows).filter("n >= 20")
    met = rows.join(F.broadcast(fences) if fences.count() <= FEW else fences, "grp")
    n = lambda c: F.count(F.when(c, 1))
    out = met.groupBy("grp", "q1", "q3").agg(F.count("*").alias("rows_seen"), n(F.col("x") > F.col("upper")).alias("above"), n(F.col("x") < F.col("lower")).alias("below"))
    return out.select("grp", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "rows_seen", "above", "below")


def farthest(x: str, log: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows farthest from the upper fence, of those out of the fences."""
    v, keep = _work(x, log)
    rows = kept(model.ask(spark, sf_dir, f"SELECT 'all' AS grp, order_id, line_number, product_id, CAST(gross_revenue AS DOUBLE) AS gross_revenue, {v} AS x FROM fact_transactions WHERE {keep}"))
    out = rows.join(F.broadcast(_fences(rows)), "grp").filter("x > upper OR x < lower")
    ten = out.orderBy(F.expr("x - upper").desc(), "order_id", "line_number", "product_id", "gross_revenue").limit(10)
    return ten.select("order_id", "line_number", "product_id", "gross_revenue", F.round("x", 6).alias("value"), F.expr("ROUND(x - upper, 6)").alias("beyond_upper"))


def counted(spark: SparkSession, sf_dir: str, *names: str) -> list[tuple[list[str], DataFrame]]:
    """For each value that comparisons look at: their names, and its different values with one column of groups for each of them.

    Columns are range (of the value: a sample draws the bounds, see ranges.bounds), x, a comparison's group of these rows (null:
    none) by its name, and own, how many rows these are. A row counts once for a value, whatever the comparisons that look at it.
    """
    names, values = names or tuple(analytics.COMPARISONS), {}
    for k in names:
        values.setdefault(analytics.COMPARISONS[k][1], []).append(k)
    labels = ", ".join(f"CASE WHEN {c} THEN {g} END AS {k}" for k in names for g, _, c in [analytics.COMPARISONS[k]])
    rows = kept(model.ask(spark, sf_dir, f"SELECT {labels}, {', '.join(f'{x} AS x{i}' for i, x in enumerate(values))} FROM fact_transactions"))
    n = rows.count()
    drawn = bounds(rows, n, {f"x{i}": F.col(f"x{i}") for i in range(len(values))}) if n else {}
    out = []
    for i, tests in enumerate(values.values()):
        at = [float(b) for b in drawn.get((f"x{i}",), ()) if math.isfinite(b)] or [0.0]
        own = rows.select(F.col(f"x{i}").alias("x"), *tests).filter(F.col("x").isNotNull() & F.coalesce(*tests).isNotNull())
        own = Bucketizer(splits=[-math.inf, *at, math.inf], inputCol="x", outputCol="range", handleInvalid="keep").transform(own)
        out.append((tests, kept(own.groupBy("range", "x", *tests).agg(F.count("*").alias("own")))))
    return out


def _by_test(tests: list[str], df: DataFrame, *columns: str, **own: Callable[[str], Column]) -> DataFrame:
    """test, grp, the columns, and what `own` says of a test, for each row and comparison that has a group there."""
    each = F.array(*(F.struct(F.lit(t).alias("test"), F.col(t).alias("grp"), *(of(t).alias(c) for c, of in own.items())) for t in tests))
    return df.select(*columns, F.explode(each).alias("e")).select(*columns, "e.*").filter("grp IS NOT NULL")


def _group_medians(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """test, grp and the exact median: the counts of ranges say which of them hold it, and only their values are put in order."""
    own = Window.partitionBy("test", "grp")
    cells = cells.select("test", "grp", "range", (F.sum("n").over(own.orderBy("range")) - F.col("n")).alias("before"), "n", ((F.sum("n").over(own) - 1) / 2).alias("place"))
    holding = cells.filter((F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("n") > F.floor("place"))).drop("n")
    upto = F.col("before") + F.sum("own").over(Window.partitionBy("test", "grp", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = rows.join(F.broadcast(holding), ["test", "grp", "range"]).withColumn("upto", upto)
    pair = [F.min(F.when(F.col("upto") > F.expr(f"{f}(place)"), F.col("x"))).alias(c) for f, c in (("floor", "left"), ("ceil", "right"))]
    part = F.col("place") - F.floor("place")
    return near.groupBy("test", "grp", "place").agg(*pair).select("test", "grp", (F.col("left") + part * (F.col("right") - F.col("left"))).alias("median"))


def _rank_sums(tests: list[str], df: DataFrame) -> DataFrame:
    """test, grp, rank_sum and cubes (the group's part of the sum of n^3 - n over ties): ranks come from one order of the values, range by range, for all tests."""
    n = lambda t: F.when(F.col(t).isNotNull(), F.col("own")).otherwise(0)
    sizes = df.groupBy("range").agg(*(F.sum(n(t)).alias(f"{t} in it") for t in tests))
    starts = sizes.select("range", *((F.sum(f"{t} in it").over(Window.orderBy("range")) - F.col(f"{t} in it")).alias(f"{t} before") for t in tests))
    run, same = Window.partitionBy("range").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("range", "x")
    placed = df.withColumns({f"{t} upto": F.sum(n(t)).over(run) for t in tests} | {f"{t} same": F.sum(n(t)).over(same) for t in tests}).join(F.broadcast(starts), "range")
    mid = lambda t: F.col(f"{t} before") + F.col(f"{t} upto") - (F.col(f"{t} same") - 1) / 2
    times = lambda t: F.col(f"{t} same").cast("double")
    sums = placed.groupBy(*tests).agg(*(F.sum(F.col("own") * mid(t)).alias(f"{t} ranks") for t in tests), *(F.sum(F.col("own") * (times(t) * times(t) - 1)).alias(f"{t} cubes") for t in tests))
    each = _by_test(tests, sums, rank_sum=lambda t: F.col(f"{t} ranks"), cubes=lambda t: F.col(f"{t} cubes"))
    return each.groupBy("test", "grp").agg(F.sum("rank_sum").alias("rank_sum"), F.sum("cubes").alias("cubes"))


def groups(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """One row for each group of each comparison with all that the tests need, as analytics.groups() gives.

    Everything comes from the counted values (see counted): sums, then medians, then moments about means and medians, and ranks.
    """
    held = counted(spark, sf_dir, *names)
    rows = reduce(DataFrame.unionByName, [_by_test(tests, df, "range", "x", "own") for tests, df in held])
    x, own, log = F.col("x"), F.col("own"), F.when(F.col("x") > 0, F.log("x"))
    cells = cut(rows.groupBy("test", "grp", "range").agg(F.sum("own").alias("n"), F.sum(own * x).alias("total"), F.sum(F.when(x > 0, own).otherwise(0)).alias("log_n"), F.sum(own * log).alias("log_total")))
    first = cells.groupBy("test", "grp").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("log_n").alias("log_n"), F.sum("log_total").alias("log_total"))
    means = first.select("test", "grp", "n", (F.col("total") / F.col("n")).alias("mean"), "log_n", (F.col("log_total") / F.nullif("log_n", F.lit(0))).alias("log_mean"))
    known = cut(means.join(_group_medians(rows, cells), ["test", "grp"]))
    d, off, log_d = x - F.col("mean"), x - F.col("median"), log - F.col("log_mean")
    met = rows.join(F.broadcast(known) if known.count() <= FEW else known, ["test", "grp"])
    about = met.groupBy(*known.columns).agg(F.sum(own * d * d).alias("c2"), F.sum(own * d * d * d).alias("c3"), F.sum(own * F.abs(off)).alias("z"), F.sum(own * off * off).alias("z2"), F.sum(own * log_d * log_d).alias("log_c2"))
    sums = reduce(DataFrame.unionByName, [_rank_sums(tests, df) for tests, df in held]).withColumn("ties", F.sum("cubes").over(Window.partitionBy("test")))
    n, free = F.col("n"), F.nullif(F.col("n") - 1, F.lit(0))
    out = about.join(sums, ["test", "grp"]).withColumns({
        "sd": F.sqrt(F.col("c2") / free), "skewness": F.col("c3") / n / F.pow(F.nullif(F.col("c2") / n, F.lit(0.0)), F.lit(1.5)), "mean_deviation": F.col("z") / n,
        "sd_deviation": F.sqrt(F.greatest(F.lit(0.0), F.col("z2") - F.col("z") * F.col("z") / n) / free), "log_var": F.col("log_c2") / F.nullif(F.col("log_n") - 1, F.lit(0)),
    })
    r = lambda c, k=6: F.round(c, k).alias(c)
    return out.select("test", "grp", "n", r("mean"), r("sd"), r("median"), r("skewness"), r("mean_deviation"), r("sd_deviation"), r("rank_sum", 1), r("ties", 0), "log_n", r("log_mean"), r("log_var"))


def correlations(pairs: tuple[tuple[str, str], ...], source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's and Spearman's coefficients of pairs of columns, as analytics.correlations() gives.

    The columns are written once, each row for all pairs; Pearson's come straight from them, Spearman's from ranges.spearman.
    """
    columns = dict.fromkeys(c for pair in pairs for c in pair)
    rows = kept(model.ask(spark, sf_dir, f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)} FROM {source} src"))
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    moments = [m for p, (a, b) in enumerate(pairs) for m in (F.covar_pop(a, b).alias(f"c{p}"), F.var_pop(both(a, b)).alias(f"a{p}"), F.var_pop(both(b, a)).alias(f"b{p}"))]
    pearson = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), (F.col(f"c{p}") / F.nullif(F.sqrt(F.col(f"a{p}") * F.col(f"b{p}")), F.lit(0.0))).alias("r")) for p in range(len(pairs)))))
    straight = rows.agg(*moments).select(pearson.alias("e")).select("e.*")
    name = F.element_at(F.array(*(F.lit(f"{a} vs {b}") for a, b in pairs)), F.col("pair") + 1)
    return spearman(rows, list(pairs)).join(F.broadcast(straight), "pair").select(name.alias("pair"), "n", F.round("r", 6).alias("pearson_r"), F.round("rho", 6).alias("spearman_rho"))


def _of(name: str, columns: dict[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, sf_dir, name)
    return found.select(*(F.expr(e).alias(c) for c, e in columns.items()))


def _single(pair: tuple[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations((pair,), "v_monthly_revenue", spark, sf_dir).select(F.col("pearson_r").alias("pearson"), F.col("spearman_rho").alias("spearman"), "n")


QUERIES = {
    "x04_revenue_histogram": revenue_histogram,
    "x11_investigation_list": investigation_list,
    "x12_product_quadrants": product_quadrants,
    "x13_discount_heavy_floor": discount_heavy,
    "d04_tukey_revenue_log": partial(tukey, "'all'", "revenue", True),
    "d04_farthest_revenues": partial(farthest, "revenue", True),
    "d04_farthest_margins": partial(farthest, "profit_margin_pct", False),
    "d11_tukey_quantity_log": partial(tukey, "'all'", "quantity", True),
    "d11_tukey_margin": partial(tukey, "'all'", "profit_margin_pct", False),
    "d11_tukey_by_category": partial(tukey, "product_category", "revenue", True),
    "t11_groups": groups,
    "t12_ranks_weekend": partial(_of, "weekend_effect", {"grp": "SUBSTR(grp, 3)", "n": "n", "rank_sum": "rank_sum", "ties": "ties"}),
    "t13_levene_region": partial(_of, "regions_anova", {"region": "grp", "n": "n", "mean_deviation": "ROUND(mean_deviation, 4)"}),
    "t15_ranks_region": partial(_of, "region_quantity", {"grp": "grp", "n": "n", "rank_sum": "rank_sum", "ties": "ties"}),
    "t09_correlations": partial(correlations, analytics.PAIRS, "fact_transactions"),
    "t10_monthly_correlations": partial(correlations, analytics.MONTHLY_PAIRS, analytics.MONTHS),
    "t09_corr_customers_revenue": partial(_single, ("active_customers", "revenue")),
    "t10_corr_revenue_margin": partial(_single, ("revenue", "profit_margin_pct")),
}
