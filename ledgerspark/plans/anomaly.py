"""All detectors' flags in one relation, what is told of it, and its recall of known events.

Four detectors look at the same series (metric, scope, month): trailing windows at all of them, global scores at the
headline ones, seasonal remainders at those that follow the calendar, and Tukey's fences at single rows of the ledger.
Their flags have one schema (FLAGS), are written once to the shared folder, and are read from there by each question.
Months and scopes are few, whatever the size of the ledger; single rows meet only an aggregate of bounded size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import FEW, quantiles
from ..sources.files import read_events
from ..sources.shared import cut, kept, shared_dir
from . import analytics, model, seasonal

FLAGS = ("period", "scope", "metric", "method", "actual", "expected", "expected_low", "expected_high", "deviation", "deviation_pct", "score", "severity", "material")
#: Thresholds, window and fences.
Z, SEASONAL_Z, WINDOW, FENCE, MATERIAL_PCT = 3.0, 2.5, 6, 1.5, 5.0
LEAST_MONTHS, LEAST_ROWS, TOP = 6, 20, 10
#: Methods, and the metrics' names by the columns of the series.
GLOBAL, ROLLING = f"Global z-score (|z| > {Z})", f"Rolling z-score ({WINDOW}-period trailing window, |z| > {Z})"
SEASONAL, TUKEY = f"Seasonal-residual z-score (STL, robust MAD scale, |z| > {SEASONAL_Z})", f"Tukey IQR fences (k={FENCE})"
HEADLINE = {"revenue": "Monthly revenue", "profit": "Monthly profit", "margin": "Profit margin", "cost_ratio": "Cost-to-revenue ratio", "discount": "Discount rate", "order_value": "Average order value", "transactions": "Transaction volume"}
BY_SEASON = ("Monthly revenue", "Monthly profit", "Transaction volume")
COMPANY, ALL_ROWS = "Company-wide", "All transactions"
#: Kinds of events that show in single rows, not in months, and the word by which their flags are known.
OUTLIERS, OUTLIER_WORD = "outlier_transactions", "quantity"

_NAMES = " ".join(f"WHEN '{m}' THEN '{name}'" for m, name in HEADLINE.items())
_SUMS = ", ".join(f"SUM({x}) AS {x}" for x in ("gross_revenue", "discount_amount", "revenue", "cost", "profit"))
_D = {x: f"CAST({x} AS DOUBLE)" for x in ("gross_revenue", "discount_amount", "revenue", "cost", "profit")}
#: metric, scope, month_start, value. The ledger is read once, for three levels of months.
SERIES = f"""
SELECT CASE WHEN product_category IS NOT NULL THEN CASE m WHEN 'margin' THEN 'Category profit margin' ELSE 'Category discount rate' END
            WHEN region IS NOT NULL THEN CASE m WHEN 'revenue' THEN 'Regional revenue' ELSE 'Regional discount rate' END
            ELSE CASE m {_NAMES} END END AS metric,
  CASE WHEN product_category IS NOT NULL THEN concat('Category: ', product_category) WHEN region IS NOT NULL THEN concat('Region: ', region) ELSE '{COMPANY}' END AS scope,
  month_start, value
FROM (SELECT month_start, product_category, region, {_D['revenue']} AS revenue, {_D['profit']} AS profit,
        {_D['profit']} * 100 / NULLIF({_D['revenue']}, 0) AS margin, {_D['cost']} * 100 / NULLIF({_D['revenue']}, 0) AS cost_ratio,
        {_D['discount_amount']} * 100 / NULLIF({_D['gross_revenue']}, 0) AS discount, {_D['revenue']} / n AS order_value, CAST(n AS DOUBLE) AS transactions
      FROM (SELECT month_start, product_category, region, {_SUMS}, COUNT(*) AS n FROM fact_transactions
            GROUP BY GROUPING SETS ((month_start), (month_start, product_category), (month_start, region))) g) w
  UNPIVOT (value FOR m IN ({', '.join(HEADLINE)}))
WHERE (product_category IS NULL AND region IS NULL) OR (product_category IS NOT NULL AND m IN ('margin', 'discount')) OR (region <> 'Unknown' AND m IN ('revenue', 'discount'))
UNION ALL SELECT 'Operating expense', concat('Expense: ', expense_category), month, CAST(amount AS DOUBLE) FROM fact_operating_expenses
UNION ALL SELECT 'Marketing spend', 'Marketing (all regions)', month, CAST(SUM(spend) AS DOUBLE) FROM fact_marketing_spend GROUP BY month
UNION ALL SELECT 'Marketing spend as % of revenue', 'Marketing efficiency', month_start, spend * 100 / NULLIF(revenue, 0)
FROM v_monthly_pnl JOIN (SELECT month, CAST(SUM(spend) AS DOUBLE) AS spend FROM fact_marketing_spend GROUP BY month) s ON month = month_start"""
#: Single rows: what tells them apart, and what is looked at.
ROWS = "SELECT order_id, line_number, product_category, CAST(revenue AS DOUBLE) AS revenue, CAST(quantity AS DOUBLE) AS quantity, profit_margin_pct FROM fact_transactions"


def rounded(e: Column) -> Column:
    """Two digits, half up, by way of a decimal."""
    return F.round(e.cast("decimal(24,6)"), 2).cast("double")


def severity(score: Column, material: Column) -> Column:
    """Extremity of a flag; a move that is not material is low, however rare."""
    a = F.abs(score)
    return F.when(~material | (a < 3.0), "Low").when(a >= 4.5, "Critical").when(a >= 3.5, "High").otherwise("Medium")


def flagged(df: DataFrame, method: str | Column, score: Column, low: Column, high: Column, period: Column | None = None) -> DataFrame:
    """Rows with actual and expected as flags."""
    actual, expected = F.col("actual"), F.col("expected")
    pct = (actual - expected) / F.nullif(expected, F.lit(0.0)) * 100
    material = F.coalesce(F.abs(pct) >= MATERIAL_PCT, F.lit(True))
    own = {
        "period": F.col("month_start").cast("string") if period is None else period, "scope": F.col("scope"), "metric": F.col("metric"), "method": F.lit(method) if isinstance(method, str) else method,
        "actual": rounded(actual), "expected": rounded(expected), "expected_low": rounded(low), "expected_high": rounded(high), "deviation": rounded(actual - expected),
        "deviation_pct": rounded(pct), "score": rounded(score), "severity": severity(score, material), "material": material,
    }
    return df.select(*(own[c].alias(c) for c in FLAGS))


def global_flags(series: DataFrame, threshold: float = Z) -> DataFrame:
    """Months far from the mean of their whole series."""
    whole = Window.partitionBy("metric", "scope")
    m = series.filter("value IS NOT NULL").select("*", F.avg("value").over(whole).alias("expected"), F.stddev_samp("value").over(whole).alias("sd"), F.count("*").over(whole).alias("n"))
    m = m.filter((F.col("n") >= LEAST_MONTHS) & (F.col("sd") > 1e-9)).withColumnRenamed("value", "actual").withColumn("z", (F.col("actual") - F.col("expected")) / F.col("sd"))
    band = threshold * F.col("sd")
    return flagged(m.filter(F.abs("z") >= threshold), GLOBAL, F.col("z"), F.col("expected") - band, F.col("expected") + band)


def rolling_flags(series: DataFrame, threshold: float = Z, window: int = WINDOW) -> DataFrame:
    """Months far from the mean of those before them."""
    own = Window.partitionBy("metric", "scope")
    past = own.orderBy("month_start").rowsBetween(-window, -1)
    m = series.filter("value IS NOT NULL").select("*", F.avg("value").over(past).alias("expected"), F.stddev_samp("value").over(past).alias("sd"), F.count("*").over(past).alias("seen"), F.count("*").over(own).alias("n"))
    m = m.filter((F.col("seen") == window) & (F.col("n") >= window + 2) & (F.col("sd") > 1e-9)).withColumnRenamed("value", "actual")
    m = m.withColumn("z", (F.col("actual") - F.col("expected")) / F.col("sd"))
    band = threshold * F.col("sd")
    return flagged(m.filter(F.abs("z") >= threshold), ROLLING, F.col("z"), F.col("expected") - band, F.col("expected") + band)


def seasonal_flags(series: DataFrame, threshold: float = SEASONAL_Z) -> DataFrame:
    """Months that neither trend nor season explains."""
    keyed = series.select(F.concat_ws("\n", "metric", "scope").alias("series"), "month_start", "value")
    m = seasonal.decompose(keyed).filter(F.abs("score") >= threshold).withColumnRenamed("value", "actual")
    m = m.withColumns({"metric": F.split("series", "\n")[0], "scope": F.split("series", "\n")[1]})
    width = F.exp(F.log("expected") + threshold * F.abs(F.col("residual") / F.col("score"))) - F.col("expected")
    return flagged(m, SEASONAL, F.col("score"), F.col("expected") - width, F.col("expected") + width)


def distributions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of the fences of each distribution (three of all rows, one of each category), and flags of the TOP largest of the three.

    Amounts are looked at on a log scale, where only positive ones count; distributions of under LEAST_ROWS values are left out.
    """
    kinds = [("Transaction revenue", F.lit(ALL_ROWS), "revenue", True), ("Transaction quantity", F.lit(ALL_ROWS), "quantity", True), ("Transaction profit margin", F.lit(ALL_ROWS), "profit_margin_pct", False)]
    kinds.append(("Transaction revenue", F.concat(F.lit("Category: "), F.col("product_category")), "revenue", True))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), s.alias("scope"), F.lit(log).alias("log"), F.col(x).alias("actual")) for m, s, x, log in kinds)))
    long = rows.select("order_id", "line_number", each.alias("e")).select("order_id", "line_number", "e.*").filter("actual IS NOT NULL AND scope IS NOT NULL AND (NOT log OR actual > 0)")
    found = quantiles(long, "actual", {"a": 0.25, "b": 0.5, "c": 0.75}, "metric", "scope", "log", ends=True).filter(F.col("n") >= LEAST_ROWS)
    mixed = lambda c, f: f(F.col(f"{c}.left")) + F.col(f"{c}.part") * (f(F.col(f"{c}.right")) - f(F.col(f"{c}.left")))
    on = lambda c: F.when(F.col("log"), mixed(c, F.log)).otherwise(mixed(c, lambda x: x))
    fences = found.select("metric", "scope", "log", "n", mixed("b", lambda x: x).alias("expected"), on("a").alias("q1"), on("c").alias("q3"))
    fences = cut(fences.withColumns({"iqr": F.col("q3") - F.col("q1")}).withColumns({"lower": F.col("q1") - FENCE * F.col("iqr"), "upper": F.col("q3") + FENCE * F.col("iqr")}))
    work = F.when(F.col("log"), F.log("actual")).otherwise(F.col("actual"))
    met = long.drop("log").join(F.broadcast(fences) if fences.count() <= FEW else fences, ["metric", "scope"]).withColumn("work", work)
    out = met.filter((F.col("work") < F.col("lower")) | (F.col("work") > F.col("upper")))
    money = lambda c: F.when(F.col("log"), F.exp(c)).otherwise(F.col(c))
    method = F.concat(F.lit(TUKEY), F.when(F.col("log"), " on log scale").otherwise(""))
    sums = out.groupBy("metric", "scope").agg(F.count("*").alias("n_flagged"), F.sum(F.col("actual").cast("decimal(24,6)")).cast("double").alias("total"))
    flags_n = F.coalesce("n_flagged", F.lit(0)).cast("long")
    summary = fences.join(sums, ["metric", "scope"], "left").select(
        "metric", "scope", method.alias("method"), F.col("n").alias("n_evaluated"), flags_n.alias("n_flagged"), rounded(flags_n / F.col("n") * 100).alias("pct_flagged"),
        rounded(money("lower")).alias("lower_fence"), rounded(money("upper")).alias("upper_fence"), rounded(F.col("expected")).alias("median"), rounded(F.coalesce("total", F.lit(0.0))).alias("flagged_value_total"),
    )
    # The limit by group is applied before the rows are dealt out, so TOP rows of each task and distribution travel.
    largest = Window.partitionBy("metric").orderBy(F.desc("actual"), "order_id", "line_number")
    top = out.filter(F.col("scope") == ALL_ROWS).withColumn("place", F.row_number().over(largest)).filter(F.col("place") <= TOP)
    period = F.concat_ws("-", "order_id", "line_number")
    return summary, flagged(top, method, 3.0 + (F.col("work") - F.col("upper")) / F.col("iqr"), money("lower"), money("upper"), period)


def flags(spark: SparkSession, sf_dir: str, by_season: bool = True) -> DataFrame:
    """The flags of all detectors (without the seasonal one, if so asked), written once to the shared folder."""
    series = cut(model.ask(spark, sf_dir, SERIES))
    headline = series.filter(F.col("scope") == COMPANY)
    found = [rolling_flags(series), global_flags(headline), distributions(kept(model.ask(spark, sf_dir, ROWS)))[1]]
    if by_season:
        found.append(seasonal_flags(headline.filter(F.col("metric").isin(*BY_SEASON))))
    return cut(reduce(DataFrame.unionByName, found))


def ranked_flags(found: DataFrame, n: int = 30) -> DataFrame:
    """The n gravest."""
    grave = F.expr("CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END")
    return found.orderBy(grave, F.abs("score").desc(), "metric", "scope", "method", "period").limit(n)


def material_months(found: DataFrame) -> DataFrame:
    """Months with flags that matter."""
    month = F.try_to_date("period", "yyyy-MM-dd")
    return found.filter("material").withColumn("month_start", month).filter("month_start IS NOT NULL").groupBy("month_start").agg(F.count("*").alias("flags"), F.max(F.col("score") > 0).alias("any_above"))


def by_detector(found: DataFrame) -> DataFrame:
    """How many flags each method gave, by metric and severity; methods go by the words before their parameters."""
    return found.groupBy(F.trim(F.substring_index("method", "(", 1)).alias("detector"), "metric", "severity").agg(F.count("*").alias("flags"), F.sum(F.col("material").cast("long")).alias("material_flags"))


def recall(found: DataFrame, events: DataFrame, slack: int = 31) -> DataFrame:
    """Each event (event_id, kind, start, end, scope) and the flags that fall into its window, widened by `slack` days on either side.

    An event is spread over the months that its window touches, flags meet it by month, and dates and scopes are compared
    within the month: an event's scope is part of a flag's scope in any case, or the flag is company-wide; without a
    scope all flags count. Events of kind outlier_transactions count the flags of single rows' quantities, whatever
    their date. Events without dates meet no months; an event that nothing matches is kept, undetected.
    """
    day = F.try_to_date("period", "yyyy-MM-dd")
    slots = found.select("*", day.alias("day"), F.explode(F.filter(F.array(F.trunc(day, "MM").cast("string"), F.when(F.lower("metric").contains(OUTLIER_WORD), F.lit(OUTLIERS))), lambda s: s.isNotNull())).alias("slot"))
    own = events.withColumns({"first": F.date_sub("start", slack), "last": F.date_add("end", slack)})
    months = F.transform(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("INTERVAL 1 MONTH")), lambda d: d.cast("string"))
    spread = own.withColumn("slot", F.explode_outer(F.when(F.col("kind") == OUTLIERS, F.array(F.lit(OUTLIERS))).when(F.col("first") <= F.col("last"), months)))
    near = (F.col("kind") == OUTLIERS) | F.col("day").between(F.col("first"), F.col("last"))
    fits = F.col("kind").eqNullSafe(OUTLIERS) | F.col("e.scope").isNull() | F.lower("f.scope").contains(F.lower("e.scope")) | (F.col("f.scope") == COMPANY)
    met = spread.alias("e").join(slots.alias("f"), "slot").filter(near & fits)
    top = F.max(F.struct("score", "period", "metric", F.col("f.scope").alias("scope"), "method")).alias("top")
    hits = met.groupBy("event_id").agg(F.count("*").alias("n_matching_flags"), top)
    n = F.coalesce("n_matching_flags", F.lit(0)).cast("long")
    return events.join(hits, "event_id", "left").select("event_id", "kind", F.col("start").alias("window_start"), F.col("end").alias("window_end"), F.coalesce("scope", F.lit(COMPANY)).alias("event_scope"), (n > 0).alias("detected"), n.alias("n_matching_flags"), "top.score", "top.period", "top.metric")


def total_recall(events: DataFrame) -> DataFrame:
    """events_injected, events_recovered and recall_pct of what recall() gives."""
    n, hit = F.count("*"), F.coalesce(F.sum(F.col("detected").cast("long")), F.lit(0))
    return events.agg(n.alias("events_injected"), hit.alias("events_recovered"), rounded(hit * 100 / F.nullif(n, F.lit(0))).alias("recall_pct"))


#: Events of the bundled tables, analogues of a recorded truth: id, kind, first and last day, scope.
KNOWN = (
    ("E1", "demand_shock", "1997-01-01", "1997-03-31", None), ("E2", "regional_discounting", "1999-06-01", "1999-08-31", "asia"),
    ("E3", "volume_drop", "2001-05-01", "2001-08-31", None), ("E4", OUTLIERS, "1996-01-01", "1996-12-31", None), ("E5", "no_such_scope", "1998-02-01", "1998-02-28", "Atlantis"),
)


def known_events(spark: SparkSession) -> DataFrame:
    """KNOWN, by way of a JSON document in the shared folder, as recorded truths come."""
    events = [{"event_id": i, "kind": k, "start": a, "end": b, "scope": {"region": s} if s else {}, "description": k} for i, k, a, b, s in KNOWN]
    at = f"{shared_dir(spark)}/events-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(json.dumps({"events": events}),)], "value string").coalesce(1).write.text(at)
    return read_events(spark, at)


def _ask(question: Callable[[DataFrame], DataFrame], by_season: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return question(flags(spark, sf_dir, by_season))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(kept(model.ask(spark, sf_dir, ROWS)))[0]


def _largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(kept(model.ask(spark, sf_dir, ROWS)))[1]


def _recall(found: DataFrame) -> DataFrame:
    return recall(found, known_events(found.sparkSession))


QUESTIONS = {"d13_ranked_flags": ranked_flags, "x05_material_flags": material_months, "x18_flags_by_detector": by_detector, "d12_recall": _recall}
QUERIES = {name: partial(_ask, question, False) for name, question in QUESTIONS.items()}
QUERIES |= {f"{name}_all": partial(_ask, question, True) for name, question in QUESTIONS.items()}
QUERIES |= {"d12_recall_total": partial(_ask, lambda found: total_recall(_recall(found)), True), "d11_distributions": _summaries, "d04_largest_rows": _largest}

# SQL for another engine, written apart: its own quantiles, scores, grades and joins.
_R = "CAST(ROUND(CAST({0} AS DECIMAL(24,6)), 2) AS DOUBLE)"
_PCT = "(actual - expected) / NULLIF(expected, 0) * 100"
_MATERIAL = f"COALESCE(ABS({_PCT}) >= 5, TRUE)"
_FLAG = f"""{_R.format('actual')} AS actual, {_R.format('expected')} AS expected, {_R.format('low')} AS expected_low, {_R.format('high')} AS expected_high,
 {_R.format('actual - expected')} AS deviation, {_R.format(_PCT)} AS deviation_pct, {_R.format('z')} AS score,
 CASE WHEN NOT {_MATERIAL} THEN 'Low' WHEN ABS(z) >= 4.5 THEN 'Critical' WHEN ABS(z) >= 3.5 THEN 'High' WHEN ABS(z) >= 3 THEN 'Medium' ELSE 'Low' END AS severity, {_MATERIAL} AS material"""
_BANDS = "(actual - expected) / sd AS z, expected - 3 * sd AS low, expected + 3 * sd AS high"
_SHAPES = """shapes AS (
  SELECT 'Transaction revenue' AS metric, 'All transactions' AS scope, order_id, line_number, revenue AS actual, LN(revenue) AS work, TRUE AS log FROM r WHERE revenue > 0
  UNION ALL SELECT 'Transaction quantity', 'All transactions', order_id, line_number, quantity, LN(quantity), TRUE FROM r WHERE quantity > 0
  UNION ALL SELECT 'Transaction profit margin', 'All transactions', order_id, line_number, profit_margin_pct, profit_margin_pct, FALSE FROM r WHERE profit_margin_pct IS NOT NULL
  UNION ALL SELECT 'Transaction revenue', 'Category: ' || product_category, order_id, line_number, revenue, LN(revenue), TRUE FROM r WHERE revenue > 0
),
fences AS (
  SELECT metric, scope, log, count(*) AS n, median(actual) AS expected, quantile_cont(work, 0.25) AS q1, quantile_cont(work, 0.75) AS q3 FROM shapes GROUP BY ALL HAVING count(*) >= 20
),
fenced AS (
  SELECT s.*, n, expected, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
    'Tukey IQR fences (k=1.5)' || CASE WHEN s.log THEN ' on log scale' ELSE '' END AS method
  FROM shapes s JOIN fences f ON f.metric = s.metric AND f.scope = s.scope
),
tukey AS (
  SELECT metric, scope, method, order_id || '-' || line_number AS period, actual, expected, 3 + (work - hi) / iqr AS z,
    CASE WHEN log THEN EXP(lo) ELSE lo END AS low, CASE WHEN log THEN EXP(hi) ELSE hi END AS high
  FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY actual DESC, order_id, line_number) AS place FROM fenced WHERE scope = 'All transactions' AND (work < lo OR work > hi)) t
  WHERE place <= 10
)"""
_ALL = f"""series AS (SELECT metric, scope, month_start, value AS actual FROM ({SERIES}) s WHERE value IS NOT NULL), r AS ({ROWS}), {_SHAPES},
overall AS (
  SELECT s.*, mean AS expected, sd FROM series s JOIN (SELECT metric, scope, avg(actual) AS mean, stddev_samp(actual) AS sd, count(*) AS n FROM series GROUP BY ALL) m USING (metric, scope)
  WHERE n >= 6 AND sd > 1e-9 AND scope = 'Company-wide'
),
recent AS (
  SELECT *, avg(actual) OVER w AS expected, stddev_samp(actual) OVER w AS sd, count(*) OVER w AS seen, count(*) OVER (PARTITION BY metric, scope) AS n
  FROM series WINDOW w AS (PARTITION BY metric, scope ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
),
scored AS (
  SELECT CAST(month_start AS VARCHAR) AS period, scope, metric, '{GLOBAL}' AS method, actual, expected, {_BANDS} FROM overall
  UNION ALL SELECT CAST(month_start AS VARCHAR), scope, metric, '{ROLLING}', actual, expected, {_BANDS} FROM recent WHERE seen = 6 AND n >= 8 AND sd > 1e-9
),
flags AS (
  SELECT period, scope, metric, method, {_FLAG} FROM (SELECT * FROM scored WHERE ABS(z) >= 3 UNION ALL BY NAME SELECT * FROM tukey) f
)"""
_TRUTH = "truth AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{k}', DATE '{a}', DATE '{b}', " + (f"'{s}'" if s else "NULL") + ")" for i, k, a, b, s in KNOWN) + ") t(event_id, kind, window_start, window_end, scope))"
_ORACLES = {
    "d13_ranked_flags": f"WITH {_ALL} SELECT * FROM flags ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, ABS(score) DESC, metric, scope, method, period LIMIT 30",
    "x05_material_flags": f"WITH {_ALL} SELECT TRY_CAST(period AS DATE) AS month_start, count(*) AS flags, bool_or(score > 0) AS any_above FROM flags WHERE material AND TRY_CAST(period AS DATE) IS NOT NULL GROUP BY 1",
    "x18_flags_by_detector": f"WITH {_ALL} SELECT trim(split_part(method, '(', 1)) AS detector, metric, severity, count(*) AS flags, CAST(sum(CASE WHEN material THEN 1 ELSE 0 END) AS BIGINT) AS material_flags FROM flags GROUP BY 1, 2, 3",
    "d12_recall": f"""WITH {_ALL}, {_TRUTH},
met AS (
  SELECT event_id, score, period, metric FROM truth t JOIN flags f ON
    CASE WHEN kind = '{OUTLIERS}' THEN lower(metric) LIKE '%{OUTLIER_WORD}%'
      ELSE TRY_CAST(period AS DATE) BETWEEN window_start - 31 AND window_end + 31 AND (t.scope IS NULL OR contains(lower(f.scope), lower(t.scope)) OR f.scope = 'Company-wide') END
)
SELECT event_id, kind, window_start, window_end, COALESCE(t.scope, 'Company-wide') AS event_scope, n IS NOT NULL AS detected, COALESCE(n, 0) AS n_matching_flags, score, period, metric
FROM truth t LEFT JOIN (SELECT event_id, count(*) AS n FROM met GROUP BY 1) c USING (event_id)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, period DESC, metric DESC) AS k FROM met) b WHERE k = 1) m USING (event_id)""",
    "d11_distributions": f"""WITH r AS ({ROWS}), {_SHAPES}
SELECT metric, scope, method, count(*) AS n_evaluated, count(*) FILTER (work < lo OR work > hi) AS n_flagged, {_R.format('count(*) FILTER (work < lo OR work > hi) * 100.0E0 / count(*)')} AS pct_flagged,
  {_R.format('any_value(CASE WHEN log THEN EXP(lo) ELSE lo END)')} AS lower_fence, {_R.format('any_value(CASE WHEN log THEN EXP(hi) ELSE hi END)')} AS upper_fence, {_R.format('any_value(expected)')} AS median,
  {_R.format('COALESCE(sum(CAST(actual AS DECIMAL(24,6))) FILTER (work < lo OR work > hi), 0)')} AS flagged_value_total
FROM fenced GROUP BY metric, scope, method""",
    "d04_largest_rows": f"WITH r AS ({ROWS}), {_SHAPES} SELECT period, scope, metric, method, {_FLAG} FROM tukey",
}
ORACLES = {name: model.oracle(sql) for name, sql in _ORACLES.items()}
