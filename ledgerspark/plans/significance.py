"""Assembled tests, correlations and intervals: statistic, p-value, effect and its label.

Spark reduces the ledger to one row for each group (analytics.groups and its kin); a group of applyInPandas is one test's few
rows, whatever the size of the ledger, and runs the closed forms of functions/dist.py on them. Verdicts are at 5 %.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from . import analytics, model, seasonal, spread

ALPHA, LEVEL = 0.05, 0.95
RESULT = "name string, test string, statistic double, df double, p_value double, significant boolean, effect string, effect_size double, magnitude string, mean_difference double, rank_test string, rank_statistic double, rank_p double, rank_biserial double, levene_w double, levene_p double, log_scale_t double, log_scale_p double, agrees boolean, n long"


def two_groups(name: str, a: dict, b: dict) -> dict:
    """Welch's t of the groups a and b, with Levene's, Mann-Whitney's and the log-scale check beside it."""
    size = lambda g, mean, var, n="n": (int(g[n]), g[mean], g[var])
    t, df, p = dist.welch(size(a, "mean", "var"), size(b, "mean", "var"))
    d = dist.cohen_d(size(a, "mean", "var"), size(b, "mean", "var"))
    u, u_p, biserial = dist.mann_whitney(int(a["n"]), a["rank_sum"], int(b["n"]), a["ties"])
    w, w_p, _ = dist.anova([size(g, "mean_deviation", "var_deviation") for g in (a, b)])
    out = {"test": "Welch t", "statistic": t, "df": df, "p_value": p, "effect": "Cohen d", "effect_size": d, "magnitude": dist.magnitude("d", d), "mean_difference": a["mean"] - b["mean"], "rank_test": "Mann-Whitney U", "rank_statistic": u, "rank_p": u_p, "rank_biserial": biserial, "levene_w": w, "levene_p": w_p}
    if min(a["log_n"], b["log_n"]) > 1:
        out["log_scale_t"], _, out["log_scale_p"] = dist.welch(size(a, "log_mean", "log_var", "log_n"), size(b, "log_mean", "log_var", "log_n"))
    return {"name": name, **out}


def many_groups(name: str, rows: list[dict]) -> dict:
    """One-way analysis of variance, with Levene's test and Kruskal-Wallis's beside it."""
    f, p, eta = dist.anova([(int(g["n"]), g["mean"], g["var"]) for g in rows])
    h, h_p = dist.kruskal([(int(g["n"]), g["rank_sum"]) for g in rows], rows[0]["ties"])
    w, w_p, _ = dist.anova([(int(g["n"]), g["mean_deviation"], g["var_deviation"]) for g in rows])
    return {"name": name, "test": "ANOVA F", "statistic": f, "df": len(rows) - 1, "p_value": p, "effect": "eta squared", "effect_size": eta, "magnitude": dist.magnitude("eta", eta), "rank_test": "Kruskal-Wallis H", "rank_statistic": h, "rank_p": h_p, "levene_w": w, "levene_p": w_p}


def _frame(found: dict, n: int) -> pd.DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    out = {k: found.get(k) for k in names} | {"n": n, "significant": found["p_value"] < ALPHA}
    if found.get("rank_p") is not None:
        out["agrees"] = (found["rank_p"] < ALPHA) == (found["p_value"] < ALPHA)
    kinds = dict(c.split() for c in RESULT.split(", "))
    return pd.DataFrame([out])[names].astype({k: "float64" for k, t in kinds.items() if t == "double"} | {k: "object" for k, t in kinds.items() if t in ("string", "boolean")})


def h_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of the seven questions. Groups too small for a test (fewer than two rows, no spread) give no row."""

    def assemble(df: pd.DataFrame) -> pd.DataFrame:
        rows = df.assign(var=df["sd"] ** 2, var_deviation=df["sd_deviation"] ** 2).sort_values("grp").to_dict("records")
        if len(rows) < 2 or any(g["n"] < 2 for g in rows) or not sum(g["var"] for g in rows) > 0:
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)
        found = two_groups(rows[0]["test"], *rows) if len(rows) == 2 else many_groups(rows[0]["test"], rows)
        return _frame(found, int(sum(g["n"] for g in rows)))

    def independence(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        if not r["df"] or pd.isna(r["chi_square"]):
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)
        v = float(r["cramers_v"])
        found = {"name": "payment_segment_independence", "test": "chi-square", "statistic": r["chi_square"], "df": r["df"], "p_value": dist.chi_square_sf(r["chi_square"], r["df"]), "effect": "Cramer V", "effect_size": v, "magnitude": dist.magnitude("v", v)}
        return _frame(found, int(r["n"]))

    table = model.ask(spark, sf_dir, analytics.CONTINGENCY).withColumn("one", F.lit(1))
    return spread.groups(spark, sf_dir, *(k for k in analytics.COMPARISONS if k != "region_quantity")).groupBy("test").applyInPandas(assemble, RESULT).unionByName(table.groupBy("one").applyInPandas(independence, RESULT))


def h_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven correlations with p-values, share of variance, strength, and the gap between monotonic and linear."""
    both = (("transaction", analytics.PAIRS, analytics.F_), ("month", analytics.MONTHLY_PAIRS, analytics.MONTHS))
    rows = reduce(DataFrame.unionByName, [spread.correlations(pairs, source, spark, sf_dir).withColumn("grain", F.lit(grain)) for grain, pairs, source in both])
    schema = "grain string, pair string, n long, pearson_r double, pearson_p double, spearman_rho double, spearman_p double, r_squared double, strength string, gap double"

    def assemble(df: pd.DataFrame) -> pd.DataFrame:
        p = lambda r: [dist.correlation_p(x, n) if n > 2 and x == x else math.nan for x, n in zip(df[r], df["n"], strict=True)]
        df = df.assign(pearson_p=p("pearson_r"), spearman_p=p("spearman_rho"), r_squared=df["pearson_r"] ** 2, strength=df["pearson_r"].map(dist.strength), gap=(df["spearman_rho"] - df["pearson_r"]).abs())
        return df[[c.split()[0] for c in schema.split(", ")]]

    return rows.groupBy("grain", "pair").applyInPandas(assemble, schema)


def t06_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight 95 % intervals: Student's, Wilson's and bootstrap (over random groups of rows, see seasonal.bootstrap)."""
    schema = "name string, n long, estimate double, low double, high double, method string"

    def assemble(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        n, mean = int(r["n"]), float(r["mean"])
        if n < 2:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
        low, high, method = (*dist.wilson(round(mean * n), n), "Wilson") if pd.isna(r["var"]) else (*dist.t_interval(n, mean, float(r["var"]), LEVEL), "Student t")
        return pd.DataFrame([(r["name"], n, mean, low, high, method)], columns=[c.split()[0] for c in schema.split(", ")])

    closed = model.ask(spark, sf_dir, analytics.MEANS).groupBy("name").applyInPandas(assemble, schema)
    lines = model.ask(spark, sf_dir, "SELECT order_id, line_number, product_id, revenue FROM fact_transactions")
    buyers = model.ask(spark, sf_dir, f"SELECT customer_id, SUM(revenue) AS revenue FROM {analytics.F_} WHERE is_customer_attributed = 1 GROUP BY 1")
    drawn = [
        (seasonal.bootstrap(rows, key, F.col("revenue"), F.lit(1)).crossJoin(rows.agg(F.count("*").alias("n"))), name)  # one row each
        for rows, key, name in ((lines, F.struct("order_id", "line_number", "product_id"), "Average transaction value (bootstrap)"), (buyers, F.col("customer_id"), "Revenue per customer (bootstrap)"))
    ]
    boot = [d.select(F.lit(name).alias("name"), "n", "estimate", "low", "high", F.lit("percentile bootstrap").alias("method")) for d, name in drawn]
    return reduce(DataFrame.unionByName, boot, closed)


def ts02_trend_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the log-linear trend's slope and of Kendall's tau (normal approximation)."""
    slope = model.ask(spark, sf_dir, analytics.TIME["ts02_log_trend"]).select(F.lit("slope").alias("test"), F.col("t_statistic").alias("statistic"), "months")
    tau = model.ask(spark, sf_dir, analytics.TIME["ts03_kendall_pairs"]).crossJoin(slope.select("months")).select(F.lit("kendall").alias("test"), F.col("z").alias("statistic"), "months")
    schema = "test string, statistic double, p_value double, significant boolean"

    def assemble(df: pd.DataFrame) -> pd.DataFrame:
        p = [dist.t_two_sided(s, m - 2) if t == "slope" else 2 * dist.normal_sf(abs(s)) for t, s, m in zip(df["test"], df["statistic"], df["months"], strict=True)]
        return pd.DataFrame({"test": df["test"], "statistic": df["statistic"], "p_value": p, "significant": [x < ALPHA for x in p]})

    return slope.unionByName(tau).groupBy("test").applyInPandas(assemble, schema)


def formatted(value: str, unit: str) -> F.Column:
    """An indicator as text: whole currency and counts with separators, percent with two digits, days with one."""
    v, u = F.col(value), F.col(unit)
    sign = F.when(v < 0, "-").otherwise("")
    return F.when(u == "currency", F.concat(sign, F.lit("$"), F.format_number(F.abs(v), 0))).when(u == "percent", F.concat(F.format_number(v, 2), F.lit("%"))).when(u == "days", F.concat(F.format_number(v, 1), F.lit(" days"))).otherwise(F.format_number(v, 0))


def k09_formatted_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly scorecard as text."""
    df = model.ask(spark, sf_dir, analytics.KPI["k06_scorecard"])
    return df.select("place", "name", formatted("value", "unit").alias("value"), formatted("prior_value", "unit").alias("prior_value"), "direction", "is_favourable")


QUERIES = {"h_tests": h_tests, "h_correlations": h_correlations, "t06_intervals": t06_intervals, "ts02_trend_tests": ts02_trend_tests, "k09_formatted_scorecard": k09_formatted_scorecard}
