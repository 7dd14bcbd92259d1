"""Quantiles, ranks, flags, events and the written ledger, against direct computation."""

import json
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.order import mid_ranks, quantiles
from ledgerspark.plans import anomaly, model
from ledgerspark.sources import files, warehouse

D = "/root/testdata/sf0.001"


def test_quantiles_equal_those_of_the_whole_group(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(3, 2, 9_000), np.full(6_000, 5.0), rng.integers(-40, 40, 5_000)])
    own = pd.DataFrame({"g": rng.integers(0, 3, len(x)), "x": x})
    at = {"least": 0.0, "low": 0.25, "middle": 0.5, "high": 0.98, "most": 1.0}
    df = spark.createDataFrame(own).unionByName(spark.createDataFrame([(9, None), (8, 1.5)], "g long, x double"))
    for limit in (200, 100_000):  # in several passes, and in one
        got = {r.g: r for r in quantiles(df, "x", at, "g", in_order=limit).collect()}
        assert set(got) == {0, 1, 2, 8} and got[8].middle == 1.5 and got[8].n == 1
        for g, s in own.groupby("g")["x"]:
            assert [got[g][k] for k in at] == pytest.approx(list(np.quantile(s, list(at.values())))), (limit, g)
    one = quantiles(df, "x", {"m": 0.5}, in_order=300).first()
    assert one.m == pytest.approx(float(np.median(np.append(x, 1.5)))) and one.n == len(x) + 1
    assert quantiles(df.limit(0), "x", {"m": 0.5}).collect()[0].m is None and quantiles(df.limit(0), "x", {"m": 0.5}, "g").count() == 0
    pair = quantiles(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x", {"m": 0.25}, ends=True).first().m
    assert (pair.left, pair.right, pair.part) == (1.0, 3.0, 0.25)


def test_mean_ranks(spark):
    rng = np.random.default_rng(5)
    own = pd.DataFrame({"g": rng.integers(0, 4, 3000), "x": rng.integers(0, 60, 3000).astype(float)})
    counts = spark.createDataFrame(own).groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {(r.g, r.x): r.mid for r in mid_ranks(counts, "x", "g").collect()}
    own["r"] = own.groupby("g")["x"].rank()
    assert {(g, x): r for g, x, r in own.itertuples(index=False)} == got


def series(values, metric="m", scope="Company-wide", start=(2020, 1)):
    return [(metric, scope, date(start[0] + (start[1] - 1 + k) // 12, (start[1] - 1 + k) % 12 + 1, 1), v) for k, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "metric string, scope string, month_start date, value double")


def test_trailing_and_global_scores(spark):
    rng = np.random.default_rng(1)
    x = (100 + rng.normal(0, 1, 30)).tolist()
    x[20], x[25] = 130.0, None
    steady = frame(spark, series(x) + series([5.0] * 30, "flat") + series(x[:5], "short") + series([0.0] * 20 + [1.0], "from zero"))
    got = {(r.metric, r.period): r for r in anomaly.rolling_flags(steady).collect()}
    past = np.array(x[14:20])
    z = (130 - past.mean()) / past.std(ddof=1)
    hit = got["m", "2021-09-01"]
    assert hit.score == round(z, 2) and hit.expected == round(past.mean(), 2) and hit.expected_high == pytest.approx(past.mean() + 3 * past.std(ddof=1), abs=0.006)
    assert (hit.severity, hit.material, hit.method) == ("Critical", True, anomaly.ROLLING) and {k[0] for k in got} == {"m"}
    flat = {(r.metric, r.period): r for r in anomaly.global_flags(steady).collect()}
    known = np.array([v for v in x if v is not None])
    assert flat["m", "2021-09-01"].score == pytest.approx((130 - known.mean()) / known.std(ddof=1), abs=0.006) and ("short", "2020-01-01") not in flat
    low = anomaly.rolling_flags(frame(spark, series([100.0, 100.01, 100.0, 100.01, 100.0, 100.01, 100.0, 100.01, 101.0]))).collect()
    assert [(r.severity, r.material) for r in low] == [("Low", False)] and low[0].score > 4.5
    assert anomaly.rolling_flags(steady.limit(0)).count() == anomaly.global_flags(steady.limit(0)).count() == anomaly.seasonal_flags(steady.limit(0)).count() == 0


def test_seasonal_flags(spark):
    rng = np.random.default_rng(2)
    x = [float(100 * 1.01**k * (1 + 0.3 * np.sin(k * np.pi / 6)) * np.exp(rng.normal(0, 0.01))) for k in range(60)]
    x[30] *= 0.6
    got = {r.period: r for r in anomaly.seasonal_flags(frame(spark, series(x, "Monthly revenue"))).collect()}
    hit = got["2022-07-01"]  # of five years, the season itself takes up a part of the fall
    assert hit.score < -4.5 and hit.severity == "Critical" and hit.deviation_pct == pytest.approx(-40, abs=10) and hit.metric == "Monthly revenue" and hit.scope == "Company-wide"
    assert hit.expected_low < hit.expected < hit.expected_high and len(got) <= 6


def test_fences_and_largest_rows(spark):
    rng = np.random.default_rng(4)
    rev = np.concatenate([rng.lognormal(5, 0.4, 500), [90_000.0, 80_000.0, 0.0, 0.01]])
    own = pd.DataFrame({"order_id": range(len(rev)), "line_number": 1, "product_category": ["a"] * 480 + ["b"] * 19 + ["c"] * (len(rev) - 499), "revenue": rev, "quantity": 5.0, "profit_margin_pct": rng.normal(20, 5, len(rev))})
    summary, top = anomaly.distributions(spark.createDataFrame(own))
    got = {(r.metric, r.scope): r for r in summary.collect()}
    assert set(got) == {("Transaction revenue", "All transactions"), ("Transaction quantity", "All transactions"), ("Transaction profit margin", "All transactions"), ("Transaction revenue", "Category: a")}
    x = rev[rev > 0]
    q1, q3 = np.percentile(np.log(x), [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    out = x[(np.log(x) < lo) | (np.log(x) > hi)]
    r = got["Transaction revenue", "All transactions"]
    assert (r.n_evaluated, r.n_flagged, r.pct_flagged) == (len(x), len(out), round(len(out) / len(x) * 100, 2))
    assert (r.lower_fence, r.upper_fence, r.median, r.flagged_value_total) == pytest.approx((np.exp(lo), np.exp(hi), np.median(x), out.sum()), abs=0.006)
    flagged = sorted((r for r in top.collect() if r.metric == "Transaction revenue"), key=lambda r: -r.actual)
    assert [r.actual for r in flagged] == pytest.approx(sorted(out, reverse=True)[:10], abs=0.006) and len(flagged) == min(10, len(out))
    assert flagged[0].period == "500-1" and flagged[0].score == pytest.approx(3 + (np.log(90_000) - hi) / (q3 - q1), abs=0.006)
    assert {r.n_flagged for r in summary.collect() if r.metric == "Transaction quantity"} == {0}
    empty = anomaly.distributions(spark.createDataFrame(own).limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_recall_of_events_from_a_file(spark, tmp_path):
    events = [
        {"event_id": "A", "kind": "shock", "start": "2021-03-10", "end": "2021-03-20", "scope": {}, "description": "all", "more": 1},
        {"event_id": "B", "kind": "price", "start": "2021-05-01", "end": "2021-06-30", "scope": {"region": "NORTH"}},
        {"event_id": "C", "kind": "outlier_transactions", "start": "2021-01-01", "end": "2021-01-02", "scope": {"category": "X"}},
        {"event_id": "D", "kind": "price", "start": "2021-05-01", "end": "2021-06-30", "scope": {"region": "nowhere"}},
        {"event_id": "E", "kind": "shock", "start": None, "end": None, "scope": None},
    ]
    (tmp_path / "events.json").write_text(json.dumps({"version": 3, "events": events}, indent=1))
    (tmp_path / "none.json").write_text(json.dumps({"events": []}))
    found = files.read_events(spark, str(tmp_path / "events.json"))
    assert files.read_events(spark, str(tmp_path / "none.json")).count() == 0
    rows, rng = [], np.random.default_rng(6)
    for k in range(200):
        day = date(2020, 12, 1) + timedelta(days=int(rng.integers(0, 330)))
        rows.append((day.isoformat(), ["Company-wide", "Region: North", "Region: South"][k % 3], "Regional revenue", float(rng.integers(30, 90) / 10)))
    rows += [("2021-02-07", "Region: South", "x", 9.5), ("2021-02-06", "Region: South", "y", 9.6), ("77-1", "All transactions", "Transaction Quantity", 4.0), ("2021-04-20", "Region: South", "edge", 9.7), ("2021-04-21", "Region: South", "over", 9.8)]
    flags = spark.createDataFrame(rows, "period string, scope string, metric string, score double").withColumn("method", F.lit("m"))
    got = {r.event_id: r for r in anomaly.recall(flags, found).collect()}
    want = defaultdict(list)
    for e in events:
        name = next(iter((e["scope"] or {}).values()), None)
        for period, scope, metric, score in rows:
            if e["kind"] == "outlier_transactions":
                if "quantity" in metric.lower():
                    want[e["event_id"]].append(score)
            elif e["start"] and len(period) == 10 and date.fromisoformat(e["start"]) - timedelta(31) <= date.fromisoformat(period) <= date.fromisoformat(e["end"]) + timedelta(31):
                if name is None or name.lower() in scope.lower() or scope == "Company-wide":
                    want[e["event_id"]].append(score)
    assert {i: (r.n_matching_flags, r.detected, r.score) for i, r in got.items()} == {e["event_id"]: (len(w := want[e["event_id"]]), bool(w), max(w, default=None)) for e in events}
    assert got["A"].metric == "edge" and not got["E"].detected
    total = anomaly.total_recall(anomaly.recall(flags, found)).first()
    assert (total.events_injected, total.events_recovered, total.recall_pct) == (5, sum(r.detected for r in got.values()), round(sum(r.detected for r in got.values()) * 20.0, 2))
    plan = anomaly.recall(flags, found)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_detectors_share_one_relation(spark):
    found = anomaly.flags(spark, D)
    assert tuple(found.columns) == anomaly.FLAGS
    methods = {r.method.split(" (")[0] for r in found.select("method").distinct().collect()}
    assert methods <= {"Global z-score", "Rolling z-score", "Seasonal-residual z-score", "Tukey IQR fences"} and len(methods) >= 3
    assert {r.scope for r in found.filter(F.col("method") == anomaly.GLOBAL).select("scope").distinct().collect()} <= {"Company-wide"}
    assert found.count() == found.dropDuplicates(["period", "scope", "metric", "method"]).count()
    n = found.count()
    assert sum(r.flags for r in anomaly.by_detector(found).collect()) == n and anomaly.ranked_flags(found).count() == min(30, n)


def test_appends_may_be_repeated(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("month"), "id", (F.col("id") * 2).alias("x"))
    rows = lambda: sorted((r.month, r.id, r.x) for r in spark.read.schema("id long, x long, month string").parquet(at).collect())
    warehouse.append(df, at, "month", ("id",), rows_per_file=100)
    whole = rows()
    assert len(whole) == 1000
    warehouse.append(df.filter("month = '1'"), at, "month", ("id",))
    assert rows() == whole
    warehouse.append(df.filter("month = '1' AND id < 10").withColumn("x", F.lit(-1).cast("long")), at, "month", ("id",))
    assert [r for r in rows() if r[0] != "1"] == [r for r in whole if r[0] != "1"] and {r[2] for r in rows() if r[0] == "1"} == {-1}
    warehouse.append(df.limit(0), at, "month")
    before = rows()
    assert warehouse.compact(spark, at, "month") > 0 and rows() == before
    assert warehouse.compact(spark, at, "month") == 0
    assert len(list((tmp_path / "t" / "month=0").glob("*.parquet"))) == 1


def test_a_month_is_written_by_many_tasks_and_read_alone(spark, tmp_path):
    df = spark.range(4000).select(F.lit("2020-01").alias("month"), "id")
    warehouse.append(df, str(tmp_path / "m"), "month", ("id",), rows_per_file=500)
    assert len(list((tmp_path / "m" / "month=2020-01").glob("*.parquet"))) >= 8
    at = model.ledger(spark, D)
    assert model.ledger(spark, D) == at
    from ledgerspark.plans import library

    df = model.ask(spark, D, library.SQL["hf_monthly"], library.BOUND["hf_monthly"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "year_month" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 120] and "Join" not in plan
