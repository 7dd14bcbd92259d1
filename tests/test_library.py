import math

import duckdb
import numpy as np
import pytest

from ledgerspark.functions import dist
from ledgerspark.operators import cleaning
from ledgerspark.plans import library, model, significance
from ledgerspark.sources import files, scripts
from ledgerspark.plans.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
SOME = ["q01_monthly_revenue_trend", "q05_revenue_by_region", "q12_customer_concentration", "q15_customer_cohort_retention", "q22_budget_variance", "q26_receivables_aging", "h_kpis", "hf_products", "k06_scorecard", "ts04_classical_decomposition", "d02_rolling_z", "t15_ranks_region", "t11_groups", "t09_correlations", "k07_monthly_scorecard", "q08_profit_by_product", "h_lorenz", "hf_customers_top", "f09_months", "p06_date_dimension", "d11_tukey_by_category", "c11_rejections", "c18_clean", "c13_repaired", "c19_summary"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    want = con.sql(ORACLES[name]).fetchall()
    columns = con.sql(f"DESCRIBE {ORACLES[name]}").fetchall()
    order = [c[0] for c in columns]
    norm = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert sorted(got.columns) == sorted(order)
    assert norm(tuple(r) for r in got.select(*order).collect()) == norm(want)


def test_filters_are_bound_and_whitelisted(spark):
    assert library.where() == ("1 = 1", {})
    condition, args = library.where(start="1996-01-01", regions=("O'Brien", "ASIA"), segments=("BUILDING",))
    assert "Brien" not in condition and set(args.values()) == {"1996-01-01", "1996-01", "O'Brien", "ASIA", "BUILDING"}
    count = lambda **f: (lambda c, a: model.run(spark, D, f"SELECT COUNT(*) AS n FROM fact_transactions WHERE {c}", a).first().n)(*library.where(**f))
    every = count()
    assert 0 < count(regions=("ASIA",)) < every and count(regions=("ASIA", "EUROPE")) == count(regions=("ASIA",)) + count(regions=("EUROPE",))
    for hostile in ("\\') OR (1=1) --", "x' OR '1'='1", "\\", "'; DROP TABLE x; --"):
        assert count(regions=(hostile,)) == 0 and count(categories=(hostile,), segments=(hostile,)) == 0
    with pytest.raises(KeyError):
        library.breakdown("customer_id; DROP TABLE x")


def test_parsers(spark):
    rows = [("$1,200.50", "2024-01-15", "n/a"), ("1 300", "15/02/2024", "cust_001"), ("12.5%", "2024-13-45", "CUST 1"), ("abc", "", None), ("1300d", "31/02/2024", "x"), ("-100", "1/2/2024", "CUST-123456")]
    df = spark.createDataFrame(rows, "n string, d string, c string")
    from pyspark.sql import functions as F

    got = df.select(cleaning.number(F.col("n")), cleaning.date(F.col("d")).cast("string"), cleaning.customer_id(F.col("c"))).collect()
    assert [r[0] for r in got] == [1200.5, 1300.0, 0.125, None, None, -100.0]
    assert [r[1] for r in got] == ["2024-01-15", "2024-02-15", None, None, None, "2024-02-01"]
    assert [r[2] for r in got] == [None, "CUST-00001", "CUST-00001", None, None, "CUST-123456"]


def test_deduplicate_keeps_the_first(spark):
    rows = [(2, "A", "2024-01-01", 1.0), (1, "A", "2024-01-01", 1.0), (3, "B", "2024-01-01", 1.0), (4, None, None, None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, transaction_date string, quantity double").selectExpr("*", "'C' AS customer_id", "'P' AS product_id", "1.0D AS unit_price", "0.0D AS discount")
    assert sorted(r.seq for r in cleaning.deduplicate(df).collect()) == [1, 4]


def test_distributions():
    assert dist.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert dist.chi_square_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert dist.t_quantile(0.95, 30) == pytest.approx(2.0423, abs=1e-3)
    assert dist.wilson(0, 30)[0] == 0.0 and dist.wilson(45, 100)[1] > 0.45
    t, df, p = dist.welch((8, 5.0, 4.57), (8, 5.0, 4.57))
    assert t == 0 and p == pytest.approx(1)
    assert math.isclose(dist.anova([(5, 1.0, 1.0), (5, 5.0, 1.0), (5, 9.0, 1.0)])[2], 160 / 172)


#: Output columns of the named queries: what their users read.
COLUMNS = {"q01": 14, "q02": 10, "q03": 14, "q04": 7, "q05": 13, "q06": 8, "q07": 13, "q08": 14, "q09": 11, "q10": 11, "q11": 13, "q12": 7, "q13": 10, "q14": 8, "q15": 5, "q16": 9, "q17": 12, "q18": 10, "q19": 15, "q20": 6, "q21": 9, "q22": 10, "q23": 5, "q24": 7, "q25": 7, "q26": 6, "q27": 6, "q28": 21, "q29": 7}


def test_named_queries_are_complete(spark):
    for name, sql in library.NAMED.items():
        assert len(model.run(spark, D, sql).columns) == COLUMNS[name[:3]], name
    assert len(COLUMNS) == len(library.NAMED) == 29


def test_ranks_in_two_levels_equal_plain_windows(spark):
    rows = [(i, v) for i, v in enumerate([5.0, -3.0, 0.0, 5.0, None, 1e9, 0.001, -1e6, 5.0, 2.0, None, 7.25, -3.0])]
    spark.createDataFrame(rows, "id long, x double").createOrReplaceTempView("own_rows")
    for down in (True, False):
        way = "DESC NULLS LAST" if down else "ASC NULLS FIRST"
        got = spark.sql(f"WITH {library.ordered('o', 'own_rows', 'x', 'c.id', down)} SELECT id, o_rank, o_at, o_n, {library.tile('o_at', 'o_n', 5)} AS tile FROM o").collect()
        want = spark.sql(f"SELECT id, RANK() OVER (ORDER BY x {way}) AS r, ROW_NUMBER() OVER (ORDER BY x {way}, id) AS a, COUNT(*) OVER () AS n, NTILE(5) OVER (ORDER BY x {way}, id) AS t FROM own_rows").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_warehouse_gives_the_same_results(spark, tmp_path):
    model.build(spark, D, str(tmp_path))
    for name in ("q05_revenue_by_region", "q22_budget_variance", "q26_receivables_aging", "hf_monthly"):
        sql, args = library.SQL[name], library.BOUND.get(name)
        rows = lambda df: sorted(map(repr, df.collect()))
        own = model.run(spark, D, sql, args, warehouse=str(tmp_path))
        assert rows(own) == rows(model.run(spark, D, sql, args)), name
    plan = model.run(spark, D, "SELECT SUM(revenue) AS r FROM fact_transactions WHERE year_month = '1996-03'", warehouse=str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan and "Join" not in plan


def test_assembled_tests_agree_with_direct_computation(spark):
    rows = {r.name: r for r in significance.h_tests(spark, D).collect()}
    assert len(rows) == 7
    fact = model.run(spark, D, "SELECT region, is_weekend, CAST(revenue AS DOUBLE) AS x FROM fact_transactions").toPandas()
    a, b = fact.x[fact.is_weekend == 1].to_numpy(), fact.x[fact.is_weekend == 0].to_numpy()
    t, df, p = dist.welch((len(a), a.mean(), a.var(ddof=1)), (len(b), b.mean(), b.var(ddof=1)))
    r = rows["weekend_effect"]
    assert (r.statistic, r.df, r.p_value) == pytest.approx((t, df, p), rel=1e-6) and r.n == len(fact)
    rank = fact.x.rank().to_numpy()
    ties = sum(float(c) ** 3 - c for c in fact.x.value_counts())
    u, u_p, _ = dist.mann_whitney(len(a), rank[(fact.is_weekend == 1).to_numpy()].sum(), len(b), ties)
    assert (r.rank_statistic, r.rank_p) == pytest.approx((u, u_p), rel=1e-6)
    z = [abs(g - np.median(g)) for g in (a, b)]
    assert r.levene_p == pytest.approx(dist.anova([(len(g), g.mean(), g.var(ddof=1)) for g in z])[1], rel=1e-4)
    lt, _, lp = dist.welch(*[(len(g), np.log(g).mean(), np.log(g).var(ddof=1)) for g in (a, b)])
    assert (r.log_scale_t, r.log_scale_p) == pytest.approx((lt, lp), rel=1e-3)
    groups = [g.to_numpy() for _, g in fact.groupby("region").x]
    f, p, eta = dist.anova([(len(g), g.mean(), g.var(ddof=1)) for g in groups])
    r = rows["regions_anova"]
    assert (r.statistic, r.p_value, r.effect_size) == pytest.approx((f, p, eta), rel=1e-4) and r.magnitude == dist.magnitude("eta", eta)
    assert all(0 <= r.p_value <= 1 and r.magnitude in ("negligible", "small", "medium", "large") for r in rows.values())


def test_correlations_and_intervals(spark):
    fact = model.run(spark, D, "SELECT CAST(quantity AS DOUBLE) AS a, CAST(revenue AS DOUBLE) AS b FROM fact_transactions").toPandas()
    r = {r.pair: r for r in significance.h_correlations(spark, D).collect()}
    assert len(r) == 11
    own = r["quantity vs revenue"]
    assert own.pearson_r == pytest.approx(fact.a.corr(fact.b), abs=1e-5) and own.spearman_rho == pytest.approx(fact.a.rank().corr(fact.b.rank()), abs=1e-5)
    got = {r.name: r for r in significance.t06_intervals(spark, D).collect()}
    assert len(got) == 8 and all(r.low <= r.estimate <= r.high for r in got.values())
    half = dist.t_quantile(0.95, len(fact) - 1) * fact.b.std() / len(fact) ** 0.5
    assert got["Average transaction value"].high - got["Average transaction value"].estimate == pytest.approx(half, rel=1e-6)


def test_labels():
    assert [dist.magnitude("d", x) for x in (0.1, -0.3, 0.6, 2)] == ["negligible", "small", "medium", "large"]
    assert [dist.strength(x) for x in (0.05, -0.2, 0.4, 0.6, -0.9)] == ["negligible", "weak negative", "moderate positive", "strong positive", "very strong negative"]


def test_files_and_scripts(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,d,v\n1,2024-01-05,NULL\n2,,x\nNA,2024-02-01,nan\n")
    raw = files.read_raw_csv(spark, str(tmp_path / "in.csv"), ["id", "d", "v"]).collect()
    assert [tuple(r) for r in raw] == [("1", "2024-01-05", None), ("2", None, "x"), ("NA", "2024-02-01", None)]
    typed = files.read_typed_csv(spark, str(tmp_path / "in.csv"), "id string, d date, v string").collect()
    assert typed[1].d is None and str(typed[0].d) == "2024-01-05"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    for kind in ("parquet", "csv", "json"):
        files.write(df, str(tmp_path / kind), kind)
        files.write(df, str(tmp_path / kind), kind, mode="append")
        assert spark.read.format(kind).options(header="true").load(str(tmp_path / kind)).count() == 4
    (tmp_path / "e.json").write_text('[{"event_id": 1, "scope": "ASIA"},\n {"event_id": 2, "scope": "Company-wide"}]')
    assert [r.scope for r in files.read_json(spark, str(tmp_path / "e.json"), "event_id long, scope string").orderBy("event_id").collect()] == ["ASIA", "Company-wide"]
    scripts.run_script(spark, "-- nothing here\n;CREATE OR REPLACE TEMP VIEW sv AS SELECT 1 AS one;\n-- a comment; with a semicolon\nCREATE OR REPLACE TEMP VIEW sw AS SELECT ';' AS c, one FROM sv;")
    assert tuple(spark.table("sw").first()) == (";", 1)
    (tmp_path / "q.sql").write_text("-- name: first\n-- description: One thing,\n--   told in two lines.\nSELECT COUNT(*) AS n\nFROM fact_transactions;\n\n-- name: second\nSELECT region FROM fact_transactions WHERE region = :r;\n")
    library_ = scripts.load_queries(str(tmp_path / "q.sql"))
    assert list(library_) == ["first", "second"] and library_["first"].description == "One thing, told in two lines." and not library_["second"].sql.endswith(";")
    assert scripts.run_named(spark, D, library_, "first").first().n == 6000
    rows, truncated = scripts.run_capped(spark, D, library_, "second", 10, {"r": "ASIA"})
    assert rows.count() == 10 and truncated
    with pytest.raises(KeyError, match="first"):
        scripts.run_named(spark, D, library_, "third")
