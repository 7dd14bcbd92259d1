"""What a query writes before it is answered: the columns that it uses of the facts that it reads more than once, nothing else."""

import os
import re
import shutil

from ledgerspark.plans import library, model
from ledgerspark.plans.anomaly import SERIES
from ledgerspark.sources.shared import shared_dir

D = "/root/testdata/sf0.001"


def test_a_query_writes_its_own_columns_and_no_ledger(spark, tmp_path):
    own = str(tmp_path / "t")
    shutil.copytree(D, own)  # tables of their own, so that no test before has written their ledger
    before = set(os.listdir(shared_dir(spark)))
    once = model.ask(spark, own, "SELECT region, SUM(revenue) AS r FROM fact_transactions GROUP BY 1")
    assert once.count() == 5 and set(os.listdir(shared_dir(spark))) == before
    rows = lambda df: sorted(map(str, df.collect()))
    for sql, args in ((SERIES, None), (library.SQL["hf_customers_summary"], library.BOUND["hf_customers_summary"])):
        assert rows(model.ask(spark, own, sql, args)) == rows(model.run(spark, own, sql, args))
    new = set(os.listdir(shared_dir(spark))) - before
    assert new and not any(name.startswith("ledger-") for name in new)
    written = model.slices(spark, own, SERIES)
    columns = spark.read.parquet(written["fact_transactions"]).columns
    assert "revenue" in columns and not {"payment_type", "product_name", "day_of_week", "unit_price", "order_id"} & set(columns)


def test_a_star_takes_all_columns(spark):
    for sql in ("WITH f AS (SELECT * FROM fact_transactions) SELECT COUNT(*) AS n FROM f", "WITH f AS (SELECT t.*, ABS(profit) AS p FROM fact_transactions t) SELECT COUNT(*) AS n FROM f", "WITH f AS (SELECT *, ABS(profit) AS p FROM fact_transactions) SELECT COUNT(unit_cost) AS n FROM f"):
        found = model.slices(spark, D, sql)["fact_transactions"]
        assert "payment_type" in spark.read.parquet(found).columns


def test_no_table_that_grows_is_broadcast(spark):
    """Small as they are here, orders, customers and parts meet the lines by shuffles, and orders meet customers first; the rows stay those of the plain joins."""
    df = model.run(spark, D, "SELECT order_id, line_number, customer_id, product_id, region, product_category, month_start, revenue, cost FROM fact_transactions")
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"SortMergeJoin \[(\w+)#|BroadcastHashJoin \[(\w+)#", plan)
    assert [a for a, _ in joins if a] == ["l_partkey", "l_orderkey", "o_custkey"] or [a for a, _ in joins if a] == ["product_id", "l_orderkey", "o_custkey"]
    assert {b for _, b in joins if b} == {"c_nationkey", "n_regionkey"}
    plain = spark.sql(f"""SELECT order_id, line_number, customer_id, product_id, r_name, p_type, month_start, gross_revenue - discount_amount AS revenue, CAST(ROUND(CAST(quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.90 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS cost
FROM ({model.relations(model.SPARK)["base_lines"]}) b JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON product_id = p_partkey""")
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert rows(df) == rows(plain)
    for name in ("fact_operating_expenses", "fact_marketing_spend", "fact_employee_costs"):
        plan = model.run(spark, D, f"SELECT * FROM {name}")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [l_orderkey" in plan
