"""Deduplication and repairs by plans that grow with the rows, against the plain steps."""

import re

from pyspark.sql import functions as F

from ledgerspark.operators import cleaning

D = "/root/testdata/sf0.001"


def test_identical_rows_need_no_pass_of_their_own(spark):
    rows = cleaning.parse(cleaning.dirty(spark, D)).filter("seq % 20 = 0")
    rows = rows.unionByName(rows.withColumn("seq", F.col("seq") + 10**7)).unionByName(rows.withColumns({"seq": F.col("seq") - 10**7, "quantity": F.col("quantity") + 1}))
    same = lambda df: sorted(map(str, df.collect()))
    found = cleaning.deduplicate(rows)
    assert same(found) == same(cleaning.passes(rows)[-1][1])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_rows_do_not_gather_by_segment(spark):
    unique = cleaning.deduplicate(cleaning.parse(cleaning.dirty(spark, D))).filter("product_id IS NOT NULL")
    fixed = cleaning.repair(unique, *cleaning.masters(spark, D))
    assert "hashpartitioning(customer_segment" not in fixed._jdf.queryExecution().executedPlan().toString()
    assert fixed.count() == unique.count()


def _keyed(spark, rows):
    df = spark.createDataFrame(rows, "seq long, transaction_id string, transaction_date string, quantity double")
    return df.selectExpr("*", "'C' AS customer_id", "'P' AS product_id", "1.0D AS unit_price", "0.0D AS discount")


def test_rows_that_share_no_key_do_not_travel(spark):
    rows = cleaning.parse(cleaning.dirty(spark, D))
    held = cleaning.kept(rows.dropDuplicates(["transaction_id"]))
    found = cleaning.deduplicate(held)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(map(str, cleaning.passes(held)[-1][1].collect()))
    alone, shared = cleaning.parted(held.unionByName(held.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + 10**9)))
    tenth = held.filter("seq % 10 = 0").count()
    assert (alone.count(), shared.count()) == (held.count() - tenth, 2 * tenth) and tenth > 0


def test_rows_in_two_parts_are_deduplicated_as_a_whole(spark, monkeypatch):
    # 1, 2 share an id, 2, 3 a business key (so 3 stays, as 2 goes first), 4, 5 no id, 6, 7 zeros of both signs, 8 nothing
    rows = [(1, "A", "d1", 1.0), (2, "A", "d2", 2.0), (3, "B", "d2", 2.0), (4, None, "d3", 3.0), (5, None, "d4", 4.0), (6, "C", "d5", 0.0), (7, "D", "d5", -0.0), (8, "E", None, None)]
    df = _keyed(spark, rows)
    for most in (cleaning.MARKS, 1):
        monkeypatch.setattr(cleaning, "MARKS", most)
        assert sorted(r.seq for r in cleaning.deduplicate(df).collect()) == [1, 3, 4, 6, 8]
        assert sorted(r.seq for r in cleaning.deduplicate(df, cleaning.kept).collect()) == [1, 3, 4, 6, 8]


def test_a_parsed_row_is_compiled(spark):
    """The JVM only interprets a method of more than 8,000 bytes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = cleaning.parse(cleaning.dirty(spark, D))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))
    assert sizes and max(map(int, sizes)) < 8000


def test_rows_that_lack_nothing_do_not_travel_to_the_masters(spark):
    unique = cleaning.kept(cleaning.deduplicate(cleaning.parse(cleaning.dirty(spark, D))).filter("product_id IS NOT NULL"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        fixed = cleaning.repair(unique, *cleaning.masters(spark, D))
        plan = fixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(customer_id" not in plan and plan.count("hashpartitioning(product_id") <= 2  # the rows that lack something, and medians
    assert fixed.count() == unique.count()


def test_repairs_of_rows_that_lack_something(spark):
    columns = cleaning.parse(cleaning.dirty(spark, D)).columns
    full = {"transaction_id": "T", "customer_id": "CUST-1", "region": "R", "product_category": "C", "customer_segment": "S", "payment_type": "P", "quantity": 2.0, "unit_price": 5.0, "unit_cost": 3.0, "discount": 0.0, "revenue": 10.0, "cost": 6.0, "profit": 4.0}
    lost = {"unit_price": None, "revenue": None, "unit_cost": None, "cost": None}
    rows = [{"product_id": "A", "unit_price": 2.0}, {"product_id": "A", "unit_price": 4.0, "unit_cost": 1.0}, {"product_id": "A", "unit_price": 9.0}, {"product_id": "A"} | lost, {"product_id": "B"} | lost, {"product_id": "B", "unit_price": None, "unit_cost": None, "region": None}, {"product_id": "D", "product_category": None, "customer_id": None, "customer_segment": None}]
    df = spark.createDataFrame([tuple((full | r | {"seq": k}).get(c) for c in columns) for k, r in enumerate(rows)], cleaning.parse(cleaning.dirty(spark, D)).schema)
    products = spark.createDataFrame([("A", "MA", 100.0, 90.0), ("B", "MB", 7.0, 6.0), ("D", "MD", 1.0, 1.0)], "product_id string, m_category string, m_price double, m_cost double")
    customers = spark.createDataFrame([("CUST-1", "MR", "MS")], "customer_id string, m_region string, m_segment string")
    got = {r.seq: r for r in cleaning.repair(df, products, customers).collect()}
    assert sorted(got) == list(range(7))
    assert (got[3].unit_price, got[3].unit_cost, got[3].cost, got[3].fixed_price_median, got[3].fixed_price_solved) == (4.0, 3.0, 6.0, True, False)
    assert (got[5].unit_price, got[5].unit_cost, got[5].region, got[5].fixed_price_solved, got[5].fixed_cost_solved, got[5].fixed_region) == (5.0, 3.0, "MR", True, True, True)
    assert (got[4].unit_price, got[4].unit_cost) == (5.0, 3.0) and got[4].fixed_price_median  # the product's median, after the sums
    assert (got[6].product_category, got[6].customer_id, got[6].customer_segment, got[6].is_customer_attributed, got[6].fixed_category, got[6].fixed_segment_unknown) == ("MD", "UNATTRIBUTED", "Unknown", 0, True, True)
    assert not any(v for c, v in got[0].asDict().items() if c.startswith("fixed_"))
    # a master's key that is there twice gives its rows twice, complete ones too, as a join does
    twice = cleaning.repair(df, products.unionByName(products.filter("product_id = 'A'")), customers)
    assert sorted(r.seq for r in twice.collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6]
