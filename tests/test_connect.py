"""Tables in folders and in an embedded database, documents and pivots."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources import connect


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_database_and_a_folder_hold_the_same(spark, url, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("g"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("é'"), F.col("id"))).alias("s"))
    for at in (url, str(tmp_path)):
        connect.write(df, at, "facts")
        assert rows(connect.read(spark, at, "facts")) == rows(df)
        connect.write(df.limit(10), at, "facts")
        assert connect.read(spark, at, "facts").count() == 10
        connect.write(df.filter("k > 990"), at, "facts", "append")
        assert connect.read(spark, at, "facts").count() == 19
    with pytest.raises(ValueError):
        connect.write(df, url, "facts", "ignore")


def test_a_database_is_read_by_ranges(spark, url):
    df = spark.range(1000).select(F.col("id").alias("K"), (F.col("id") * 2).alias("X"))
    connect.write(df, url, "facts")
    got = connect.read(spark, url, "facts", key="\"K\"", parts=5)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == 5 and len(sizes) == 5 and max(sizes) < 300 and rows(got) == rows(df)
    assert connect.read(spark, url, "facts").rdd.getNumPartitions() == 1
    connect.write(df.limit(0), url, "facts")
    assert connect.read(spark, url, "facts", key="\"K\"").count() == 0


def test_a_repeated_append_changes_nothing_and_a_failed_one_neither(spark, url):
    df = spark.range(100).select(F.col("id").alias("K"), F.lit(1).alias("X"))
    connect.write(df, url, "facts")
    new = spark.range(90, 120).select(F.col("id").alias("K"), F.lit(2).alias("X"))
    for _ in range(2):
        connect.write(new, url, "facts", "append", key="K")
        got = {r.K: r.X for r in connect.read(spark, url, "facts").collect()}
        assert len(got) == 120 == connect.read(spark, url, "facts").count() and got[95] == 2 and got[5] == 1
    before = rows(connect.read(spark, url, "facts"))
    with pytest.raises(Exception):
        connect.write(new.withColumn("NO_SUCH", F.lit(1)), url, "facts", "overwrite")
    assert rows(connect.read(spark, url, "facts")) == before


def test_documents_come_back_as_they_were(spark, tmp_path):
    nested = spark.createDataFrame([(1, {"a": [1.5, None]}, ("x", 2)), (2, None, None)], "id int, m map<string, array<double>>, s struct<p: string, q: long>")
    parts = {"summary": spark.range(3).withColumn("d", F.lit("2020-01-02").cast("date")), "nested": nested, "none": spark.range(0)}
    connect.write_document(parts, str(tmp_path / "d"), made_by="a test")
    got, facts = connect.read_document(spark, str(tmp_path / "d"))
    assert facts == {"made_by": "a test"} and set(got) == set(parts)
    for name, df in parts.items():
        assert got[name].dtypes == df.dtypes and rows(got[name]) == rows(df), name
    with pytest.raises(ValueError):
        connect.write_document({"large": spark.range(connect.MOST_ROWS + 1)}, str(tmp_path / "e"))


def test_pivots_find_their_columns(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4), ("c", "x", None)], "g string, c string, v int")
    got = connect.pivot(df, ["g"], "c", F.sum("v"))
    assert got.columns == ["g", "null", "x", "y"] and rows(got) == [("a", None, 4, 2), ("b", 4, None, None), ("c", None, None, None)]
    assert connect.pivot(df.limit(0), ["g"], "c", F.sum("v")).columns == ["g"]
    with pytest.raises(ValueError):
        connect.pivot(df, ["g"], "c", F.sum("v"), most=2)
