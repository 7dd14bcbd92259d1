"""Exact numbers of different customers that can be added up: bitmaps of customers by month.

One pass over the ledger makes a bitmap for each month and bucket of 32,768 ids (4 kB). Years, retention and new customers
follow from unions of these, without the ledger: two sets have |A| + |B| - |A or B| members in common.

Defined cases: rows without a customer are left out; ids are whole numbers, and `dense` numbers any others from 1 on, so
that bitmaps have no gaps; months, years and buckets that are empty have no row; an empty ledger gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..sources.shared import cut
from . import library, model


def dense(df: DataFrame, key: str) -> DataFrame:
    """df with `id`: the place of its key among the different keys, from 1 on; rows without a key are left out."""
    names = ranked(df.select(key).filter(F.col(key).isNotNull()).distinct(), F.col(key).asc(), name="id")
    return df.join(names, key)


def bitmaps(df: DataFrame, key: str, *by: str) -> DataFrame:
    """by, bucket, bits: the set of keys of each group."""
    own = df.filter(F.col(key).isNotNull()).select(*by, F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    return own.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def united(sets: DataFrame, *by: str) -> DataFrame:
    """The union of the sets of each group."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, *by: str) -> DataFrame:
    """by and n, the number of members of disjoint buckets."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of the customers of each month, held in the shared folder."""
    sql = "SELECT year, month_start, customer_id FROM fact_transactions WHERE is_customer_attributed = 1"
    return cut(bitmaps(model.ask(spark, sf_dir, sql), "customer_id", "year", "month_start"))


def retention(years: DataFrame) -> DataFrame:
    """year, before, retained: the customers of the year before and how many of them are there again."""
    size = counted(years, "year")
    both = years.select("year", "bucket", "bits").unionByName(years.select((F.col("year") - 1).alias("year"), "bucket", "bits"))
    either = counted(united(both, "year"), "year").withColumnRenamed("n", "either")
    after = size.select((F.col("year") - 1).alias("year"), F.col("n").alias("after"))
    met = size.join(either, "year").join(after, "year", "left")
    return met.select((F.col("year") + 1).alias("year"), F.col("n").alias("before"), (F.col("n") + F.coalesce("after", F.lit(0)) - F.col("either")).alias("retained"))


def newcomers(years: DataFrame) -> DataFrame:
    """year and how many customers had not been there in any year before; each set goes to the few years from its own on."""
    all_years = years.select("year").distinct().withColumnRenamed("year", "upto")
    reach = years.join(F.broadcast(all_years), F.col("upto") >= F.col("year")).select("upto", "bucket", "bits")
    known = counted(united(reach, "upto"), "upto")
    before = F.lag("n", 1, 0).over(Window.orderBy("upto"))  # one row a year
    return known.select(F.col("upto").alias("year"), (F.col("n") - before).alias("new_customers"))


def k02_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retention(united(months(spark, sf_dir), "year"))
    return found.select("year", "before", "retained", F.expr(library.pct("retained", "before")).alias("retention_pct"))


def k03_new_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newcomers(united(months(spark, sf_dir), "year")).filter("new_customers > 0")


def a03_active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active customers of every month, year and of all time, from one pass over the ledger."""
    own = months(spark, sf_dir)
    levels = (("month", F.col("month_start").cast("string")), ("year", F.col("year").cast("string")), ("all", F.lit("all")))
    each = own.select(F.explode(F.array(*(F.struct(F.lit(level).alias("level"), period.alias("period")) for level, period in levels))).alias("e"), "bucket", "bits")
    return counted(united(each.select("e.*", "bucket", "bits"), "level", "period"), "level", "period").withColumnRenamed("n", "customers")


_ACTIVE = """WITH f AS (SELECT year, month_start, customer_id FROM fact_transactions WHERE is_customer_attributed = 1)
SELECT 'month' AS level, CAST(month_start AS VARCHAR) AS period, COUNT(DISTINCT customer_id) AS customers FROM f GROUP BY 2
UNION ALL SELECT 'year', CAST(year AS VARCHAR), COUNT(DISTINCT customer_id) FROM f GROUP BY 2
UNION ALL SELECT 'all', 'all', COUNT(DISTINCT customer_id) FROM f HAVING COUNT(*) > 0"""
QUERIES = {"k02_retention": k02_retention, "k03_new_customers": k03_new_customers, "a03_active_customers": a03_active_customers}
ORACLES = {"a03_active_customers": model.oracle(_ACTIVE)}
