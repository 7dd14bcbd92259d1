"""Reading untyped extracts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULLS = ("", "nan", "NaN", "None", "NULL")


def read_raw_csv(spark: SparkSession, path: str, columns: list[str], nulls=NULLS) -> DataFrame:
    """All columns as text, never inferred; the spellings of nothing become null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*[F.when(~F.col(c).isin(*nulls), F.col(c)).alias(c) for c in columns])


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by a given schema; empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", dateFormat="yyyy-MM-dd")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document (an array of records, on any number of lines) by a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Overwrite path with, or append to it, parquet, csv (with a header) or json lines."""
    df.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: What a document of events holds: fixed values, the names of its fields.
EVENTS = "events array<struct<event_id: string, kind: string, start: date, end: date, scope: map<string, string>, description: string>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """event_id, kind, start, end, scope (a value that flags are to name, or null for all) and description, from JSON documents.

    A document without events gives no rows; fields that are missing are null; further ones are left out.
    """
    found = spark.read.schema(EVENTS).option("multiLine", True).json(path).select(F.explode("events").alias("e"))
    return found.select("e.event_id", "e.kind", "e.start", "e.end", F.get(F.map_values("e.scope"), 0).alias("scope"), "e.description")
