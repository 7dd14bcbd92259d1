"""One way to tables wherever they lie (folders or a database), documents of nested results, and pivots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a document's part, and columns that a pivot may make.
MOST_ROWS, MOST_COLUMNS = 100_000, 1_000


def is_database(url: str) -> bool:
    return url.startswith("jdbc:")


def read(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int | None = None, **options: str) -> DataFrame:
    """The table at url: Parquet below a folder, or a database's by JDBC.

    With key (a whole number or date), a database is read by `parts` tasks, each with a range of the key between its least
    and largest value, which the database is asked for first; rows without a key go with the first range. Without key, or
    where the table is empty, one task reads it.
    """
    if not is_database(url):
        return spark.read.parquet(f"{url.rstrip('/')}/{table}")
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key:
        ask = spark.read.format("jdbc").options(url=url, **options)
        lo, hi = ask.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
        if lo is not None:
            n = parts or spark.sparkContext.defaultParallelism
            reader = reader.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(n))
    return reader.option("dbtable", table).load()


def write(df: DataFrame, url: str, table: str, mode: str = "overwrite", key: str | None = None, **options: str) -> None:
    """Put df into the table at url, whole or not at all.

    A folder is written by Spark's own commit. For a database, tasks fill a second table, since each of them commits by
    itself; one transaction then moves its rows over: all of them in place of the old ones (overwrite), beside them
    (append), or in place of the rows with the same key (append with key), so that an append that is repeated changes nothing.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode: overwrite or append")
    if not is_database(url):
        df.write.mode(mode).parquet(f"{url.rstrip('/')}/{table}")
        return
    spark, staged = df.sparkSession, f"{table}_new"
    put = lambda d, name: d.write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()
    put(df, staged)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, *((options["user"], options["password"]) if "user" in options else ()))
    try:
        schema = options.get("schema")
        exists = connection.getMetaData().getTables(None, schema, table.upper() if connection.getMetaData().storesUpperCaseIdentifiers() else table, None).next()
        if not exists:
            put(df.limit(0), table)
        connection.setAutoCommit(False)
        run = connection.createStatement().executeUpdate
        columns = ", ".join(f'"{c}"' for c in df.columns)
        if mode == "overwrite":
            run(f"DELETE FROM {table}")
        elif key:
            run(f'DELETE FROM {table} WHERE "{key}" IN (SELECT "{key}" FROM {staged})')
        run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged}")
        run(f"DROP TABLE {staged}")
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_document(parts: dict[str, DataFrame], path: str, **facts: str) -> None:
    """One JSON document of several results, each an array of nested rows, with a manifest (schema and number of rows of each, and facts).

    Results are reports: one of over MOST_ROWS rows is refused, not cut. An empty result is an empty array.
    """
    spark = next(iter(parts.values())).sparkSession
    counts = {name: df.limit(MOST_ROWS + 1).count() for name, df in parts.items()}
    if large := [name for name, n in counts.items() if n > MOST_ROWS]:
        raise ValueError(f"too many rows for a document: {large}")
    manifest = {"parts": {name: {"rows": counts[name], "schema": json.loads(df.schema.json())} for name, df in parts.items()}, "facts": facts}
    whole = spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
    text = lambda row: F.to_json(row, {"ignoreNullFields": "false"})
    by_text = lambda a, b: F.when(text(a) < text(b), -1).when(text(a) > text(b), 1).otherwise(0)
    for name, df in parts.items():
        each = F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
        whole = whole.crossJoin(df.agg(F.array_sort(each, by_text).alias(name)))  # one row each
    whole.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_document(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The results of a document, read by the schemas in its manifest, and its facts."""
    manifest = json.loads(spark.read.schema("manifest string").json(path).first()["manifest"])
    kinds = {name: T.StructType.fromJson(p["schema"]) for name, p in manifest["parts"].items()}
    schema = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])
    whole = spark.read.schema(schema).json(path)
    out = {name: whole.select(F.inline(name)) for name in kinds}
    for name, p in manifest["parts"].items():
        if out[name].count() != p["rows"]:
            raise ValueError(f"{name} has not the rows that its manifest states")
    return out, manifest["facts"]


def pivot(df: DataFrame, rows: list[str], column: str, value: Column, most: int = MOST_COLUMNS) -> DataFrame:
    """rows, and one column for each value of `column` with the aggregate of its rows, in order; the values are found in a first pass.

    Rows without a value in `column` count under "null". More than `most` different values are refused, not cut.
    """
    named = df.withColumn("name of a column", F.coalesce(F.col(column).cast("string"), F.lit("null")))
    found = [r[0] for r in named.select("name of a column").distinct().orderBy("name of a column").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return named.groupBy(*rows).pivot("name of a column", found).agg(value) if found else named.select(*rows).distinct()
