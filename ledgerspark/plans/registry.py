"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning
from . import analytics, anomaly, apart, bitmaps, library, model, pivots, regression, seasonal, significance, spread


def _run(sql: str, args: dict[str, str] | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ask(spark, sf_dir, sql, args)


def _query(sql: str, args: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return partial(_run, sql, args)


SQL = {**library.SQL, **analytics.SQL}
BOUND = library.BOUND  # queries with parameters, and what they are bound to
QUERIES = {name: _query(sql, BOUND.get(name)) for name, sql in SQL.items()} | cleaning.QUERIES | regression.QUERIES | seasonal.QUERIES | significance.QUERIES | anomaly.QUERIES | spread.QUERIES | bitmaps.QUERIES | pivots.QUERIES
ORACLES = {name: model.oracle(sql, BOUND.get(name)) for name, sql in SQL.items()} | cleaning.ORACLES | anomaly.ORACLES | seasonal.ORACLES | bitmaps.ORACLES | pivots.ORACLES | apart.ORACLES
