"""Tables with a column for each value that is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.connect import pivot
from . import model

#: The bundled tables' ways of payment, for the checking engine, whose columns must be known. Fixed values.
PAYMENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def a18_revenue_by_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and year, a column for each way of payment."""
    df = model.ask(spark, sf_dir, "SELECT region, year, payment_type, revenue FROM fact_transactions")
    return pivot(df, ["region", "year"], "payment_type", F.sum("revenue").cast("double"))


QUERIES = {"a18_revenue_by_payment": a18_revenue_by_payment}
_EACH = ", ".join(f"CAST(SUM(revenue) FILTER (payment_type = '{p}') AS DOUBLE) AS \"{p}\"" for p in PAYMENTS)
ORACLES = {"a18_revenue_by_payment": model.oracle(f"SELECT region, year, {_EACH} FROM fact_transactions GROUP BY region, year")}
