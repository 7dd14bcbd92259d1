"""Ledger analytics on Spark: cleaning, star schema, named queries, indicators, statistics, series and anomalies."""
