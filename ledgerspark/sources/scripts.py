"""SQL scripts and files of named queries.

A script is a run of statements; a query file holds blocks that start with `-- name:` and may say `-- description:`.
Statements end at semicolons outside of quotes and comments.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..plans import model

TOKEN = re.compile(r"--[^\n]*|'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|;|[^;'\"-]+|.", re.S)


class Query(NamedTuple):
    sql: str
    description: str


def statements(text: str) -> list[str]:
    """The statements of a script, without comments; what holds none is left out."""
    out = [""]
    for t in TOKEN.findall(text):
        if t == ";":
            out.append("")
        elif not t.startswith("--"):
            out[-1] += t
    return [s.strip() for s in out if s.strip()]


def run_script(spark: SparkSession, text: str) -> None:
    """Run the statements in order; the first that fails ends the script."""
    for s in statements(text):
        spark.sql(s)


def load_queries(path: str) -> dict[str, Query]:
    with open(path, encoding="utf-8") as f:
        parts = re.split(r"^--[ \t]*name:[ \t]*(\S+)[ \t]*$", f.read(), flags=re.M)
    out = {}
    for name, body in zip(parts[1::2], parts[2::2], strict=True):
        lead = re.match(r"(?:\s*--[^\n]*\n)*", body)[0]
        said = " ".join(x.strip().lstrip("-").strip() for x in lead.splitlines() if x.strip())
        out[name] = Query(statements(body)[0], re.sub(r"^description:\s*", "", said))
    return out


def run_named(spark: SparkSession, sf_dir: str, queries: dict[str, Query], name: str, args: dict[str, str] | None = None) -> DataFrame:
    """A query of a file by its name; only names that the file has are run, and args are bound."""
    if name not in queries:
        raise KeyError(f"unknown query {name}; one of {', '.join(queries)}")
    return model.run(spark, sf_dir, queries[name].sql, args)


def run_capped(spark: SparkSession, sf_dir: str, queries: dict[str, Query], name: str, limit: int = 500, args: dict[str, str] | None = None) -> tuple[DataFrame, bool]:
    """At most `limit` rows of a named query, and whether it has more."""
    df = run_named(spark, sf_dir, queries, name, args)
    return df.limit(limit), df.limit(limit + 1).count() > limit
