"""The registry of queries and the SQL that checks them, and pieces of SQL that several need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return note


#: SQL for the approximate token count of a text, and for its words.
WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
TOKENS = "CAST(ceil(len(" + WORDS + ") * 1.3::DOUBLE) AS BIGINT)"
