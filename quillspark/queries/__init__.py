"""Registered queries over the operators, and DuckDB SQL that says the same."""

from quillspark.queries import history, reduction, schemas, texts, tools  # noqa: F401 they register their queries
from quillspark.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
