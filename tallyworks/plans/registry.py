"""The queries by name, each with its SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import domain, oracle

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def add(name: str, tables: list[str], run: Callable[..., DataFrame], sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(*[domain(spark, sf_dir, t) for t in tables])

    FOUND[name] = (query, oracle(f"SELECT * FROM ({sql})" if sql.startswith("WITH ") else sql, *tables) if sql else None)


def quoted(text: str) -> str:
    """As an SQL literal."""
    return "'" + text.replace("'", "''") + "'"
