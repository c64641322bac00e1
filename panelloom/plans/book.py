"""A book of named queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, dates: str = "") -> None:
        """``dates``: columns that both sides return as text, since engines hand out dates as differing types."""
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        columns = dates.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns})

        self.queries[name] = run if columns else query
        if sql:
            texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
            self.sql[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if columns else sql

    def page(self, sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
        """Adds the function under its own name."""

        def run(query: Query) -> Query:
            self.add(query.__name__, query, sql, dates)
            return query

        return run
