"""A book of queries: each is registered with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


def r6(x: str, name: str | None = None) -> str:
    """Six decimals in the oracle's SQL, as ``floor6`` does in Spark."""
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name or x}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    from heedstream.sources.adapters import floor6

    return df.select(*[floor6(df[c].cast("double")).alias(c) if c in names else df[c] for c in df.columns])
