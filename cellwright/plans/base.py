"""How queries and their SQL twins are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    """Round columns, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def pick(df: DataFrame, keys: list[str], values: list[str] = (), digits: int = DIGITS) -> DataFrame:
    return rounded(df.select(*keys, *values), *values, digits=digits)


def r(x: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL for a rounded column."""
    return f"round({x}, {digits}) + 0e0 as {name or x.rpartition('.')[2]}"


def rs(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Decorator: register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


__all__ = ["Column", "DIGITS", "DataFrame", "Registry", "pick", "r", "rounded", "rs"]
