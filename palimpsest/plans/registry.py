"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.catalog import BASE_SQL, Tables

#: the instant all time-dependent queries take as now
NOW = "2026-02-01 00:00:00"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, base: bool = True):
        """Registers a function of ``Tables`` under its name; ``base``: the twin starts with the
        distinct-row views of the catalog."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                text = sql.replace("$NOW", f"TIMESTAMPTZ '{NOW}+00'")
                self.sql[f.__name__] = (BASE_SQL + ("," if text.lstrip().startswith("+") else "") + text.lstrip().removeprefix("+")) if base else text
            return f

        return add
