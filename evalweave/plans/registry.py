"""Registered queries: a Spark builder and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(builder: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name!r} is registered twice")
        BUILDERS[name] = builder
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return register
