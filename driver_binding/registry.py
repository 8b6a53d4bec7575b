"""Collects each query with the SQL that states the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_binding.catalogue import Bound, bind
from driver_binding.oracle import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers and flags as bigint, string lists as text."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("boolean", "int", "smallint", "tinyint"):
            columns.append(F.col(name).cast("bigint").alias(name))
        elif kind == "array<string>":
            columns.append(F.array_join(name, "\n").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``make(bound)`` under a name; no SQL leaves the rows-only check."""

    def register(make: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(make(bind(spark, sf_dir)))
        if sql is not None:
            SQL[name] = state(sql, extra)
        return make

    return register
