"""Registered queries: each a plan over tables of a folder, most with the SQL of an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute; Parquet columns are pruned by what a plan uses."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``plan(tables)`` under ``name``."""

    def put(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return put


def quoted(text: str | None) -> str:
    """A SQL literal."""
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'" if "\n" not in text else "(" + " || chr(10) || ".join(quoted(p) for p in text.split("\n")) + ")"
