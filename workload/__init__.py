"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function and, where there is one, its SQL twin."""

    def register(build: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


class Tables:
    """Tables of one folder, read when used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        from lotwise.session import prepare

        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        from lotwise.sources.tables import read_table

        if name.startswith("_"):
            raise AttributeError(name)
        df = read_table(self.spark, self.folder, name)
        if name in ("documents", "pages", "conversations") and self.spark.sparkContext.master.startswith("local"):
            # On one machine these tables are one file, and so one task; a cluster's files are many.
            return df.repartition(self.spark.sparkContext.defaultParallelism)
        return df


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"workload.{name}")


MODULES = ["valuation", "search", "text", "history", "duplicates", "pages", "joins", "quality"]
