"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table's files dealt to one task for heavy work.
PIECE = 8 * 1024 * 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazily opened Parquet tables of one folder: ``tables.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *columns: str, piece: int = PIECE) -> DataFrame:
        """A table (or some columns of it) for heavy per-row work, dealt to tasks of bounded size.

        However large the file, a row group is read by a single task. So the rows are dealt out first:
        to all cores, or to as many tasks as the files have pieces.
        """
        df = getattr(self, name)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        rows = df.select(*columns) if columns else df
        parts = max(self.spark.sparkContext.defaultParallelism, -(-size // piece))
        # By all columns: dealing in turn would sort each task's rows first.
        return rows.repartition(parts, *rows.columns)


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name`` with its checking SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
