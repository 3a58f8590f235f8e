"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, per_task: int) -> int:
    """Tasks of about ``per_task`` rows of a table: their number follows the table, where that of a setting stays."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))


def dealt(df: DataFrame, per_task: int, *keys: str) -> DataFrame:
    """df dealt out by its keys to tasks of about ``per_task`` rows, however small they are."""
    return df.repartition(tasks_for(df, per_task), *keys)
