"""Partitioned Parquet tables, by leader, set, identity or block of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many numbers go in a block of each table.
BLOCKS = {"items": 256, "item_leaders": 16, "recipes": 100, "players": 64}


def block_of(number: Column, size: int) -> Column:
    return F.floor(number / size).cast("int")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), files: int = 8) -> None:
    """Write a table partitioned by columns. Rows of a value are spread over at most ``files`` tasks by hash, so that a hot
    value is no single task, and sorted inside each for tight statistics."""
    spread = df.withColumn("_spread", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    laid = spread.repartition(*by, "_spread").drop("_spread")
    laid.sortWithinPartitions(*by, *sort).write.mode("overwrite").partitionBy(*by).parquet(path)
