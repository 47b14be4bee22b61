"""Exact ranks and top-k over any number of rows, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that part rows into ranges: 16 ** 3 of them, so their counts are a small table.
PREFIX = 3


def rank_by_hash(df: DataFrame, hashed: Column, tie: str, out: str = "rank") -> DataFrame:
    """Adds a 1-based global rank in the order of a hex hash (ties by `tie`). Rows are ranked within hash prefixes and
    start at the number of rows before their prefix (a table of at most 16 ** PREFIX rows)."""
    keyed = df.withColumn("__hash", hashed).withColumn("__prefix", F.substring("__hash", 1, PREFIX))
    counts = keyed.groupBy("__prefix").agg(F.count("*").alias("__n"))
    before = counts.select("__prefix", F.coalesce(F.sum("__n").over(Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__prefix").orderBy("__hash", tie))
    ranked = keyed.withColumn("__within", within).join(F.broadcast(before), "__prefix")  # at most 16 ** PREFIX rows
    return ranked.withColumn(out, (F.col("__before") + F.col("__within")).cast("bigint")).drop("__hash", "__prefix", "__n", "__before", "__within")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, out: str = "rank") -> DataFrame:
    """The first k rows of each group (None: all) with their 1-based rank; Spark limits each task's groups before the
    exchange."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked if k is None else ranked.where(F.col(out) <= k)
