"""Character budgets as running sums: a row is kept, or cut, by what stands before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(df: DataFrame, group: list[str], order: list[Column], content: str, most: int) -> DataFrame:
    """Rows of a group in order until ``most`` characters; the last one is cut. Separators don't count."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(content)).over(before), F.lit(0))
    return df.withColumn("_start", start).filter(F.col("_start") < most).withColumn(content, F.col(content).substr(F.lit(1), (F.lit(most) - F.col("_start")).cast("int"))).drop("_start")


def even(total: Column, most: int) -> Column:
    """At most ``most`` positions spread evenly over ``total``; halves go to the even neighbour."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.bround(p * (total - 1) / (most - 1)).cast("long"))
    return F.when(total <= most, F.sequence(F.lit(0).cast("long"), (total - 1).cast("long"))).otherwise(F.array_distinct(spread))


def prompt(window: Column, output: Column, safety: int, chars_per_token: float) -> Column:
    """Characters that a prompt may have; null if too few tokens are left."""
    left = window - output - safety
    return F.when(left >= 512, F.floor(left * chars_per_token)).cast("long")
