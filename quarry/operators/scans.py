"""Running values over rows in order, where a group may hold most of all rows.

A window over a whole group is one task's work. Here a group is cut into spans of its order;
running values are made within each span, spans are summed up to a row each, the running
values over these few rows are what each span starts from, and both are put together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that a span covers, and so the rows that a task sorts at once (if they are numbered).
SPAN = 65_536


@dataclass(frozen=True)
class Scan:
    """``sum`` or ``max`` of the rows so far, the ``last`` value so far that is not null, or the least (``next``) of this row and those to come."""

    kind: str
    value: Column


def running(rows: DataFrame, scans: dict[str, Scan], group: str = "log_id", order: str = "line_no", span: int = SPAN) -> DataFrame:
    """``rows`` with a column for each scan. A null group is one like any other; values that are null do not count."""
    block = F.floor(F.col(order) / span).cast("long")
    inside = Window.partitionBy(group, "_block").orderBy(order)
    to_here, from_here = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    spans = Window.partitionBy(group).orderBy("_block")
    before, behind = spans.rowsBetween(Window.unboundedPreceding, -1), spans.rowsBetween(1, Window.unboundedFollowing)
    local = {
        "sum": lambda v: F.sum(v).over(to_here), "max": lambda v: F.max(v).over(to_here),
        "last": lambda v: F.last(v, ignorenulls=True).over(to_here), "next": lambda v: F.min(v).over(from_here),
    }
    summed = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col(order))), "next": F.min}
    carried = {
        "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.min(c).over(behind),
    }
    joined = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest,
        "last": lambda a, b: F.coalesce(b, a), "next": F.least,
    }
    cut = rows.withColumn("_block", block)
    each = cut.groupBy(group, "_block").agg(*(summed[s.kind](s.value).alias(n) for n, s in scans.items()))
    start = each.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), *(carried[s.kind](F.col(n)).alias(f"_start_{n}") for n, s in scans.items()))
    own = cut.withColumns({f"_own_{n}": local[s.kind](s.value) for n, s in scans.items()})
    both = own.join(start, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")), "left")
    return both.select(*(c for c in rows.columns if c not in scans), *(joined[s.kind](F.col(f"_start_{n}"), F.col(f"_own_{n}")).alias(n) for n, s in scans.items()))
