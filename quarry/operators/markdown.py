"""Blocks of Markdown: what a line is follows from counts over the lines before it, so that no line is walked by hand.

Within fences (an odd number of them before) a line is code. A heading, a rule or a line of
text ends a procedure; numbered steps since then count on, whatever number they are written
with, and bullets after one belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import SPAN, Scan, running

#: Forms of lines.
HEADING, NUMBERED, BULLET, RULE = r"^(#{1,6})\s+(.+)$", r"^\s*[0-9]+[.)]\s+(.+)$", r"^\s*[-*+]\s+(.+)$", r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"
_FENCE = r"^\s*```"


def _kind(line: Column) -> Column:
    return (
        F.when(F.trim(line).rlike(HEADING), "heading").when(line.rlike(NUMBERED), "numbered").when(line.rlike(BULLET), "bullet").when(line.rlike(RULE), "rule")
        .when(line == "", "blank").otherwise("text")
    )


def blocks(lines: DataFrame, group: str = "doc_id", span: int = SPAN) -> DataFrame:
    """(group, line_no, kind, level, number, nested, text) for lines (group, line_no, line); fences are left out, a fenced block is one row of kind ``code``.

    ``level`` is a heading's, ``number`` a step's, ``nested`` whether a bullet belongs to a step. Null lines are empty.
    """
    trimmed = F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+$", "")
    fenced = running(lines.select(group, "line_no", trimmed.alias("line"), trimmed.rlike(_FENCE).alias("fence")), {"fences": Scan("sum", F.col("fence").cast("long"))}, group, "line_no", span)
    inside = F.col("fences") % 2 == 1
    outer = fenced.withColumn("kind", F.when(~F.col("fence") & ~inside, _kind(F.col("line"))))
    steps = running(outer, {"steps": Scan("sum", (F.col("kind") == "numbered").cast("long"))}, group, "line_no", span)
    ends = F.col("kind").isin("heading", "rule", "text")
    placed = running(steps, {"ended": Scan("max", F.when(ends, F.col("steps")))}, group, "line_no", span)
    number = F.col("steps") - F.coalesce("ended", F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    said = F.when(F.col("kind") == "heading", F.regexp_extract(F.trim("line"), HEADING, 2)).when(F.col("kind") == "numbered", F.regexp_extract("line", NUMBERED, 1)).when(F.col("kind") == "bullet", F.regexp_extract("line", BULLET, 1)).when(F.col("kind") == "rule", "").otherwise(F.col("line"))
    plain = placed.filter("kind is not null").select(
        group, "line_no", "kind", F.when(F.col("kind") == "heading", F.length(F.regexp_extract(F.trim("line"), HEADING, 1))).alias("level"),
        F.when(F.col("kind") == "numbered", number).alias("number"), F.when(F.col("kind") == "bullet", number > 0).alias("nested"), said.alias("text"),
    )
    code = fenced.filter(~F.col("fence") & inside).groupBy(group, "fences").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    return plain.unionByName(code.select(group, "line_no", F.lit("code").alias("kind"), none("int").alias("level"), none("long").alias("number"), none("boolean").alias("nested"), "text"))
