"""Tables with spans: dense grids, header paths, records, facts and scores."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, text): each cell over its span; a cell's own place wins, then the first text."""
    over = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    own = ((F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))).cast("int")
    first = F.struct((1 - own).alias("a"), (F.col("text") == "").cast("int").alias("b"), "row", "col")
    return over.groupBy("table_id", "r", "c").agg(F.min_by("text", first).alias("text"))


def fill_first_column(grid: DataFrame) -> DataFrame:
    """Blank cells of column 0 below the header take the text above."""
    down = Window.partitionBy("table_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when((F.col("r") > 0) & (F.trim("text") != ""), F.col("text")), ignorenulls=True).over(down)
    return grid.withColumn("text", F.when((F.col("c") == 0) & (F.col("r") > 0) & (F.trim("text") == ""), F.coalesce(carried, F.col("text"))).otherwise(F.col("text")))


def header_paths(grid: DataFrame, rows: int = 1) -> DataFrame:
    """(table_id, c, path): texts of the header rows from above, each once; ``column_N`` without any."""
    texts = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: F.trim(x["text"])), lambda t: t != ""))
    paths = grid.filter(F.col("r") < rows).groupBy("table_id", "c").agg(F.array_join(texts, " > ").alias("path"))
    return paths.withColumn("path", F.when(F.col("path") == "", F.concat(F.lit("column_"), (F.col("c") + 1).cast("string"))).otherwise(F.col("path")))


def facts(grid: DataFrame, paths: DataFrame) -> DataFrame:
    """(table_id, r, fact): ``key = value`` pairs of a row, without empty ones; empty rows are dropped."""
    named = grid.filter("r > 0").join(paths, ["table_id", "c"]).filter(F.trim("text") != "")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("c", F.concat_ws(" = ", "path", "text").alias("f")))), lambda x: x["f"])
    return named.groupBy("table_id", "r").agg(F.array_join(pairs, "; ").alias("fact"))


def scores(grid: DataFrame) -> DataFrame:
    """(table_id, score, low_fill): how full and how plausible a table is, 0.9 at most."""
    n = grid.groupBy("table_id").agg(F.avg((F.trim("text") != "").cast("int")).alias("fill"), (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    score = F.lit(0.55) + F.least(F.col("fill"), F.lit(1.0)) * 0.35 - F.when((F.col("rows") <= 1) | (F.col("cols") <= 1), 0.2).otherwise(0.0)
    return n.select("table_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9).alias("score"), (F.col("fill") < 0.25).alias("low_fill"))


def grouped(sizes: list[tuple[int, int]], tokens: int, most_rows: int, overlap: int) -> list[list[int]]:
    """Groups of rows (r, tokens) in order; a group begins with the last rows of the one before."""
    made: list[list[int]] = []
    now: list[tuple[int, int]] = []
    held = 0
    for r, t in sorted(sizes):
        if now and (len(now) >= most_rows or held + t > tokens):
            made.append([x for x, _ in now])
            now = now[-overlap:] if overlap else []
            held = sum(n for _, n in now)
        now.append((r, t))
        held += t
    return [*made, [x for x, _ in now]] if now else made


def _grouped(batches: Iterator[pd.DataFrame], tokens: int, most_rows: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(table, seq, r) for table, found in zip(pdf["table_id"], pdf["f"]) for seq, group in enumerate(grouped([(x["r"], x["t"]) for x in found], tokens, most_rows, overlap)) for r in group]
        yield pd.DataFrame(rows, columns=["table_id", "seq", "r"])


def chunks(rows: DataFrame, tokens: int = 900, most_rows: int = 30, overlap: int = 1) -> DataFrame:
    """(table_id, seq, r): rows (table_id, r, fact) in groups of bounded size; a group begins with the last row of the one before."""
    sized = rows.groupBy("table_id").agg(F.collect_list(F.struct("r", F.greatest(F.lit(1), F.floor(F.length("fact") / 2)).cast("int").alias("t"))).alias("f"))
    kind = rows.schema["table_id"].dataType.simpleString()
    return sized.mapInPandas(partial(_grouped, tokens=tokens, most_rows=most_rows, overlap=overlap), f"table_id {kind}, seq int, r int")


def records(grid: DataFrame, paths: DataFrame, header_rows: int = 1) -> DataFrame:
    """(table_id, r, record) of the rows below the header: texts by header path, in the order of columns.

    Of columns with one path the last one's text counts, at the first one's place; a row whose
    texts are all blank is dropped.
    """
    named = grid.filter(F.col("r") >= header_rows).join(paths, ["table_id", "c"]).groupBy("table_id", "r", "path").agg(F.min("c").alias("at"), F.trim(F.max_by(F.coalesce("text", F.lit("")), "c")).alias("text"))
    rows = named.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("at", "path", "text"))).alias("_x")).filter(F.exists("_x", lambda x: x["text"] != ""))
    return rows.select("table_id", "r", F.map_from_entries(F.transform("_x", lambda x: F.struct(x["path"], x["text"]))).alias("record"))


#: What stands before a table's title, its place in the document, and its notes.
TITLE, PLACE, NOTE = "[표] ", "[문맥] ", "[각주] "


def sentences(rows: DataFrame, about: DataFrame) -> DataFrame:
    """(table_id, r, fact): each record under its table's title, headings and notes; ``about`` is (table_id, title, article_path, footnotes), any of which may be null."""
    named = rows.join(about.select("table_id", "title", "article_path", "footnotes"), "table_id", "left")
    said = F.transform(F.filter(F.map_entries("record"), lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
    none = F.array().cast("array<string>")
    parts = F.array(
        F.when(F.col("title") != "", F.concat(F.lit(TITLE), "title")), F.when(F.size(F.coalesce("article_path", none)) > 0, F.concat(F.lit(PLACE), F.array_join("article_path", " > "))),
        F.array_join(said, "; "), F.array_join(F.transform(F.coalesce("footnotes", none), lambda n: F.concat(F.lit(NOTE), n)), " "),
    )
    return named.select("table_id", "r", F.regexp_replace(F.array_join(F.array_compact(parts), "\n"), r"(?U)^\s+|\s+$", "").alias("fact"))


def _chunk_name(k: Column) -> Column:
    """Four digits at least."""
    return F.concat(F.col("table_id").cast("string"), F.lit(":c:"), F.format_string("%04d", k))


def chunk_items(facts: DataFrame, tokens: int = 900, most_rows: int = 30, overlap: int = 1) -> DataFrame:
    """(chunk_id, parent_id, chunk_index, chunk_count, row_count, content, previous_chunk_id, next_chunk_id) of facts (table_id, r, fact).

    Only rows' numbers and sizes of a table meet in one task; texts meet by chunk. Links are made of
    numbers, as chunks of a table are numbered from 0 on.
    """
    placed = chunks(facts, tokens, most_rows, overlap)
    told = placed.join(facts, ["table_id", "r"]).groupBy("table_id", "seq").agg(F.count(F.lit(1)).alias("row_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "fact"))), lambda x: x["fact"]), "\n").alias("content"))
    rows = told.join(placed.groupBy("table_id").agg((F.max("seq") + 1).alias("n")), "table_id")
    k = F.col("seq")
    return rows.select(
        _chunk_name(k).alias("chunk_id"), F.col("table_id").alias("parent_id"), k.cast("long").alias("chunk_index"), F.col("n").cast("long").alias("chunk_count"), "row_count", "content",
        F.when(k > 0, _chunk_name(k - 1)).alias("previous_chunk_id"), F.when(k + 1 < F.col("n"), _chunk_name(k + 1)).alias("next_chunk_id"),
    )


def continued(pairs: DataFrame, least: float = 0.72) -> DataFrame:
    """Pairs of tables (a_header, b_header, page_gap, a_cols, b_cols) that are one table over a page break."""
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)

    fit = pairs.filter(F.col("page_gap").isin(0, 1) & (F.col("a_cols") == F.col("b_cols")))
    return fit.withColumn("ratio", F.pandas_udf(ratio, "double")("a_header", "b_header")).filter(F.col("ratio") >= least)


def signatures(paths: DataFrame) -> DataFrame:
    """(table_id, signature): a table's header paths in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("c", "path"))), lambda x: x["path"])
    return paths.groupBy("table_id").agg(F.array_join(ordered, " | ").alias("signature"))
