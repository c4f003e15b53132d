"""Document models of converters: nested JSON of which field names differ by version, as flat blocks and cells.

Payloads are parsed once, to variants; what is no JSON, or no object, has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .scans import Scan, running

#: Containers of text in the order in which they are read, and names of fields, the newest first.
CONTAINERS = ("texts", "groups", "key_value_items")
TEXTS = ("text", "orig")
TABLE_DATA, CELLS = ("data", "table_data"), ("table_cells", "cells")
ROW, COLUMN = ("start_row_offset_idx", "row"), ("start_col_offset_idx", "col")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, names: tuple[str, ...], kind: str) -> Column:
    """The first of some fields that is there and not null."""
    return F.coalesce(*(_get(v, f"$.{n}", kind) for n in names))


def _items(v: Column, path: str) -> Column:
    """The items of an array; none if it is no array."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _page(v: Column) -> Column:
    """The page of the first place that an item names."""
    return _get(v, "$.prov[0].page_no", "int")


def blocks(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, block, text, page, heading_type, heading_path) of a payload's texts, groups and key-value items.

    ``block`` counts items with a text, blank ones too, which are then left out; a page that is
    not named is 1. A heading changes the path from itself on: appendices and special clauses
    begin a new one, sections are kept below the first level, articles below the second.
    """
    v = docs.select(key, F.try_parse_json(payload).alias("_v"))
    item = lambda c: F.transform(_items(F.col("_v"), f"$.{c}"), lambda x: F.struct(F.coalesce(*(F.nullif(_get(x, f"$.{n}", "string"), F.lit("")) for n in TEXTS)).alias("text"), _page(x).alias("page")))
    said = F.filter(F.concat(*map(item, CONTAINERS)), lambda x: x["text"].isNotNull())
    each = v.select(key, F.posexplode(said).alias("block", "_x"))
    stripped = text.strip(F.col("_x.text"))
    flat = each.select(key, F.col("block").cast("long").alias("block"), stripped.alias("text"), F.coalesce("_x.page", F.lit(1)).alias("page")).filter("text <> ''").withColumn("heading_type", text.heading(F.col("text")))
    heads = flat.filter("heading_type is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "heading_type", "text"))).alias("_h"))
    kept = {"section": 1, "article": 2}
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<block:bigint,path:array<string>>>").alias("out"))

    def step(done: Column, h: Column) -> Column:
        level = F.coalesce(*(F.when(h["heading_type"] == t, n) for t, n in kept.items()), F.lit(0))
        path = F.array_append(F.slice(done["path"], F.lit(1), level), h["text"])
        return F.struct(path.alias("path"), F.array_append(done["out"], F.struct(h["block"].alias("block"), path.alias("path"))).alias("out"))

    paths = heads.select(key, F.explode(F.aggregate("_h", start, step)["out"]).alias("_p")).select(key, F.col("_p.block").alias("block"), F.col("_p.path").alias("_path"))
    placed = flat.join(paths, [key, "block"], "left")
    done = running(placed, {"heading_path": Scan("last", F.col("_path"))}, group=key, order="block")
    return done.select(key, "block", "text", "page", "heading_type", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"))


def _tables(docs: DataFrame, key: str, payload: str) -> DataFrame:
    v = docs.select(key, F.try_parse_json(payload).alias("_v")).select(key, F.posexplode(_items(F.col("_v"), "$.tables")).alias("table_no", "_t"))
    # an object without fields counts as missing
    data = F.coalesce(*(F.when(F.coalesce(F.to_json(_get(F.col("_t"), f"$.{n}", "variant")), F.lit("{}")).isin("{}", "null"), None).otherwise(_get(F.col("_t"), f"$.{n}", "variant")) for n in TABLE_DATA))
    return v.withColumn("_d", data)


def cells(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, table_no, row, col, row_span, col_span, text, row_header, column_header, page) of a payload's tables.

    Spans come from the ends of cells and are 1 at least; a cell without a place has its table's.
    """
    t = _tables(docs, key, payload)
    held = lambda n: F.when(F.size(_items(F.col("_d"), f"$.{n}")) > 0, _items(F.col("_d"), f"$.{n}"))
    each = t.select(key, "table_no", "_t", F.explode(F.coalesce(*map(held, CELLS))).alias("_c"))
    c = F.col("_c")
    row, col = F.coalesce(_first(c, ROW, "int"), F.lit(0)), F.coalesce(_first(c, COLUMN, "int"), F.lit(0))
    span = lambda end, begin: F.greatest(F.coalesce(_get(c, f"$.{end}", "int"), begin + 1) - begin, F.lit(1))
    flag = lambda n: F.coalesce(_get(c, f"$.{n}", "boolean"), F.lit(False))
    place = F.when(F.size(_items(c, "$.prov")) > 0, _page(c)).otherwise(_page(F.col("_t")))
    return each.select(
        key, "table_no", row.alias("row"), col.alias("col"), span("end_row_offset_idx", row).alias("row_span"), span("end_col_offset_idx", col).alias("col_span"),
        F.coalesce(_get(c, "$.text", "string"), F.lit("")).alias("text"), flag("row_header").alias("row_header"), flag("column_header").alias("column_header"), F.coalesce(place, F.lit(1)).alias("page"),
    )


def tables(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, table_no, n_rows, n_cols, pages: of its cells)."""
    t = _tables(docs, key, payload)
    sizes = t.select(key, "table_no", F.coalesce(_first(F.col("_d"), ("num_rows", "n_rows"), "int"), F.lit(0)).alias("n_rows"), F.coalesce(_first(F.col("_d"), ("num_cols", "n_cols"), "int"), F.lit(0)).alias("n_cols"))
    seen = cells(docs, key, payload).groupBy(key, "table_no").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return sizes.join(seen, [key, "table_no"], "left").select(key, "table_no", "n_rows", "n_cols", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
