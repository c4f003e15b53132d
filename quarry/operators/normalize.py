"""Texts as blocks under headings. A text is one row, and its lines are walked where it lies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADINGS

_FORMS = {name: re.compile(form) for name, form in HEADINGS.items()}
#: How many of the headings above a heading of each kind keeps.
_KEPT = {"appendix": 0, "special_clause": 0, "section": 1, "article": 2}


def heading_class(line: str) -> str | None:
    plain = " ".join(line.split())
    return next((name for name, form in _FORMS.items() if form.search(plain)), None)


def walked(text: str | None) -> list[tuple[int, str, str, list[str], str | None]]:
    """(position, type, text, headings above and itself, kind of heading) of each line that isn't blank."""
    stack: list[str] = []
    found = []
    for position, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if not line:
            continue
        kind = heading_class(line)
        if kind:
            stack = stack[: _KEPT[kind]] + [line]
        found.append((position, "title" if kind else "text", line, list(stack), kind))
    return found


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "position", "type", "text", "heading_path", "heading_type"]
    for pdf in batches:
        yield pd.DataFrame([(doc, *found) for doc, text in zip(pdf["doc_id"], pdf["text"]) for found in walked(text)], columns=columns)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_id, position, type, text, heading_path, heading_type) of rows (doc_id, text); a null text has no blocks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").filter("text IS NOT NULL").mapInPandas(_blocks, f"doc_id {kind}, position long, type string, text string, heading_path array<string>, heading_type string")
    name = F.concat(F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 16), F.lit(":b:"), F.lpad(F.col("position").cast("string"), 6, "0"))
    return made.select("doc_id", name.alias("block_id"), "position", "type", "text", "heading_path", "heading_type")
