"""Chunkers: greedy packing of paragraphs and of headed blocks. A document is walked once, where its row lies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH, LEAST_CUT = 3000, 1000


def cut(paragraph: str, most: int = PARAGRAPH, least: int = LEAST_CUT) -> list[str]:
    """Parts of a paragraph: cut at the last line end before ``most`` if that is late enough; the rest keeps its line end."""
    parts = []
    while len(paragraph) > most:
        at = paragraph.rfind("\n", 0, most)
        at = at if at > least else most
        parts.append(paragraph[:at])
        paragraph = paragraph[at:]
    return [*parts, paragraph] if paragraph.strip() else parts


def packed(parts: list[str], most: int = PARAGRAPH) -> list[str]:
    """Parts joined by a blank line while they stay under ``most``; a new item begins stripped."""
    items: list[str] = []
    for part in parts:
        if items and len(items[-1]) + len(part) < most:
            items[-1] += "\n\n" + part
        else:
            items.append(part.strip())
    return items


def _packed(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "items": [packed([x for p in ps for x in cut(p, most, most // 3)], most) for ps in pdf["_p"]]})


def paragraphs(docs: DataFrame, most: int = PARAGRAPH) -> DataFrame:
    """(doc_id, seq, content): paragraphs packed into items of about ``most`` characters."""
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\n\s*\n").alias("_p"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = split.mapInPandas(partial(_packed, most=most), f"doc_id {kind}, items array<string>")
    return made.select("doc_id", F.posexplode("items").alias("seq", "content"))


def headed(blocks: list[tuple[int, str | None, str]], target: int, most: int) -> list[tuple[str | None, str]]:
    """(heading, content) of chunks of a document's blocks (position, heading, text), in one walk."""
    made: list[tuple[str | None, str]] = []
    heading, texts, tokens = None, [], 0
    for _, new, text in sorted(blocks, key=lambda b: b[0]):
        n = 2 * len(text.split())
        changed = new is not None and new != heading and tokens >= target
        if texts and (changed or tokens + n > most):
            made.append((heading, "\n".join(texts)))
            texts, tokens = [], 0
        heading = heading if new is None else new
        texts.append(text)
        tokens += n
    return made + [(heading, "\n".join(texts))] if texts else made


def _headed(batches: Iterator[pd.DataFrame], target: int, most: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(doc, seq, *c) for doc, found in zip(pdf["doc_id"], pdf["b"]) for seq, c in enumerate(headed([(b["position"], b["heading"], b["text"] or "") for b in found], target, most))]
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "heading", "content"])


def semantic(blocks: DataFrame, target: int = 700, most: int = 1000) -> DataFrame:
    """(doc_id, seq, heading, content) of blocks (doc_id, position, heading, text).

    A change of heading ends a chunk that has ``target`` tokens; a block that would make it
    larger than ``most`` ends it as well. A block without a heading keeps the last one.
    """
    ordered = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("position", "heading", "text")).alias("b"))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    return ordered.mapInPandas(partial(_headed, target=target, most=most), f"doc_id {kind}, seq int, heading string, content string")


def windows(lines: Column, most: int) -> Column:
    """(seq, line_start, line_end, content) of windows of ``most`` lines over an array of lines."""

    def cut(ls: Column) -> Column:
        last = F.floor((F.size(ls) - 1) / most).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(
            i.alias("seq"), (i * most + 1).alias("line_start"), F.least(i * most + most, F.size(ls).cast("long")).alias("line_end"),
            F.array_join(F.slice(ls, (i * most + 1).cast("int"), most), "\n").alias("content"),
        ))

    # an array of one array, so that the lines are split once and not for each window
    return F.flatten(F.transform(F.array(lines), cut))
