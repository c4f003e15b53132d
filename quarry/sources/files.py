"""Folders of files as rows, and rows as files: texts, logs, incidents, code, archives of classes, office documents."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking as C
from ..operators import logs as L

#: Languages by the suffix of a source file.
LANGUAGES = {
    ".java": "java", ".py": "python", ".sql": "sql", ".js": "javascript", ".ts": "typescript", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".kt": "kotlin",
    ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".properties": "properties", ".sh": "shell", ".jsp": "jsp", ".html": "html", ".css": "css",
}


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, suffix, size, content) of a folder's files, from any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.col("length").alias("size"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark at the beginning; bytes that are none become replacement characters."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, suffix, language, text) of text files; the language is null for those that are no code."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return files(spark, folder, glob).select("path", "name", "suffix", F.try_element_at(known, F.col("suffix")).alias("language"), decoded(F.col("content")).alias("text"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each byte range, which stand one behind the other in a task."""
    now, n = None, 0
    for batch in batches:
        paths, begins = batch.column("log_id").to_pylist(), batch.column("begin").to_pylist()
        places = []
        for at in zip(paths, begins):
            n = n + 1 if at == now else 0
            now = at
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])


def log_lines(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """(log_id: the path, line_no from 1, line); one log may be many tasks' work.

    Spark reads byte ranges of files, which it aligns at the ends of lines. Lines are numbered
    within their range; the ranges' sizes, a row for each, give the numbers they begin with.
    """
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    ranges = read.select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("begin"), "value")
    sizes = ranges.groupBy("log_id", "begin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("log_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("log_id", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = ranges.mapInArrow(_places, "log_id string, begin long, value string, place long").join(starts, ["log_id", "begin"])
    number = F.col("start") + F.col("place") + 1
    line = F.make_valid_utf8("value")
    return placed.select("log_id", number.alias("line_no"), F.when(number == 1, F.regexp_replace(line, "^\ufeff", "")).otherwise(line).alias("line"))


def log_items(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Records of log files with their error's fields and frames."""
    return L.records(log_lines(spark, folder, glob)).withColumn("frames", L.frames(F.col("text"), text.PLATFORM))


def incident_items(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, block, text, identifier, embedding_text, structured, fields...) of blocks between blank lines; two fields make an incident."""
    names = list(dict.fromkeys(text.INCIDENT_FIELDS.values()))
    labels = {v: k for k, v in reversed(text.INCIDENT_FIELDS.items()) if not k.isascii()}
    blocks = texts(spark, folder, glob).select("path", F.posexplode(text.blocks(F.col("text"))).alias("block", "text"))
    rows = blocks.select("path", "block", "text", F.explode(text.incident_fields(F.col("text"))).alias("f")).select("path", "block", "text", "f.*")
    structured = sum((F.col(k).isNotNull().cast("int") for k in names), F.lit(0)) >= 2
    said = F.concat_ws("\n", F.lit("[장애]"), *[F.concat(F.lit(f"{labels[k]}: "), F.col(k)) for k in names])
    return rows.withColumns({"structured": structured, "embedding_text": F.when(structured, said).otherwise(F.col("text")), "identifier": F.when(structured, F.col("incident_id"))})


def code_windows(spark: SparkSession, folder: str, glob: str = "*", most: int = 120) -> DataFrame:
    """(path, language, seq, line_start, line_end, content) of source files in windows of lines."""
    docs = texts(spark, folder, glob).filter("language IS NOT NULL")
    return docs.select("path", "language", F.explode(C.windows(F.split(F.regexp_replace("text", r"\n$", ""), "\n"), most)).alias("w")).select("path", "language", "w.*")


def inspect_jar(content: bytes, most_classes: int = 2000, most_bytes: int = 200 * 1024 * 1024) -> tuple[bool, str | None, int, int]:
    """(usable, why not, classes, bytes when unpacked) of an archive: none that is broken, locked, too large, or leaves its folder."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = [e for e in z.infolist() if not e.is_dir()]
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return False, "no archive", 0, 0
    size, classes = sum(e.file_size for e in entries), sum(e.filename.endswith(".class") for e in entries)
    reason = next((why for why, bad in (
        ("path", any(e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) or re.match("[A-Za-z]:", e.filename) for e in entries)),
        ("encrypted", any(e.flag_bits & 1 for e in entries)), ("link", any(e.external_attr >> 16 & 0o170000 == 0o120000 for e in entries)),
        ("size", size > most_bytes), ("classes", classes > most_classes), ("empty", not classes),
    ) if bad), None)
    return reason is None, reason, classes, size


def jars(spark: SparkSession, folder: str, glob: str = "*.jar") -> DataFrame:
    """(path, usable, reason, n_classes, n_bytes) of each archive of classes."""

    def inspected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [inspect_jar(c) for c in pdf["content"]]
            yield pd.DataFrame([(p, *f) for p, f in zip(pdf["path"], found)], columns=["path", "usable", "reason", "n_classes", "n_bytes"])

    return files(spark, folder, glob).select("path", "content").mapInPandas(inspected, "path string, usable boolean, reason string, n_classes long, n_bytes long")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _rows(table, row: str, cell: str, run: str) -> str:
    """A table as lines of cells."""
    lines = [" | ".join("".join(t.text or "" for t in c.iter(run)).strip() for c in r.findall(cell)) for r in table.findall(row)]
    return "\n".join(line for line in lines if line.replace("|", "").strip())


def docx_parts(content: bytes) -> list[tuple[int, str, str]]:
    """(position, kind, text): paragraphs and tables in the order of the document."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    made = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            made.append(("text", "".join(t.text or "" for t in part.iter(f"{_W}t")).strip()))
        elif part.tag == f"{_W}tbl":
            made.append(("table", _rows(part, f"{_W}tr", f"{_W}tc", f"{_W}t")))
    return [(k, kind, said) for k, (kind, said) in enumerate(m for m in made if m[1])]


def pptx_parts(content: bytes) -> list[tuple[int, str, str]]:
    """(slide from 1, kind, text): the shapes of each slide by their place, from above and from the left."""
    z = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    made = []
    for number, name in slides:
        shapes = []
        for shape in ElementTree.fromstring(z.read(name)).iter():
            if shape.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                continue
            off = next(shape.iter(f"{_A}off"), None)
            place = (0, 0) if off is None else (int(off.get("y", 0)), int(off.get("x", 0)))
            table = next(shape.iter(f"{_A}tbl"), None)
            kind = "title" if any(p.get("type") in ("title", "ctrTitle") for p in shape.iter(f"{_P}ph")) else "text" if table is None else "table"
            said = _rows(table, f"{_A}tr", f"{_A}tc", f"{_A}t") if table is not None else "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")).strip()
            shapes.append((kind != "title", *place, kind, said))
        made += [(number, kind, said) for _, _, _, kind, said in sorted(shapes) if said]
    return made


#: What reading a file raises that is damaged, locked, packed in an unknown way, or no such file.
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, EOFError, KeyError, ValueError, ElementTree.ParseError)


def office_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, position, kind, text) of Word and PowerPoint files; a file that can't be read has one part, of kind ``broken``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, suffix, content in zip(pdf["path"], pdf["suffix"], pdf["content"]):
                try:
                    found = docx_parts(content) if suffix == ".docx" else pptx_parts(content)
                except BROKEN:
                    found = [(0, "broken", "")]
                rows += [(path, *f) for f in found]
            yield pd.DataFrame(rows, columns=["path", "position", "kind", "text"])

    chosen = files(spark, folder).filter(F.col("suffix").isin(".docx", ".pptx")).select("path", "suffix", "content")
    return chosen.mapInPandas(read, "path string, position long, kind string, text string")


def write_items(items: DataFrame, folder: str) -> None:
    """Items as lines of JSON, in files in the order of their partitions."""
    items.write.mode("overwrite").json(folder)


def replace_versions(rows: DataFrame, folder: str) -> None:
    """Replaces whole versions of a table that is partitioned by ``version_id``; a task or batch that runs again has the same effect."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(folder)


def expanded(values: Column, environment: dict[str, str]) -> Column:
    """``${NAME:-default}`` in settings replaced from a (small) environment; without either it becomes empty."""
    known = F.create_map(*[F.lit(x) for pair in (environment or {"": ""}).items() for x in pair])
    parts = F.regexp_extract_all(values, F.lit(r"\$\{[A-Za-z_][A-Za-z0-9_]*(?::-[^}]*)?\}"), F.lit(0))
    of = lambda p: F.coalesce(F.nullif(F.try_element_at(known, F.regexp_extract(p, r"^\$\{([A-Za-z0-9_]+)", 1)), F.lit("")), F.regexp_extract(p, r":-([^}]*)\}$", 1))
    return F.aggregate(F.array_distinct(parts), values, lambda s, p: F.replace(s, p, of(p)))
