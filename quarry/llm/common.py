"""Column builders and table access shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word after A-Z has been lower-cased: digits, a-z and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text that has not been lower-cased yet.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: White space that separates words where punctuation belongs to them.
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; letters outside ASCII keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Lower-cased words of a text; null gives an empty array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(RAW_WORD)).cast("long")


def row_key(row_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart where ids are null or repeated. Rows equal in id and text get one key and one result."""
    named = F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.lit("\u0000"), F.coalesce(text, F.lit(""))).cast("binary")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A run on one machine (tests) gets a folder of its own; on a cluster it has to be named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Tables that this process has written to the shared folder.
_TABLES: list[str] = []


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, tables that are written pass Python this many rows at a time: long texts take memory in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, which ``clear`` deletes."""
    _TABLES.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _TABLES[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, survives lost executors.

    Results read these tables when they run; ``clear`` deletes them once results are stored.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def made() -> int:
    """How many tables there are; ``clear`` leaves as many if it is told to."""
    return len(_TABLES)


def clear(spark: SparkSession, but: DataFrame | None = None, first: int = 0) -> None:
    """Deletes the tables that ``written`` has made so far, in whatever store they lie.

    Not the ``first`` ones, nor those that the frame ``but`` reads.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    used = [] if but is None else but.inputFiles()
    kept = [t for t in _TABLES[first:] if any(t.rsplit("/", 1)[1] in f for f in used)]
    for table in set(_TABLES[first:]) - set(kept):
        path = jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(conf).delete(path, True)
    _TABLES[first:] = kept
