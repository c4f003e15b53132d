"""Chunks around chunks, along the ids that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATH = "array<string>"


def follow(chunks: DataFrame, link: str, steps: int) -> DataFrame:
    """(chunk_id, path): the chunks that ``steps`` links lead to, nearest first; a path ends where a link is null or leads to no chunk.

    By pointer doubling: paths of 1, 2, 4, ... links are joined end to end, so that as many
    joins as ``steps`` has binary digits, twice, do it. Links may cross, meet and go round.
    """
    ids = chunks.select(F.col("chunk_id").alias("_to"))
    there = chunks.join(ids, F.col(link) == F.col("_to"), "left_semi").select("chunk_id", F.col(link).alias("to"))
    # of each chunk: the path so far and the chunk it ends at; null if it has ended before
    path = chunks.select("chunk_id").join(there, "chunk_id", "left").select("chunk_id", F.when(F.col("to").isNull(), F.array().cast(_PATH)).otherwise(F.array(F.col("to").cast("string"))).alias("path"), F.col("to").alias("end"))
    found = chunks.select("chunk_id", F.array().cast(_PATH).alias("path"), F.col("chunk_id").alias("end"))

    def joined(first: DataFrame, then: DataFrame) -> DataFrame:
        ahead = then.select(F.col("chunk_id").alias("_at"), F.col("path").alias("_path"), F.col("end").alias("_end"))
        return first.join(ahead, F.col("end") == F.col("_at"), "left").select("chunk_id", F.concat("path", F.coalesce("_path", F.array().cast(_PATH))).alias("path"), F.col("_end").alias("end"))

    while steps:
        if steps & 1:
            found = joined(found, path)
        steps >>= 1
        if steps:
            path = joined(path, path)
    return found.select("chunk_id", "path")


def expanded(chunks: DataFrame, hits: Column | None = None, window: int = 1, previous: str = "previous_chunk_id", following: str = "next_chunk_id") -> DataFrame:
    """(chunk_id, context): each chunk (or each that is hit) among those that ``window`` links lead to on both sides, in order of reading."""
    wanted = chunks.select("chunk_id") if hits is None else chunks.filter(hits).select("chunk_id")
    before, behind = follow(chunks, previous, window), follow(chunks, following, window)
    both = wanted.join(before.withColumnRenamed("path", "_before"), "chunk_id").join(behind.withColumnRenamed("path", "_behind"), "chunk_id")
    return both.select("chunk_id", F.concat(F.reverse("_before"), F.array(F.col("chunk_id").cast("string")), "_behind").alias("context"))
