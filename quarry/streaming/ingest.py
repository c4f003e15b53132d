"""Streams of uploads and of log lines.

The reference work polls a queue; here a file source feeds micro-batches. Effects are
exactly once because each batch replaces what it has written before under its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stateful


def uploads(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 4) -> DataFrame:
    """New files of a folder, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_by_content(stream: DataFrame, time: str = "created_at", late: str = "7 days") -> DataFrame:
    """Each content of an asset once; contents are remembered as long as rows may be late."""
    return stream.withColumn("sha256", F.sha2("text", 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["asset_id", "sha256"])


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Works off what there is and stops; a batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def segments_once(stream: DataFrame, target: str, checkpoint: str, most: int = 250) -> None:
    """Log lines in segments, which go on where the batches before have ended: of each open log three numbers are kept."""
    made = stateful.segmented(stream, most)
    made.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
