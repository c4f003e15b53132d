"""The knowledge graph of versions that have none yet: selection, text, extractor, parsing, checks, and a ledger of what is done.

Work goes batch by batch; a batch's entities, relations and ledger rows are one commit, so a
run that is interrupted goes on with what is left, and a second run does nothing. Graph rows
belong to their version: what replaces a version leaves no orphans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.snapshots import Store
from ..sources.store import written
from . import graph

#: What writes the lines of a graph (version_id, line_no, line) for texts (version_id, text): a model's service, or rules.
Extractor = Callable[[DataFrame], DataFrame]


def targets(versions: DataFrame, ledger: DataFrame | None, force: bool = False) -> DataFrame:
    """(version_id) of the versions without a row in the ledger; all of them with ``force``."""
    ids = versions.select("version_id").distinct()
    return ids if force or ledger is None else ids.join(ledger.select("version_id").distinct(), "version_id", "left_anti")


def selected(chunks: DataFrame, points: Column, most: int) -> DataFrame:
    """Of each version at most ``most`` chunks: up to half by their points, the others spread evenly over the whole version."""
    version = Window.partitionBy("version_id")
    rows = chunks.withColumn("_p", points).withColumn("_k", F.row_number().over(version.orderBy(F.col("_p").desc(), "chunk_seq")))
    rows = rows.withColumn("_best", (F.col("_k") <= most // 2) & (F.col("_p") > 0))
    rest = rows.withColumn("_i", F.row_number().over(version.orderBy("_best", "chunk_seq")) - 1).withColumn("_n", F.count_if(~F.col("_best")).over(version)).withColumn("_m", most - F.count_if("_best").over(version))
    # the i-th of n others is taken if a multiple of n / m falls on it
    even = F.floor((F.col("_i") + 1) * F.col("_m") / F.greatest(F.col("_n"), F.lit(1))) > F.floor(F.col("_i") * F.col("_m") / F.greatest(F.col("_n"), F.lit(1)))
    return rest.filter(F.col("_best") | (F.col("_n") <= F.col("_m")) | even).select(*chunks.columns)


def texts(chunks: DataFrame, characters: int) -> DataFrame:
    """(version_id, text, n_chunks): numbered chunks in order, as many as fit in a number of characters."""
    line = F.concat(F.lit("["), (F.col("chunk_seq") + 1).cast("string"), F.lit("] "), F.regexp_replace("display_content", r"\s+", " "))
    order = Window.partitionBy("version_id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, 0)
    held = chunks.select("version_id", "chunk_seq", line.alias("line")).withColumn("used", F.sum(F.length("line") + 1).over(order)).filter(F.col("used") <= characters + 1)
    return held.groupBy("version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "line"))), lambda x: x["line"]), "\n").alias("text"))


def normalised(lines: DataFrame, sizes: DataFrame, max_entities: int = 80, max_relations: int = 160) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that lines (version_id, line_no, line) name, checked against versions' numbers of chunks (version_id, n_chunks).

    Entities need a key and a name, and keep their first line's; relations need two different
    entities that are kept and a chunk of evidence in the version. Both are limited in the
    order in which they are first named.
    """
    parsed = written(lines.select("version_id", "line_no", *(c.alias(n) for n, c in graph.parse_line(F.col("line")).items())).filter("kind is not null").join(sizes, "version_id"), "graph-lines")
    inside = F.filter("chunk_seqs", lambda n: (n >= 1) & (n <= F.col("n_chunks")))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_e")))).alias("chunk_seqs")
    by_name = Window.partitionBy("version_id").orderBy("_at")
    rows = parsed.withColumn("_e", inside)
    entities = rows.filter("kind = 'E' and key <> '' and name <> ''").groupBy("version_id", "key").agg(first("name"), first("type"), first("description"), evidence, F.min("line_no").alias("_at"))
    entities = entities.withColumn("_k", F.row_number().over(by_name)).filter(F.col("_k") <= max_entities).withColumn("normalized_name", text.normal_name(F.col("name"))).drop("_k", "_at")
    keys = entities.select("version_id", F.col("key").alias("_key"))
    said = rows.filter("kind = 'R' and key <> name").filter(F.size("_e") > 0).select("version_id", "line_no", F.col("key").alias("source_key"), F.col("name").alias("target_key"), "type", "description", "_e")
    known = said.join(keys.withColumnRenamed("_key", "source_key"), ["version_id", "source_key"], "left_semi").join(keys.withColumnRenamed("_key", "target_key"), ["version_id", "target_key"], "left_semi")
    relations = known.groupBy("version_id", "source_key", "target_key", "type").agg(first("description"), evidence, F.min("line_no").alias("_at"))
    relations = relations.withColumn("_k", F.row_number().over(by_name)).filter(F.col("_k") <= max_relations).drop("_k", "_at")
    return entities, relations


def extracted(chunks: DataFrame, extractor: Extractor, points: Column, most: int = 40, characters: int = 12_000, **limits: int) -> tuple[DataFrame, DataFrame]:
    """The whole chain for some versions' chunks: (entities, relations)."""
    sizes = chunks.groupBy("version_id").agg((F.max("chunk_seq") + 1).alias("n_chunks"))
    return normalised(extractor(texts(selected(chunks, points, most), characters)), sizes, **limits)


def in_batches(ids: DataFrame, batch: int) -> DataFrame:
    """(version_id, _batch): ids in order, ``batch`` to each batch from 0 on; a range sort, and a row for each of its parts."""
    placed = written(ids.filter("version_id is not null").orderBy("version_id").withColumn("_part", F.spark_partition_id()), "backfill-ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_start"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy("version_id")) - 1
    return placed.join(starts, "_part").select("version_id", F.floor((F.col("_start") + k) / batch).cast("long").alias("_batch"))


#: Tasks that read and write a batch's chunks.
SLOTS = 16


def run(store: Store, versions: DataFrame, chunks: DataFrame, extractor: Extractor, points: Column, batch: int = 500, force: bool = False, **how: int) -> int:
    """Works off versions in batches; returns how many got a graph. ``force`` makes all of them anew, each once in this run.

    Chunks are made once and written by batch, so that each batch reads its own.
    """
    left = written(in_batches(targets(versions, store.read("ledger"), force), batch), "backfill-targets")
    last = left.agg(F.max("_batch")).first()[0]
    if last is None:
        return 0
    slot = F.pmod(F.xxhash64("version_id"), F.lit(SLOTS))
    held = written(chunks.join(left, "version_id").repartition(F.col("_batch"), slot), "backfill-chunks", "_batch")
    done = 0
    for k in range(last + 1):
        now = left.filter(F.col("_batch") == k).select("version_id")
        ids = [r[0] for r in now.orderBy("version_id").collect()]  # a batch of ids
        entities, relations = extracted(held.filter(F.col("_batch") == k).drop("_batch"), extractor, points, **how)
        store.commit(ids, {"entities": entities, "relations": relations, "ledger": now})
        done += len(ids)
    return done
