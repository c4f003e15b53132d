"""State transitions as next-state frames: what a table holds after a statement has run.

``now`` is a column, so that a plan gives the same rows whenever it runs. A heartbeat that
is null is never expired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired(now: Column, lease_seconds: int) -> Column:
    return F.coalesce(F.col("heartbeat_at") < now - F.expr(f"interval '{lease_seconds}' second"), F.lit(False))


def claim(jobs: DataFrame, now: Column, limit: int, lease_seconds: int = 900) -> DataFrame:
    """Exhausted leases fail; of the open jobs the first ``limit`` by priority and age go to a worker."""
    over = (F.col("status") == "processing") & expired(now, lease_seconds)
    failed = over & (F.col("attempts") >= F.col("max_attempts"))
    after = jobs.withColumn("status", F.when(failed, "failed").otherwise(F.col("status")))
    ready = ((F.col("status") == "queued") | ((F.col("status") == "processing") & expired(now, lease_seconds))) & (F.col("attempts") < F.col("max_attempts"))
    chosen = after.filter(ready).orderBy("priority", "created_at", "job_id").limit(limit).select("job_id", F.lit(True).alias("_claimed"))
    taken = F.coalesce("_claimed", F.lit(False))
    return after.join(chosen, "job_id", "left").select(
        "job_id",
        F.when(taken, "processing").otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + taken.cast("long")).alias("attempts"),
        F.when(taken, now).otherwise(F.col("heartbeat_at")).alias("heartbeat_at"),
        F.when(taken, "preparing").alias("stage"),
    )


def fail(jobs: DataFrame, now: Column) -> DataFrame:
    """A failed attempt goes back to the queue, or is the last."""
    busy, again = F.col("status") == "processing", F.col("attempts") < F.col("max_attempts")
    return jobs.select(
        "job_id",
        F.when(busy & again, "queued").when(busy, "failed").otherwise(F.col("status")).alias("status"),
        F.when(busy & ~again, now).alias("completed_at"),
    )


def retry(jobs: DataFrame) -> DataFrame:
    back = F.col("status").isin("failed", "cancelled")
    return jobs.select("job_id", F.when(back, "queued").otherwise(F.col("status")).alias("status"), F.when(back, F.lit(0).cast("long")).otherwise(F.col("attempts")).alias("attempts"))


def soft_delete(assets: DataFrame, jobs: DataFrame, hit: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Assets marked as deleted, and their open jobs cancelled."""
    gone = hit & F.col("deleted_at").isNull()
    marked = assets.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at")))
    open_jobs = F.col("status").isin("queued", "processing")
    cancelled = jobs.join(assets.filter(gone).select("asset_id", F.lit(True).alias("_gone")), "asset_id", "left").withColumn(
        "status", F.when(open_jobs & F.coalesce("_gone", F.lit(False)), "cancelled").otherwise(F.col("status"))
    ).drop("_gone")
    return marked, cancelled


def add_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New current versions demote those that were current."""
    touched = new.select("asset_id", F.lit(True).alias("_new")).distinct()
    old = versions.join(touched, "asset_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], texts: list[str], largest: list[str]) -> DataFrame:
    """Rows by key: of ``texts`` the newest that isn't empty stays, of ``largest`` the greatest."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    kept = [F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("_age"))).alias(c) for c in texts]
    return both.groupBy(*keys).agg(*kept, *[F.max(c).alias(c) for c in largest])


def without_orphans(entities: DataFrame, relations: DataFrame, mentions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations without evidence go first, then entities without a mention or a relation."""
    held = relations.join(evidence.select("source_id", "target_id", "relation_type").distinct(), ["source_id", "target_id", "relation_type"], "left_semi")
    used = mentions.select("entity_id").unionByName(held.select(F.col("source_id").alias("entity_id"))).unionByName(held.select(F.col("target_id").alias("entity_id"))).distinct()
    return entities.join(used, "entity_id", "left_semi"), held


def latest(versions: DataFrame) -> DataFrame:
    """One version for each asset: the current one, else the youngest."""
    order = Window.partitionBy("asset_id").orderBy(F.col("is_current").desc(), F.col("created_at").desc(), F.col("version_id").desc())
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def gate(jobs: DataFrame, most: int, poll_seconds: int) -> DataFrame:
    """One row (pending, rejected, retry_after): whether too many jobs wait."""
    pending = jobs.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("pending"))
    return pending.select("pending", (F.col("pending") >= most).alias("rejected"), F.when(F.col("pending") >= most, max(1, poll_seconds)).alias("retry_after"))


def progress(jobs: DataFrame, worker: str, now: Column, report: str, values: dict[str, Column]) -> DataFrame:
    """A worker's report merged into those of the jobs that it is processing, as a map; new values win. Others stay."""
    mine = (F.col("status") == "processing") & (F.col("worker_id") == worker)
    old = F.coalesce(F.from_json(report, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*values))
    new = F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]))
    return jobs.withColumns({report: F.when(mine, new).otherwise(old), "heartbeat_at": F.when(mine, now).otherwise(F.col("heartbeat_at"))})


def update_set(rows: DataFrame, hit: Column, values: dict[str, object]) -> DataFrame:
    """Rows with the fields that are set; a field that is None is not."""
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows by key, each once, unless the key is there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key replaced by new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_rows(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.filter(~F.coalesce(hit, F.lit(False)))


def restore(assets: DataFrame, hit: Column) -> DataFrame:
    """Deleted assets come back; their jobs are left as they are."""
    return assets.withColumn("deleted_at", F.when(~F.coalesce(hit, F.lit(False)), F.col("deleted_at")))


def edit_chunks(chunks: DataFrame, hit: Column, display: Column, embedding: Column) -> DataFrame:
    """New texts; what is embedded follows the text unless it is given. ``embed_again``: it has changed."""
    new = F.coalesce(embedding, display)
    changed = hit & (new != F.col("embedding_content"))
    return chunks.select(
        *[c for c in chunks.columns if c not in ("display_content", "embedding_content")],
        F.when(hit, display).otherwise(F.col("display_content")).alias("display_content"),
        F.when(hit, new).otherwise(F.col("embedding_content")).alias("embedding_content"), F.coalesce(changed, F.lit(False)).alias("embed_again"),
    )


def complete(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks after the versions of ``items`` (version_id, position, display_content) have been replaced, linked in order."""
    order = Window.partitionBy("version_id").orderBy("position")
    made = items.withColumn("chunk_seq", (F.row_number().over(order) - 1).cast("long"))
    made = made.select(F.concat(F.col("version_id").cast("string"), F.lit(":"), F.lpad(F.col("chunk_seq").cast("string"), 6, "0")).alias("chunk_id"), "version_id", "chunk_seq", "display_content")
    after = chunks.join(items.select("version_id"), "version_id", "left_anti").select(*made.columns).unionByName(made)
    linked = Window.partitionBy("version_id").orderBy("chunk_seq")
    return after.withColumns({"previous_chunk_id": F.lag("chunk_id").over(linked), "next_chunk_id": F.lead("chunk_id").over(linked)})


def completed(jobs: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Jobs of assets with counted chunks (asset_id, _n) are completed, if they are being processed."""
    joined = jobs.join(counts, "asset_id", "left")
    done = (F.col("status") == "processing") & F.col("_n").isNotNull()
    return joined.select(
        *[c for c in jobs.columns if c not in ("status", "heartbeat_at")],
        F.when(done, "completed").otherwise(F.col("status")).alias("status"), F.when(done, F.col("_n")).alias("chunk_count"), F.when(done, now).otherwise(F.col("heartbeat_at")).alias("heartbeat_at"),
    )


def requeue(jobs: DataFrame, report: str, now: Column) -> DataFrame:
    """Failed and cancelled jobs are queued as if new: attempts, worker, times and error are reset, the report (a JSON object) says so and keeps its other fields."""
    back = F.col("status").isin("failed", "cancelled")
    old = F.map_filter(F.coalesce(F.from_json(report, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("processing_stage", "processed_items", "total_items"))
    said = F.map_concat(old, F.create_map(F.lit("processing_stage"), F.lit("queued"), F.lit("processed_items"), F.lit(None).cast("string"), F.lit("total_items"), F.lit(None).cast("string")))
    values = {"status": F.lit("queued"), "attempts": F.lit(0), report: F.to_json(said, {"ignoreNullFields": "false"}), "updated_at": now}
    values |= {c: F.lit(None) for c in ("worker_id", "locked_at", "heartbeat_at", "error_detail", "completed_at")}
    return jobs.withColumns({c: F.when(back, v.cast(jobs.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if c in jobs.columns})


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], replaced: Sequence[str] = (), texts: Sequence[str] = (), largest: Sequence[str] = (), merged: str | None = None) -> DataFrame:
    """Rows by key after ``new`` (with ``seq``, its order) has come row by row: the newest value of ``replaced``, the newest of ``texts`` that isn't empty, the greatest of ``largest``.

    ``merged`` is a map, of which the newest value of each field stays. Nothing but a key's
    fields meets in one task, however many rows a key has. Null keys are a key like others.
    """
    both = old.withColumn("seq", F.lit(None).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long"))).withColumn("_age", F.coalesce("seq", F.lit(-(2**63)).cast("long")))
    newest = [F.max_by(F.struct(c), "_age")[c].alias(c) for c in replaced]
    said = [F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("_age"))), F.lit("")).alias(c) for c in texts]
    rows = both.groupBy(*keys).agg(*newest, *said, *[F.max(c).alias(c) for c in largest])
    if merged is None:
        return rows
    fields = both.select(*keys, "_age", F.explode(merged).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max_by(F.struct("_v"), "_age")["_v"].alias("_v"))
    maps = fields.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(merged))
    named = maps.select(*[F.col(k).alias(f"_{k}") for k in keys], merged)
    same = [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    held = rows.join(named, same, "left").drop(*[f"_{k}" for k in keys])
    return held.withColumn(merged, F.coalesce(merged, F.create_map().cast(held.schema[merged].dataType)))
