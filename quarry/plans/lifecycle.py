"""Lookups, gates and the remaining state transitions: progress, partial updates, inserts, replacement of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import state as S
from ..sources import views as V
from ..sources.tables import read
from . import admin
from .registry import ORACLE_SQL, query

_N = f"TIMESTAMP '{V.NOW}'"


@query("SELECT version_id, version_no, lifecycle_status, row_number() OVER (ORDER BY created_at DESC, version_id) AS position FROM v_versions WHERE asset_id = 12", "versions")
def versions_of_asset(spark: SparkSession, d: str) -> DataFrame:
    """The history of one asset, the newest first."""
    order = Window.orderBy(F.col("created_at").desc(), "version_id")  # one asset's versions
    return V.versions(spark, d).filter("asset_id = 12").select("version_id", "version_no", "lifecycle_status", F.row_number().over(order).cast("long").alias("position"))


@query("SELECT job_id, asset_id, status, priority, attempts, max_attempts, created_at FROM v_jobs", "jobs")
def public_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as others may see them: without paths, workers and leases."""
    return V.jobs(spark, d).drop("heartbeat_at", "worker_id", "locked_at", "source_path")


@query("""SELECT job_id, coalesce(props->>'$.processing_stage', CASE status WHEN 'processing' THEN 'preparing' ELSE status END) AS processing_stage, (props->>'$.k')::BIGINT AS processed_items
  FROM v_jobs JOIN events ON event_id = job_id""", "jobs")
def job_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage that a job's report names, else the one of its status."""
    report = read(spark, d, "events", "event_id", "props").withColumnRenamed("event_id", "job_id")
    stage = F.coalesce(F.get_json_object("props", "$.processing_stage"), F.when(F.col("status") == "processing", "preparing").otherwise(F.col("status")))
    return V.jobs(spark, d).join(report, "job_id").select("job_id", stage.alias("processing_stage"), F.get_json_object("props", "$.k").cast("long").alias("processed_items"))


@query("SELECT pending, pending >= 100 AS rejected, CASE WHEN pending >= 100 THEN 3 END AS retry_after FROM (SELECT count(*) FILTER (status IN ('queued', 'processing')) AS pending FROM v_jobs)", "jobs")
def pending_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether an upload is turned away, as too many jobs wait."""
    return S.gate(V.jobs(spark, d), most=100, poll_seconds=3)


@query("SELECT count(*) AS total FROM v_assets WHERE deleted_at IS NULL AND title ILIKE '%th%'", "assets")
def paged_total(spark: SparkSession, d: str) -> DataFrame:
    return V.assets(spark, d).filter(F.col("deleted_at").isNull() & F.col("title").ilike("%th%")).agg(F.count(F.lit(1)).alias("total"))


@query(f"""SELECT job_id, CASE WHEN mine THEN {_N} ELSE heartbeat_at END AS heartbeat_at, CASE WHEN mine THEN 'embedding' END AS processing_stage, CASE WHEN mine THEN 0 ELSE k END AS processed_items, k
  FROM (SELECT job_id, heartbeat_at, status = 'processing' AND coalesce(job_id % 3 = 1, false) AS mine, (props->>'$.k')::BIGINT AS k, (props->>'$.processed_items')::BIGINT AS p FROM v_jobs JOIN events ON event_id = job_id)""".replace("ELSE k END AS processed_items", "ELSE p END AS processed_items"), "jobs")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """One worker reports progress: merged into the reports of the jobs that it owns, whose lease begins anew."""
    report = read(spark, d, "events", "event_id", "props").withColumnRenamed("event_id", "job_id")
    jobs = V.jobs(spark, d).join(report, "job_id").withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 3).cast("string")))
    after = S.progress(jobs, "w1", V.now(), "props", {"processing_stage": F.lit("embedding"), "processed_items": F.greatest(F.lit(0), F.lit(-5)).cast("string")})
    of = lambda k: F.try_element_at("props", F.lit(k))
    return after.select("job_id", "heartbeat_at", of("processing_stage").alias("processing_stage"), of("processed_items").cast("long").alias("processed_items"), of("k").cast("long").alias("k"))


@query("SELECT asset_id, title, CASE WHEN asset_type = 'incident' THEN 'acme' ELSE vendor END AS vendor, product FROM v_assets", "assets")
def asset_partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Only the fields that a request sets change: here the vendor, not the title and product that it leaves null."""
    return S.update_set(V.assets(spark, d), F.col("asset_type") == "incident", {"vendor": "acme", "title": None, "product": None}).select("asset_id", "title", "vendor", "product")


_NEW_MENTIONS = "SELECT chunk_id, 'n' || (asset_id % 5) AS entity_id FROM v_chunks WHERE chunk_seq <= 1"


@query(f""", old AS (SELECT DISTINCT * FROM v_mentions), new AS (SELECT DISTINCT * FROM ({_NEW_MENTIONS}))
  SELECT chunk_id, entity_id, false AS added FROM old UNION ALL SELECT chunk_id, entity_id, true FROM new ANTI JOIN old USING (chunk_id, entity_id)""", "chunks mentions")
def mentions_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """New mentions, of which those that are there already are ignored."""
    old = V.mentions(spark, d).distinct().withColumn("added", F.lit(False))
    new = V.chunks(spark, d).filter("chunk_seq <= 1").select("chunk_id", F.concat(F.lit("n"), (F.col("asset_id") % 5).cast("string")).alias("entity_id"), F.lit(True).alias("added"))
    return S.insert_ignore(old, new, ["chunk_id", "entity_id"])


@query("""SELECT key, CASE WHEN newer IS NOT NULL THEN newer ELSE older END AS content FROM (SELECT p_partkey AS key, p_name AS older, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS newer FROM part)
  UNION ALL SELECT -1, 'seed'""")
def template_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Templates by key: an update replaces the content, a seed only fills what is missing."""
    part = read(spark, d, "part", "p_partkey", "p_name", "p_type")
    old = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    put = S.replace_rows(old, part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("content")), ["key"])
    seeds = part.filter("p_partkey <= 10").select(F.col("p_partkey").alias("key"), F.lit("seed").alias("content")).unionByName(part.limit(1).select(F.lit(-1).cast("long").alias("key"), F.lit("seed").alias("content")))
    return S.insert_ignore(put, seeds, ["key"])


_LINKS = "SELECT DISTINCT c_nationkey::BIGINT AS source_id, (c_custkey % 25)::BIGINT AS target_id, CASE WHEN c_custkey % 2 = 0 THEN 'references' ELSE 'supersedes' END AS relation_type FROM customer"


def _links(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "references").otherwise("supersedes")
    return read(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("long").alias("source_id"), (F.col("c_custkey") % 25).alias("target_id"), kind.alias("relation_type")).distinct()


@query(f"SELECT source_id, target_id, relation_type FROM ({_LINKS}) WHERE source_id = 7 OR target_id = 7")
def relations_of_asset(spark: SparkSession, d: str) -> DataFrame:
    """Relations of one asset, in either direction."""
    return _links(spark, d).filter("source_id = 7 OR target_id = 7")


@query(f"""SELECT source_id, target_id, relation_type FROM ({_LINKS}) WHERE NOT (source_id = 7 AND relation_type = 'references')
  UNION SELECT n_nationkey, n_regionkey, 'references' FROM nation WHERE n_nationkey <> 7""")
def relations_edited(spark: SparkSession, d: str) -> DataFrame:
    """Some relations deleted, others added unless they are there."""
    kept = S.delete_rows(_links(spark, d), (F.col("source_id") == 7) & (F.col("relation_type") == "references"))
    new = read(spark, d, "nation", "n_nationkey", "n_regionkey").filter("n_nationkey <> 7").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_regionkey").cast("long").alias("target_id"), F.lit("references").alias("relation_type"))
    return S.insert_ignore(kept, new, ["source_id", "target_id", "relation_type"])


@query("""SELECT chunk_id, CASE WHEN chunk_seq = 0 THEN '* ' || display_content ELSE display_content END AS display_content,
    CASE WHEN chunk_seq = 0 AND asset_id % 2 = 0 THEN 'given' WHEN chunk_seq = 0 THEN '* ' || display_content ELSE display_content END AS embedding_content,
    chunk_seq = 0 AND (asset_id % 2 = 0 OR '* ' || display_content <> display_content) AS embed_again FROM v_chunks""", "chunks")
def chunks_edited(spark: SparkSession, d: str) -> DataFrame:
    """First chunks get a new text; what is embedded follows it unless it is given, and only changed texts are embedded again."""
    rows = V.chunks(spark, d).select("chunk_id", "asset_id", "chunk_seq", "display_content", F.col("display_content").alias("embedding_content"))
    hit = F.col("chunk_seq") == 0
    return S.edit_chunks(rows, hit, F.concat(F.lit("* "), "display_content"), F.when(F.col("asset_id") % 2 == 0, "given")).select("chunk_id", "display_content", "embedding_content", "embed_again")


@query("SELECT version_id, count(chunk_id) AS chunk_count FROM v_versions LEFT JOIN (SELECT * FROM v_chunks WHERE chunk_seq % 3 <> 2) USING (version_id) GROUP BY version_id", "versions chunks")
def versions_recounted(spark: SparkSession, d: str) -> DataFrame:
    """Chunk counts written back to the versions after some chunks have been deleted."""
    left = S.delete_rows(V.chunks(spark, d), F.col("chunk_seq") % 3 == 2)
    counted = left.groupBy("version_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return V.versions(spark, d).select("version_id").join(counted, "version_id", "left").select("version_id", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"))


@query("""SELECT asset_id, CASE WHEN asset_id % 34 = 0 THEN NULL ELSE deleted_at END AS deleted_at, n_cancelled FROM v_assets
  JOIN (SELECT asset_id, count(job_id) FILTER (status IN ('queued', 'processing') AND asset_id % 17 = 0 OR status = 'cancelled') AS n_cancelled FROM v_assets LEFT JOIN v_jobs USING (asset_id) GROUP BY asset_id) USING (asset_id)""", "assets jobs")
def assets_restored(spark: SparkSession, d: str) -> DataFrame:
    """Some of the deleted assets come back; their jobs stay cancelled."""
    alive = V.assets(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone, jobs = S.soft_delete(alive, V.jobs(spark, d), F.col("asset_id") % 17 == 0, F.expr("timestamp_ntz '2024-01-15 00:00:00'"))
    back = S.restore(gone, F.col("asset_id") % 34 == 0)
    n = jobs.groupBy("asset_id").agg(F.count_if(F.col("status") == "cancelled").alias("n_cancelled"))
    return back.join(n, "asset_id", "left").select("asset_id", "deleted_at", F.coalesce("n_cancelled", F.lit(0).cast("long")).alias("n_cancelled"))


_RANKED = ORACLE_SQL["duplicate_candidates"].replace("SELECT a.asset_id, a.title = q.title AS exact_title", "SELECT a.asset_id, v.created_at, a.title = q.title AS exact_title", 1)


@query(f"""SELECT asset_id, reasons, row_number() OVER (ORDER BY list_contains(reasons, 'content') DESC, list_contains(reasons, 'source_path') DESC, list_contains(reasons, 'title') DESC, list_contains(reasons, 'filename') DESC, created_at DESC, asset_id) AS position
  FROM ({_RANKED}) QUALIFY position <= 5""")
def duplicates_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest: equal content first, then path, title and name, then the youngest."""
    young = S.latest(V.versions(spark, d)).select("asset_id", F.col("created_at").alias("young"))
    found = admin.duplicate_candidates(spark, d).select("asset_id", "reasons").join(young, "asset_id")
    order = [F.array_contains("reasons", r).desc() for r in ("content", "source_path", "title", "filename")] + [F.col("young").desc(), F.col("asset_id")]
    return found.orderBy(*order).limit(5).select("asset_id", "reasons", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


_ITEMS = "SELECT version_id, display_content, row_number() OVER (PARTITION BY version_id ORDER BY chunk_seq) - 1 AS s FROM v_chunks WHERE asset_id % 5 = 2 AND length(display_content) > 20"


@query(f""", items AS ({_ITEMS}), done AS (
    SELECT version_id || ':' || lpad(s::VARCHAR, 6, '0') AS chunk_id, version_id, s AS chunk_seq, '* ' || display_content AS display_content FROM items),
  after AS (SELECT * FROM done UNION ALL SELECT chunk_id, version_id, chunk_seq, display_content FROM v_chunks WHERE version_id NOT IN (SELECT version_id FROM items))
  SELECT chunk_id, version_id, chunk_seq, display_content, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM after WINDOW w AS (PARTITION BY version_id ORDER BY chunk_seq)""", "chunks")
def complete_job_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Finished jobs replace the chunks of their versions, whole versions at a time; the others stay."""
    chunks = V.chunks(spark, d)
    items = chunks.filter("asset_id % 5 = 2 AND length(display_content) > 20").select("version_id", F.col("chunk_seq").alias("position"), F.concat(F.lit("* "), "display_content").alias("display_content"))
    return S.complete(chunks.select("chunk_id", "version_id", "chunk_seq", "display_content"), items)


@query(f"""SELECT job_id, CASE WHEN n IS NOT NULL AND status = 'processing' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'processing' THEN n END AS chunk_count, CASE WHEN n IS NOT NULL AND status = 'processing' THEN {_N} ELSE heartbeat_at END AS heartbeat_at
  FROM v_jobs LEFT JOIN (SELECT asset_id, count(*) AS n FROM v_chunks WHERE asset_id % 5 = 2 AND length(display_content) > 20 GROUP BY asset_id) USING (asset_id)""", "chunks jobs")
def complete_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Their jobs are completed with the number of chunks, if they are still being processed."""
    n = V.chunks(spark, d).filter("asset_id % 5 = 2 AND length(display_content) > 20").groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n"))
    return S.completed(V.jobs(spark, d), n, V.now()).select("job_id", "status", "chunk_count", "heartbeat_at")


@query("SELECT vec_id, len(embedding) AS dims FROM embeddings")
def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query("SELECT event_id, sha256('session-' || event_id || '-' || user_id) AS token_digest FROM events")
def token_digests(spark: SparkSession, d: str) -> DataFrame:
    """Sessions are kept by the digest of their token, never by the token."""
    return read(spark, d, "events", "event_id", "user_id").select("event_id", F.sha2(F.concat(F.lit("session-"), F.col("event_id").cast("string"), F.lit("-"), F.col("user_id").cast("string")), 256).alias("token_digest"))


@query("""SELECT page_id, name, name <> '' AND NOT starts_with(name, '.') AS valid FROM (SELECT page_id, substr(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^\\p{L}\\p{N}_.\\-]', '_', 'g'), 1, 160) AS name FROM pages)""")
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    """The last part of a path as a safe file name."""
    name = F.substring(F.regexp_replace(F.regexp_extract("url", r"([^/\\]*)$", 1), r"[^\p{L}\p{N}_.\-]", "_"), 1, 160)
    return read(spark, d, "pages", "page_id", "url").select("page_id", name.alias("name")).withColumn("valid", (F.col("name") != "") & ~F.startswith("name", F.lit(".")))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(replace(p_type, ' ', ' ,'), ','), lambda x: upper(trim(x))), lambda x: x <> ''))) AS names FROM part")
def comma_sets(spark: SparkSession, d: str) -> DataFrame:
    """Comma lists as sets of upper-case names."""
    names = F.transform(F.split(F.replace(F.col("p_type"), F.lit(" "), F.lit(" ,")), ","), lambda x: F.upper(F.trim(x)))
    return read(spark, d, "part", "p_partkey", "p_type").select("p_partkey", F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))).alias("names"))


@query("SELECT symbol_id, row_number() OVER (PARTITION BY package_name ORDER BY start_line, end_line, symbol_name, symbol_id) AS position FROM v_symbols WHERE symbol_name NOT IN ('m3', 'm7', 'if', 'for')", "symbols")
def definitions_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Definitions by their lines, without excluded names."""
    order = Window.partitionBy("package_name").orderBy("start_line", "end_line", "symbol_name", "symbol_id")
    return V.symbols(spark, d).filter(~F.col("symbol_name").isin("m3", "m7", "if", "for")).select("symbol_id", F.row_number().over(order).cast("long").alias("position"))


@query("SELECT version_id, min(chunk_seq // 10 + 1) AS page_start, max(chunk_seq // 10 + 1) AS page_end FROM v_chunks GROUP BY version_id", "chunks")
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    """First and last page of each version; ten lines are a page."""
    page = F.floor(F.col("chunk_seq") / 10) + 1
    return V.chunks(spark, d).groupBy("version_id").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"))
