"""Administration: joins, counts, pages, duplicates and state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators import symbols as Y
from ..sources import views as V
from ..sources.tables import read
from .registry import query

_N = f"TIMESTAMP '{V.NOW}'"


@query(f"SELECT job_id, asset_id FROM v_jobs WHERE status = 'processing' AND heartbeat_at < {_N} - INTERVAL 900 SECOND", "jobs")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return V.jobs(spark, d).filter((F.col("status") == "processing") & S.expired(V.now(), 900)).select("job_id", "asset_id")


@query(f"SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 12 HOUR > {_N}")
def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    live = (F.col("event_type") != "error") & (F.col("ts") + F.expr("interval 12 hours") > V.now())
    return read(spark, d, "events", "event_id", "event_type", "ts").filter(live).select("event_id")


@query(f"SELECT event_id FROM events WHERE NOT coalesce(ts < {_N} - INTERVAL 7 DAY, false)")
def purge_sessions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "event_id", "ts").filter(~F.coalesce(F.col("ts") < V.now() - F.expr("interval 7 days"), F.lit(False))).select("event_id")


@query("""SELECT version_id, CASE WHEN NOT regexp_matches(source_filename, '\\.(md|txt|log)$') THEN 'extension' WHEN contains(logical_path, '..') THEN 'path'
  WHEN lifecycle_status = 'obsolete' THEN 'lifecycle' END AS reason FROM v_versions""", "versions")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(~F.col("source_filename").rlike(r"\.(md|txt|log)$"), "extension").when(F.contains("logical_path", F.lit("..")), "path").when(F.col("lifecycle_status") == "obsolete", "lifecycle")
    return V.versions(spark, d).select("version_id", reason.alias("reason"))


_ROLES = "list_transform(string_split(lower(c_mktsegment), 'i'), lambda r: CASE WHEN r = 'bu' THEN 'admin' WHEN r = 'mach' THEN 'uploader' ELSE 'viewer' END)"


@query(f"SELECT c_custkey, list_has_any({_ROLES}, ['admin']) AS may_admin, list_has_any({_ROLES}, ['admin', 'uploader']) AS may_upload FROM customer")
def role_gate(spark: SparkSession, d: str) -> DataFrame:
    roles = F.transform(F.split(F.lower("c_mktsegment"), "i"), lambda r: F.when(r == "bu", "admin").when(r == "mach", "uploader").otherwise("viewer"))
    allowed = lambda *names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
    return read(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", allowed("admin").alias("may_admin"), allowed("admin", "uploader").alias("may_upload"))


@query("""SELECT job_id, status, version_id, a.asset_id, asset_type FROM v_jobs j JOIN v_versions v USING (asset_id) JOIN v_assets a USING (asset_id) WHERE v.is_current""", "assets versions jobs")
def job_context(spark: SparkSession, d: str) -> DataFrame:
    current = V.versions(spark, d).filter("is_current").select("asset_id", "version_id")
    return V.jobs(spark, d).select("job_id", "status", "asset_id").join(current, "asset_id").join(V.assets(spark, d).select("asset_id", "asset_type"), "asset_id").select("job_id", "status", "version_id", "asset_id", "asset_type")


@query("SELECT version_id, count(chunk_id) AS n_chunks FROM v_versions LEFT JOIN v_chunks USING (version_id) GROUP BY version_id", "versions chunks")
def version_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = V.chunks(spark, d).groupBy("version_id").agg(F.count("chunk_id").alias("n"))
    return V.versions(spark, d).select("version_id").join(counted, "version_id", "left").select("version_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"))


@query("""SELECT a.asset_id, count(DISTINCT v.version_id) AS n_versions, count(DISTINCT c.chunk_id) AS n_chunks
  FROM v_assets a LEFT JOIN v_versions v ON v.asset_id = a.asset_id LEFT JOIN v_chunks c ON c.asset_id = a.asset_id GROUP BY a.asset_id""", "assets versions chunks")
def asset_fanout_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each side is counted before the join, so that rows don't multiply."""
    per = lambda df, n: df.groupBy("asset_id").agg(F.count(F.lit(1)).alias(n))
    none = F.lit(0).cast("long")
    return (
        V.assets(spark, d).select("asset_id").join(per(V.versions(spark, d), "v"), "asset_id", "left").join(per(V.chunks(spark, d), "c"), "asset_id", "left")
        .select("asset_id", F.coalesce("v", none).alias("n_versions"), F.coalesce("c", none).alias("n_chunks"))
    )


@query("""SELECT f.trace_id, f.frame_seq, s.symbol_id FROM v_frames f JOIN v_symbols s ON s.symbol_name = f.method_name
  AND (s.package_name || '.' || s.class_name = f.class_name OR f.class_name LIKE s.package_name || '.' || s.class_name || '$%')""", "frames symbols")
def trace_to_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Frames and symbols meet by outer class and method: an equi-join, whose residual is then checked."""
    owner = F.concat_ws(".", "package_name", "class_name")
    symbols = V.symbols(spark, d).select("symbol_id", F.col("symbol_name").alias("method_name"), owner.alias("outer_name"))
    frames = V.frames(spark, d).withColumn("outer_name", F.substring_index("class_name", "$", 1))
    return Y.meant(frames.drop("class_name"), symbols, "method_name", "outer_name").select("trace_id", "frame_seq", "symbol_id")


@query("SELECT asset_id, version_id FROM v_versions v WHERE EXISTS (SELECT 1 FROM v_versions w WHERE w.sha256 = v.sha256 AND w.asset_id <> v.asset_id)", "versions")
def exists_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    rows = V.versions(spark, d).select("asset_id", "version_id", "sha256")
    shared = rows.groupBy("sha256").agg(F.min("asset_id").alias("lo"), F.max("asset_id").alias("hi")).filter("lo <> hi")
    return rows.join(shared, "sha256", "left_semi").select("asset_id", "version_id")


@query("SELECT version_id FROM v_versions v WHERE NOT EXISTS (SELECT 1 FROM v_chunks c JOIN v_mentions m USING (chunk_id) WHERE c.version_id = v.version_id)", "versions chunks mentions")
def versions_without_mentions(spark: SparkSession, d: str) -> DataFrame:
    mentioned = V.chunks(spark, d).join(V.mentions(spark, d).select("chunk_id"), "chunk_id", "left_semi").select("version_id")
    return V.versions(spark, d).select("version_id").join(mentioned, "version_id", "left_anti")


@query("""SELECT m.symbol_id, min_by(o.symbol_id, (o.end_line - o.start_line) * 1000000 + o.symbol_id) AS owner_id
  FROM v_symbols m JOIN v_symbols o ON o.package_name = m.package_name AND o.start_line <= m.start_line AND m.end_line <= o.end_line AND o.symbol_id <> m.symbol_id GROUP BY m.symbol_id""", "symbols")
def range_owner_innermost(spark: SparkSession, d: str) -> DataFrame:
    """The smallest range of the package that holds a symbol's lines, by the order of the SQL."""
    return Y.innermost_owners(V.symbols(spark, d))


@query("""SELECT t.asset_type, count(a.asset_id) AS n FROM (SELECT unnest(['document', 'incident', 'error_trace', 'source_code']) AS asset_type) t
  LEFT JOIN v_assets a ON a.asset_type = t.asset_type AND a.deleted_at IS NULL GROUP BY t.asset_type""", "assets")
def assets_by_type_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    counted = V.assets(spark, d).filter(F.col("deleted_at").isNull()).groupBy("asset_type").agg(F.count(F.lit(1)).alias("k"))
    kinds = spark.createDataFrame([(t,) for t in V.ASSET_TYPES], "asset_type string")
    return kinds.join(counted, "asset_type", "left").select("asset_type", F.coalesce("k", F.lit(0).cast("long")).alias("n"))


@query("""SELECT (SELECT count(*) FROM v_assets WHERE deleted_at IS NULL) AS assets, (SELECT count(*) FROM v_assets WHERE deleted_at IS NOT NULL) AS deleted,
  (SELECT count(*) FROM v_versions) AS versions, (SELECT count(*) FROM v_chunks) AS chunks, (SELECT count(*) FROM v_jobs WHERE status = 'queued') AS queued,
  (SELECT count(*) FROM v_jobs WHERE status = 'failed') AS failed, (SELECT count(*) FROM v_relations) AS relations""", "assets versions chunks jobs relations")
def admin_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row; each side of the cross joins is an aggregate of one row."""
    a = V.assets(spark, d).agg(F.count_if(F.col("deleted_at").isNull()).alias("assets"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))
    j = V.jobs(spark, d).agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "failed").alias("failed"))
    for name, df in (("versions", V.versions(spark, d)), ("chunks", V.chunks(spark, d)), ("relations", V.relations(spark, d))):
        a = a.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return a.crossJoin(j)


@query("SELECT status, count(*) AS n FROM v_jobs GROUP BY status", "jobs")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.jobs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT version_id, coalesce(max(chunk_seq), -1) + 1 AS next_seq FROM v_versions LEFT JOIN v_chunks USING (version_id) GROUP BY version_id", "versions chunks")
def next_chunk_seq(spark: SparkSession, d: str) -> DataFrame:
    last = V.chunks(spark, d).groupBy("version_id").agg(F.max("chunk_seq").alias("last"))
    return V.versions(spark, d).select("version_id").join(last, "version_id", "left").select("version_id", (F.coalesce("last", F.lit(-1).cast("long")) + 1).alias("next_seq"))


@query("""SELECT asset_id, version_id, version_no FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY is_current DESC, created_at DESC, version_id DESC) AS n FROM v_versions) WHERE n = 1""", "versions")
def latest_version_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(V.versions(spark, d)).select("asset_id", "version_id", "version_no")


@query(f"""SELECT job_id, row_number() OVER (ORDER BY priority, created_at, job_id) AS position FROM (
  SELECT * FROM v_jobs WHERE (status = 'queued' OR (status = 'processing' AND heartbeat_at < {_N} - INTERVAL 900 SECOND)) AND attempts < max_attempts ORDER BY priority, created_at, job_id LIMIT 50)""", "jobs")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    ready = ((F.col("status") == "queued") | ((F.col("status") == "processing") & S.expired(V.now(), 900))) & (F.col("attempts") < F.col("max_attempts"))
    first = V.jobs(spark, d).filter(ready).orderBy("priority", "created_at", "job_id").limit(50)
    return first.select("job_id", F.row_number().over(Window.orderBy("priority", "created_at", "job_id")).cast("long").alias("position"))


@query("SELECT asset_id, title FROM v_assets WHERE deleted_at IS NULL ORDER BY created_at DESC, asset_id LIMIT 20 OFFSET 40", "assets")
def paged_assets(spark: SparkSession, d: str) -> DataFrame:
    return V.assets(spark, d).filter(F.col("deleted_at").isNull()).orderBy(F.col("created_at").desc(), "asset_id").offset(40).limit(20).select("asset_id", "title")


@query("""SELECT a.asset_id, a.title = q.title AS exact_title, v.source_filename = q.source_filename AS exact_filename, v.logical_path = q.logical_path AND v.repository = q.repository AS exact_source_path,
    list_filter([CASE WHEN v.sha256 = q.sha256 THEN 'content' END, CASE WHEN v.logical_path = q.logical_path AND v.repository = q.repository THEN 'source_path' END,
      CASE WHEN lower(replace(a.title, ' ', '')) = lower(replace(q.title, ' ', '')) THEN 'title' END, CASE WHEN v.source_filename = q.source_filename THEN 'filename' END], lambda x: x IS NOT NULL) AS reasons
  FROM v_assets a JOIN v_versions v ON v.asset_id = a.asset_id AND v.is_current,
    (SELECT a.asset_type, a.title, v.* FROM v_assets a JOIN v_versions v USING (asset_id) WHERE a.asset_id = 8 AND v.is_current) q
  WHERE a.deleted_at IS NULL AND a.asset_type = q.asset_type
    AND (v.sha256 = q.sha256 OR (v.logical_path = q.logical_path AND v.repository = q.repository) OR lower(replace(a.title, ' ', '')) = lower(replace(q.title, ' ', '')) OR v.source_filename = q.source_filename)""", "assets versions")
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Assets that may be the one given (asset 8), with the reasons."""
    rows = V.assets(spark, d).join(S.latest(V.versions(spark, d)).drop("created_at"), "asset_id")
    wanted = rows.filter("asset_id = 8").select(*[F.col(c).alias(f"q_{c}") for c in ("asset_type", "title", "sha256", "source_filename", "logical_path", "repository")])
    plain = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    content, title, name = F.col("sha256") == F.col("q_sha256"), plain("title") == plain("q_title"), F.col("source_filename") == F.col("q_source_filename")
    path = (F.col("logical_path") == F.col("q_logical_path")) & (F.col("repository") == F.col("q_repository"))
    # the wanted asset is one row
    met = rows.filter(F.col("deleted_at").isNull()).join(F.broadcast(wanted), F.col("asset_type") == F.col("q_asset_type")).filter(content | path | title | name)
    reasons = F.array_compact(F.array(F.when(content, "content"), F.when(path, "source_path"), F.when(title, "title"), F.when(name, "filename")))
    return met.select("asset_id", (F.col("title") == F.col("q_title")).alias("exact_title"), name.alias("exact_filename"), path.alias("exact_source_path"), reasons.alias("reasons"))


@query("SELECT asset_id, max_by(job_id, (created_at, job_id)) AS job_id, max_by(status, (created_at, job_id)) AS status FROM v_jobs GROUP BY asset_id", "jobs")
def latest_exact_job(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("created_at", "job_id")
    return V.jobs(spark, d).groupBy("asset_id").agg(F.max_by("job_id", order).alias("job_id"), F.max_by("status", order).alias("status"))


@query("SELECT version_id, string_agg(display_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_seq) || chr(10) AS document FROM v_chunks GROUP BY version_id", "chunks")
def reconstruct_document(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "display_content"))), lambda x: x["display_content"])
    return V.chunks(spark, d).groupBy("version_id").agg(F.concat(F.array_join(parts, "\n\n---\n\n"), F.lit("\n")).alias("document"))


@query("SELECT DISTINCT version_id FROM v_chunks WHERE contains(display_content, 'the')", "chunks")
def distinct_versions(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).filter(F.contains("display_content", F.lit("the"))).select("version_id").distinct()


_EXPIRED = f"(status = 'processing' AND coalesce(heartbeat_at < {_N} - INTERVAL 900 SECOND, false))"


@query(f""", f AS (SELECT *, CASE WHEN {_EXPIRED} AND attempts >= max_attempts THEN 'failed' ELSE status END AS s FROM v_jobs),
  c AS (SELECT job_id FROM f WHERE (s = 'queued' OR (s = 'processing' AND {_EXPIRED})) AND attempts < max_attempts ORDER BY priority, created_at, job_id LIMIT 100)
  SELECT f.job_id, CASE WHEN c.job_id IS NOT NULL THEN 'processing' ELSE s END AS status, attempts + (c.job_id IS NOT NULL)::BIGINT AS attempts,
    CASE WHEN c.job_id IS NOT NULL THEN {_N} ELSE heartbeat_at END AS heartbeat_at, CASE WHEN c.job_id IS NOT NULL THEN 'preparing' END AS stage FROM f LEFT JOIN c USING (job_id)""", "jobs")
def claim_jobs(spark: SparkSession, d: str) -> DataFrame:
    return S.claim(V.jobs(spark, d), V.now(), 100)


@query(f"""SELECT job_id, CASE WHEN status = 'processing' AND attempts < max_attempts THEN 'queued' WHEN status = 'processing' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'processing' AND attempts >= max_attempts THEN {_N} END AS completed_at FROM v_jobs""", "jobs")
def fail_jobs(spark: SparkSession, d: str) -> DataFrame:
    return S.fail(V.jobs(spark, d), V.now())


@query("SELECT job_id, CASE WHEN status IN ('failed', 'cancelled') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('failed', 'cancelled') THEN 0 ELSE attempts END AS attempts FROM v_jobs", "jobs")
def retry_jobs(spark: SparkSession, d: str) -> DataFrame:
    return S.retry(V.jobs(spark, d))


@query("""SELECT job_id, CASE WHEN status IN ('queued', 'processing') AND a.asset_id IS NOT NULL THEN 'cancelled' ELSE status END AS status
  FROM v_jobs LEFT JOIN (SELECT asset_id FROM v_assets WHERE vendor = 'src3' AND deleted_at IS NULL) a USING (asset_id)""", "assets jobs")
def soft_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    _, jobs = S.soft_delete(V.assets(spark, d), V.jobs(spark, d), F.col("vendor") == "src3", V.now())
    return jobs.select("job_id", "status")


@query("""SELECT version_id, is_current AND asset_id % 4 <> 0 AS is_current FROM v_versions UNION ALL SELECT asset_id * 10 + 9, true FROM v_assets WHERE asset_id % 4 = 0""", "assets versions")
def new_version_demotes(spark: SparkSession, d: str) -> DataFrame:
    """Source-code assets get a new version."""
    new = V.assets(spark, d).filter(F.col("asset_type") == "document").select((F.col("asset_id") * 10 + 9).alias("version_id"), "asset_id", F.lit(True).alias("is_current"))
    return S.add_versions(V.versions(spark, d).select("version_id", "asset_id", "is_current"), new).select("version_id", "is_current")


@query("""SELECT entity_id, CASE WHEN entity_type = 'nation' THEN 'a nation' WHEN entity_type = 'region' THEN 'old' END AS description, CASE WHEN entity_type = 'nation' THEN 2 ELSE 1 END::BIGINT AS revision FROM v_entities""", "entities")
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nations come again with a description; regions come again without one and keep theirs."""
    e = V.entities(spark, d)
    kind = F.col("entity_type")
    old = e.select("entity_id", F.when(kind == "region", "old").otherwise("").alias("description"), F.lit(1).cast("long").alias("revision"))
    new = e.filter(kind.isin("nation", "region")).select("entity_id", F.when(kind == "nation", "a nation").otherwise("").alias("description"), F.when(kind == "nation", 2).otherwise(1).cast("long").alias("revision"))
    return S.upsert(old, new, ["entity_id"], ["description"], ["revision"])


@query("""SELECT source_id, target_id, relation_type, greatest(confidence, 0.5)::DOUBLE AS confidence FROM v_relations""", "relations")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    r = V.relations(spark, d).select("source_id", "target_id", "relation_type", F.col("confidence").cast("double").alias("confidence"))
    return S.upsert(r, r.withColumn("confidence", F.lit(0.5)), ["source_id", "target_id", "relation_type"], [], ["confidence"])


@query(""", held AS (SELECT * FROM v_relations WHERE confidence >= 0.2)
  SELECT entity_id FROM v_entities WHERE entity_id IN (SELECT entity_id FROM v_mentions) OR entity_id IN (SELECT source_id FROM held) OR entity_id IN (SELECT target_id FROM held)""", "chunks entities relations mentions")
def orphan_gc(spark: SparkSession, d: str) -> DataFrame:
    """Relations with little confidence lose their evidence, then entities that nothing holds go."""
    r = V.relations(spark, d)
    kept, _ = S.without_orphans(V.entities(spark, d), r, V.mentions(spark, d), r.filter("confidence >= 0.2"))
    return kept.select("entity_id")


@query("""SELECT j.asset_id, CASE WHEN status IN ('failed', 'cancelled') THEN 'retry' WHEN status IN ('queued', 'processing') THEN 'reuse' ELSE 'normal' END AS decision
  FROM (SELECT asset_id, max_by(status, (created_at, job_id)) AS status FROM v_jobs GROUP BY asset_id) j""", "jobs")
def job_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    return latest_exact_job(spark, d).select("asset_id", F.when(status.isin("failed", "cancelled"), "retry").when(status.isin("queued", "processing"), "reuse").otherwise("normal").alias("decision"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' WHEN c_mktsegment = 'MACHINERY' THEN 'viewer' ELSE 'uploader' END AS role,
  c_mktsegment = 'MACHINERY' AND e.user_id IS NOT NULL AS revoked FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c_custkey""")
def role_upsert_revoke(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment become viewers, which ends their sessions; without a role they are uploaders."""
    users = read(spark, d, "events", "user_id").distinct().select(F.col("user_id").alias("c_custkey"), F.lit(True).alias("s"))
    segment = F.col("c_mktsegment")
    role = F.when(segment == "BUILDING", "admin").when(segment == "MACHINERY", "viewer").otherwise("uploader")
    return read(spark, d, "customer", "c_custkey", "c_mktsegment").join(users, "c_custkey", "left").select("c_custkey", role.alias("role"), ((segment == "MACHINERY") & F.col("s").isNotNull()).alias("revoked"))


@query("SELECT c_mktsegment AS department, count(*) FILTER (c_acctbal > 5000) AS n_admins, count(*) FILTER (c_acctbal > 5000) > 1 AS may_remove FROM customer GROUP BY c_mktsegment")
def last_admin_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("c_acctbal") > 5000)
    return read(spark, d, "customer", "c_mktsegment", "c_acctbal").groupBy(F.col("c_mktsegment").alias("department")).agg(n.alias("n_admins"), (n > 1).alias("may_remove"))
