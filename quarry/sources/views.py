"""The engine's assets, versions, chunks, jobs, logs and graph, derived from the given tables.

Each view stands here twice, as a DataFrame and as a common table expression in SQL, so
that the two can't drift. ``NOW`` is the fixed present of all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

NOW = "2024-01-31 00:00:00"
#: Kinds of assets, in the order of the ids.
ASSET_TYPES = ("document", "incident", "error_trace", "source_code")
#: States of jobs by kind of event.
STATUSES = {"click": "queued", "view": "processing", "purchase": "completed", "signup": "failed", "error": "cancelled"}


def now() -> Column:
    return F.expr(f"timestamp_ntz '{NOW}'")


def _minutes(n: Column | str, hours: str = "0") -> Column:
    return F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, {hours}, {n})")


def assets(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    return read(spark, d, "documents").select(
        doc.alias("asset_id"),
        F.get(F.array(*map(F.lit, ASSET_TYPES)), (doc % 4).cast("int")).alias("asset_type"),
        F.col("source").alias("vendor"),
        F.col("lang").alias("product"),
        F.concat(F.lit("sys-"), (doc % 10).cast("string")).alias("system_name"),
        F.concat(F.lit("svc-"), (doc % 6).cast("string")).alias("service_name"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.when(doc % 17 == 0, F.expr("timestamp_ntz '2024-01-15 00:00:00'")).alias("deleted_at"),
        _minutes("cast(doc_id as int)").alias("created_at"),
    )


ASSETS = """v_assets AS (
  SELECT doc_id AS asset_id, (['document', 'incident', 'error_trace', 'source_code'])[doc_id % 4 + 1] AS asset_type,
    source AS vendor, lang AS product, 'sys-' || (doc_id % 10) AS system_name, 'svc-' || (doc_id % 6) AS service_name,
    substr(string_split(text, chr(10))[1], 1, 60) AS title,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    doc, n, last = F.col("doc_id"), F.col("version_no"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    rows = read(spark, d, "documents", "doc_id", "text").withColumn("version_no", F.explode(F.sequence(F.lit(1), last)))
    return rows.select(
        (doc * 10 + n).alias("version_id"),
        doc.alias("asset_id"),
        n.cast("long").alias("version_no"),
        (n == last).alias("is_current"),
        F.when(doc % 11 == 0, "obsolete").when(doc % 7 == 0, "draft").otherwise("approved").alias("lifecycle_status"),
        F.sha2(F.concat("text", F.when(n < last, "#old").otherwise("")), 256).alias("sha256"),
        F.concat(F.lit("file-"), (doc % 50).cast("string"), F.lit(".md")).alias("source_filename"),
        F.concat(F.lit("repo-"), (doc % 5).cast("string")).alias("repository"),
        F.concat(F.lit("src/"), (doc % 40).cast("string"), F.lit(".java")).alias("logical_path"),
        _minutes("cast(doc_id as int)", "version_no").alias("created_at"),
    )


VERSIONS = """v_versions AS (
  SELECT doc_id * 10 + n AS version_id, doc_id AS asset_id, n::BIGINT AS version_no, n = last AS is_current,
    CASE WHEN doc_id % 11 = 0 THEN 'obsolete' WHEN doc_id % 7 = 0 THEN 'draft' ELSE 'approved' END AS lifecycle_status,
    sha256(text || CASE WHEN n < last THEN '#old' ELSE '' END) AS sha256, 'file-' || (doc_id % 50) || '.md' AS source_filename,
    'repo-' || (doc_id % 5) AS repository, 'src/' || (doc_id % 40) || '.java' AS logical_path,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(n) AS created_at
  FROM (SELECT *, unnest(range(1, last + 1)) AS n FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS last FROM documents)))"""


def chunks(spark: SparkSession, d: str, linked: bool = False) -> DataFrame:
    """Lines of documents that aren't blank; ``linked``: with the ids of the ones before and after."""
    doc = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("seq", "line"))
    named = lambda seq: F.concat_ws("-", doc.cast("string"), seq.cast("string"))
    links = [
        F.when(F.col("seq") > 0, named(F.col("seq") - 1)).alias("previous_chunk_id"), F.when(F.col("seq") + 1 < F.col("n"), named(F.col("seq") + 1)).alias("next_chunk_id")
    ] if linked else []
    vectors = read(spark, d, "embeddings").agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return rows.select(
        named(F.col("seq")).alias("chunk_id"),
        doc.alias("asset_id"),
        (doc * 10 + F.when(doc % 3 == 0, 2).otherwise(1)).alias("version_id"),
        F.col("seq").cast("long").alias("chunk_seq"),
        F.col("line").alias("display_content"),
        F.concat(F.lit("DOC"), F.lpad((doc % 1000).cast("string"), 4, "0")).alias("identifier"),
        ((doc * 31 + F.col("seq")) % vectors).alias("vec_id"),
        *links,
    )


CHUNKS = """v_chunks AS (
  SELECT doc_id || '-' || (i - 1) AS chunk_id, doc_id AS asset_id, doc_id * 10 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version_id,
    (i - 1)::BIGINT AS chunk_seq, lines[i] AS display_content, 'DOC' || lpad((doc_id % 1000)::VARCHAR, 4, '0') AS identifier,
    (doc_id * 31 + i - 1) % (SELECT count(*) FROM embeddings) AS vec_id
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)))"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.lit(None).cast("string")
    for kind, name in STATUSES.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return read(spark, d, "events").select(
        F.col("event_id").alias("job_id"),
        (F.col("event_id") % 997).alias("asset_id"),
        status.alias("status"),
        (F.col("user_id") % 5).alias("priority"),
        (k % 4).alias("attempts"),
        F.lit(3).cast("long").alias("max_attempts"),
        F.when(k % 10 != 0, F.col("ts")).alias("heartbeat_at"),
        F.col("ts").alias("created_at"),
    )


JOBS = """v_jobs AS (
  SELECT event_id AS job_id, event_id % 997 AS asset_id,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' WHEN 'error' THEN 'cancelled' END AS status,
    user_id % 5 AS priority, k % 4 AS attempts, 3::BIGINT AS max_attempts, CASE WHEN k % 10 <> 0 THEN ts END AS heartbeat_at, ts AS created_at
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one log for each user; every third has no timestamp, errors name a code and an exception."""
    k = F.get_json_object("props", "$.k").cast("long")
    error = F.col("event_type") == "error"
    stamp = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    level = F.when(error, "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    said = F.when(error, F.concat(F.lit("PAY"), F.lpad(k.cast("string"), 4, "0"), F.lit(" com.acme.pay.Pay"), (k % 7).cast("string"), F.lit("Exception: rejected"))).otherwise(
        F.concat(F.lit("step "), F.col("event_type"), F.lit(" took "), k.cast("string"), F.lit(" ms"))
    )
    return read(spark, d, "events").select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), F.concat(stamp, level, F.lit(" "), said).alias("line")
    )


LOG_LINES = """v_log_lines AS (
  SELECT user_id AS log_id, event_id AS line_no,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' END
    || CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'WARN' ELSE 'INFO' END || ' '
    || CASE WHEN event_type = 'error' THEN 'PAY' || lpad(k::VARCHAR, 4, '0') || ' com.acme.pay.Pay' || (k % 7) || 'Exception: rejected'
       ELSE 'step ' || event_type || ' took ' || k || ' ms' END AS line
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Stack frames (trace_id, frame_seq, class_name, method_name, is_app) of line items."""
    part = F.col("l_partkey")
    owner = F.concat(F.lit("com.acme.b"), (part % 25).cast("string"), F.lit(".Svc"), (part % 40).cast("string"), F.when(part % 5 == 0, "$Inner").otherwise(""))
    # line numbers repeat within an order; lines that also share their part are equal frames, so nothing else is sorted, or shuffled
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    numbered = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("frame_seq", F.row_number().over(order).cast("long"))
    # names are made behind the shuffle
    return numbered.select(
        F.col("l_orderkey").alias("trace_id"),
        "frame_seq",
        F.when(part % 9 == 0, "java.util.ArrayList").otherwise(owner).alias("class_name"),
        F.concat(F.lit("m"), (part % 12).cast("string")).alias("method_name"),
    )


FRAMES = """v_frames AS (
  SELECT l_orderkey AS trace_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS frame_seq,
    CASE WHEN l_partkey % 9 = 0 THEN 'java.util.ArrayList' ELSE 'com.acme.b' || (l_partkey % 25) || '.Svc' || (l_partkey % 40) || CASE WHEN l_partkey % 5 = 0 THEN '$Inner' ELSE '' END END AS class_name,
    'm' || (l_partkey % 12) AS method_name
  FROM lineitem)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("p_partkey")
    return read(spark, d, "part", "p_partkey").select(
        part.alias("symbol_id"),
        F.concat(F.lit("com.acme.b"), (part % 25).cast("string")).alias("package_name"),
        F.concat(F.lit("Svc"), (part % 40).cast("string")).alias("class_name"),
        F.concat(F.lit("m"), (part % 12).cast("string")).alias("symbol_name"),
        (part % 100 * 10).alias("start_line"),
        (part % 100 * 10 + part % 30 + 1).alias("end_line"),
    )


SYMBOLS = """v_symbols AS (
  SELECT p_partkey AS symbol_id, 'com.acme.b' || (p_partkey % 25) AS package_name, 'Svc' || (p_partkey % 40) AS class_name, 'm' || (p_partkey % 12) AS symbol_name,
    p_partkey % 100 * 10 AS start_line, p_partkey % 100 * 10 + p_partkey % 30 + 1 AS end_line
  FROM part)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities: regions, nations, suppliers, customers."""
    def of(name: str, key: str, label: str, kind: str) -> DataFrame:
        return read(spark, d, name, key, label).select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(label).alias("canonical_name"))

    return (
        of("region", "r_regionkey", "r_name", "region").unionByName(of("nation", "n_nationkey", "n_name", "nation"))
        .unionByName(of("supplier", "s_suppkey", "s_name", "supplier")).unionByName(of("customer", "c_custkey", "c_name", "customer"))
    )


ENTITIES = """v_entities AS (
  SELECT 'r' || r_regionkey AS entity_id, 'region' AS entity_type, r_name AS canonical_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer)"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations between entities, each with a confidence and one chunk of evidence."""
    def of(name: str, key: str, to: str, a: str, b: str, kind: str) -> DataFrame:
        k = F.col(key).cast("long")
        return read(spark, d, name, key, to).select(
            F.concat(F.lit(a), F.col(key).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(to).cast("string")).alias("target_id"), F.lit(kind).alias("relation_type"),
            ((k * 7 % 100) / 100.0).alias("confidence"), F.concat((k * 13 % 200).cast("string"), F.lit("-0")).alias("chunk_id"),
        )

    return (
        of("nation", "n_nationkey", "n_regionkey", "n", "r", "part_of").unionByName(of("supplier", "s_suppkey", "s_nationkey", "s", "n", "located_in"))
        .unionByName(of("customer", "c_custkey", "c_nationkey", "c", "n", "belongs_to"))
    )


RELATIONS = """v_relations AS (
  SELECT a || k AS source_id, b || t AS target_id, relation_type, (k * 7 % 100) / 100.0 AS confidence, (k * 13 % 200) || '-0' AS chunk_id
  FROM (SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS t, 'n' AS a, 'r' AS b, 'part_of' AS relation_type FROM nation
    UNION ALL SELECT s_suppkey, s_nationkey, 's', 'n', 'located_in' FROM supplier
    UNION ALL SELECT c_custkey, c_nationkey, 'c', 'n', 'belongs_to' FROM customer))"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, entity_id): first chunks mention a nation and a region."""
    doc = F.col("asset_id")
    named = F.array_compact(F.array(F.concat(F.lit("n"), (doc % 25).cast("string")), F.when(doc % 3 == 0, F.concat(F.lit("s"), (doc % 10 + 1).cast("string")))))
    return chunks(spark, d).filter("chunk_seq = 0").select("chunk_id", F.explode(named).alias("entity_id"))


MENTIONS = """v_mentions AS (
  SELECT chunk_id, 'n' || (asset_id % 25) AS entity_id FROM v_chunks WHERE chunk_seq = 0
  UNION ALL SELECT chunk_id, 's' || (asset_id % 10 + 1) FROM v_chunks WHERE chunk_seq = 0 AND asset_id % 3 = 0)"""

#: Expressions by name; a view follows those that it needs.
_ALL = {"assets": ASSETS, "versions": VERSIONS, "chunks": CHUNKS, "jobs": JOBS, "log_lines": LOG_LINES, "frames": FRAMES, "symbols": SYMBOLS, "entities": ENTITIES, "relations": RELATIONS, "mentions": MENTIONS}


def with_views(sql: str, *names: str) -> str:
    """SQL behind a WITH clause of the named views."""
    return "WITH " + ",\n".join(_ALL[n] for n in names) + "\n" + sql
