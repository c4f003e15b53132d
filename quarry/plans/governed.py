"""Constraints of the tables, vectors of texts, roles, uploads and merged rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import embedding as E
from ..operators import state as S
from ..sources import schemas
from ..sources import views as V
from ..sources.tables import read
from .registry import query

#: Views by the table that they stand for: name, and columns that are named otherwise.
_STAND = {
    "assets": ("assets", {}), "asset_versions": ("versions", {}), "ingestion_jobs": ("jobs", {}), "chunks": ("chunks", {}), "code_symbols": ("symbols", {}),
    "knowledge_entities": ("entities", {"normalized_name": "lower(canonical_name)"}), "chunk_entities": ("mentions", {}),
    "knowledge_relations": ("relations", {"source_entity_id": "source_id", "target_entity_id": "target_id"}),
}
#: What of each table's rules the views can show: columns that must not be null, then unique keys, checks and references, as SQL.
_NULLS = {
    "assets": "asset_id asset_type title created_at", "asset_versions": "version_id asset_id source_filename sha256 lifecycle_status is_current created_at", "ingestion_jobs": "job_id status priority attempts max_attempts created_at",
    "chunks": "chunk_id asset_id version_id chunk_seq display_content", "code_symbols": "symbol_id symbol_name start_line end_line", "knowledge_entities": "entity_id entity_type canonical_name normalized_name", "chunk_entities": "chunk_id entity_id",
    "knowledge_relations": "source_entity_id target_entity_id relation_type confidence",
}
_CHECKS = [
    ("assets", "asset_type", "asset_type IN ('document', 'incident', 'error_trace', 'source_code')"), ("asset_versions", "lifecycle_status", "lifecycle_status IN ('draft', 'approved', 'obsolete')"),
    ("ingestion_jobs", "status", "status IN ('queued', 'processing', 'completed', 'failed', 'cancelled')"), ("knowledge_relations", "confidence", "confidence BETWEEN 0 AND 1"), ("knowledge_relations", "no_loop", "source_entity_id <> target_entity_id"),
]
_KEYS = [
    ("assets", "asset_id", ""), ("asset_versions", "version_id", ""), ("asset_versions", "asset_id,sha256", ""), ("asset_versions", "asset_id", "is_current"), ("ingestion_jobs", "job_id", ""), ("chunks", "chunk_id", ""), ("chunks", "version_id,chunk_seq", ""),
    ("code_symbols", "symbol_id", ""), ("knowledge_entities", "entity_id", ""), ("knowledge_entities", "entity_type,normalized_name", ""), ("chunk_entities", "chunk_id,entity_id", ""),
    ("knowledge_relations", "source_entity_id,target_entity_id,relation_type", ""),
]
_REFERENCES = [
    ("asset_versions", "asset_id", "assets", "asset_id"), ("chunks", "asset_id", "assets", "asset_id"), ("chunks", "version_id", "asset_versions", "version_id"), ("chunk_entities", "chunk_id", "chunks", "chunk_id"),
    ("chunk_entities", "entity_id", "knowledge_entities", "entity_id"), ("knowledge_relations", "source_entity_id", "knowledge_entities", "entity_id"), ("knowledge_relations", "target_entity_id", "knowledge_entities", "entity_id"),
]


def _rules() -> str:
    made = [f"SELECT '{t}' AS \"table\", 'not null {c}' AS rule, count(*) FILTER ({c} IS NULL) AS n FROM t_{t}" for t, cs in _NULLS.items() for c in cs.split()]
    made += [f"SELECT '{t}', 'check {k}', count(*) FILTER (NOT ({c})) FROM t_{t}" for t, k, c in _CHECKS]
    for t, k, where in _KEYS:
        held = " AND ".join([f"{c} IS NOT NULL" for c in k.split(",")] + [where] * bool(where))
        made.append(f"SELECT '{t}', 'unique {k}{' where ' + where if where else ''}', count(*) - count(DISTINCT ({k})) FROM t_{t} WHERE {held}")
    made += [f"SELECT '{t}', 'reference {c} to {o}', count(*) FROM t_{t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM t_{o})" for t, c, o, k in _REFERENCES]
    stand = ", ".join(f"t_{t} AS (SELECT *{''.join(f', {e} AS {c}' for c, e in more.items())} FROM v_{view})" for t, (view, more) in _STAND.items())
    return f", {stand} " + " UNION ALL ".join(made)


@query(_rules(), "assets versions jobs chunks symbols entities relations mentions")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break each declared rule, of all tables that there are."""
    frames = {t: getattr(V, view)(spark, d).withColumns({c: F.expr(e) for c, e in more.items()}) for t, (view, more) in _STAND.items()}
    return schemas.violations(frames)


_DIMENSION = 48


def _hash_vectors(texts: list[str]) -> list[list[float]]:
    """Stands in for a service: bytes of a text's hash, made unit length."""
    made = []
    for t in texts:
        raw = [b / 255 * 2 - 1 for b in hashlib.sha256(t.encode()).digest()]
        raw = [raw[i % len(raw)] for i in range(_DIMENSION)]
        length = sum(x * x for x in raw) ** 0.5
        made.append([x / length for x in raw])
    return made


@query(f"""SELECT chunk_id, list_transform(v, lambda x: round((x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE, 7)) AS embedding FROM (
  SELECT chunk_id, list_transform(range(0, {_DIMENSION}), lambda i: ('0x' || substr(h, (i % 32) * 2 + 1, 2))::INT / 255 * 2 - 1) AS v FROM (SELECT chunk_id, sha256(substr(display_content, 1, 8000)) AS h FROM v_chunks))""", "chunks")
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks by way of a service in batches, every coordinate, as they are stored (floats)."""
    made = E.embedded(V.chunks(spark, d), _hash_vectors, _DIMENSION, "chunk_id", "display_content", batch=64)
    return made.select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 7)).alias("embedding"))


@query("""SELECT conv_id, list_sort(list(DISTINCT coalesce(map_extract(MAP {'user': 'viewer', 'general': 'viewer', 'operator': 'uploader', 'thanos': 'admin'}, lower(role))[1], lower(role)))) AS roles,
  bool_or(lower(role) IN ('admin', 'thanos')) AS may_admin, bool_or(lower(role) IN ('admin', 'thanos', 'operator', 'uploader')) AS may_upload FROM conversations WHERE role IS NOT NULL GROUP BY conv_id""")
def roles_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the speakers of each conversation under their present names, and what they allow."""
    held = read(spark, d, "conversations", "conv_id", "role").filter("role is not null").groupBy("conv_id").agg(F.collect_set("role").alias("held"))
    r = F.col("held")
    return held.select("conv_id", F.array_sort(A.roles(r)).alias("roles"), A.may(r, "admin").alias("may_admin"), A.may(r, "admin", "uploader").alias("may_upload"))


@query("""SELECT version_id, CASE WHEN asset_type NOT IN ('document', 'incident') THEN 'extension' WHEN n > 10485760 THEN 'size' WHEN n = 0 THEN 'empty' END AS refusal
  FROM v_versions JOIN v_assets USING (asset_id) JOIN (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) ON doc_id = asset_id WHERE source_filename LIKE '%.md'""", "assets versions")
def upload_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Why each version would be refused as an upload: ending by kind of asset, state, repository, path, name, size."""
    rows = V.versions(spark, d).join(V.assets(spark, d).select("asset_id", "asset_type"), "asset_id")
    sizes = read(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("asset_id"), F.octet_length("text").cast("long").alias("n"))
    c = F.col
    return rows.join(sizes, "asset_id").select("version_id", A.upload_refusal(c("asset_type"), c("source_filename"), c("lifecycle_status"), c("repository"), c("logical_path"), c("n")).alias("refusal"))


@query("""SELECT relation_type, target_id AS key, arg_max(source_id, k) AS name, coalesce(arg_max(said, k) FILTER (said <> ''), '') AS description, max(confidence)::DOUBLE AS confidence,
    count(DISTINCT k % 5)::BIGINT AS n_fields, max(k) FILTER (k % 5 = 0)::VARCHAR AS field FROM (
    SELECT *, substr(source_id, 2)::BIGINT AS k, CASE WHEN confidence >= 0.5 THEN chunk_id ELSE '' END AS said FROM v_relations) GROUP BY relation_type, target_id""", "relations")
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    """What relations say of their targets, merged as if they came one by one: newest name, newest description that isn't empty, greatest confidence, fields of all."""
    n = F.substring("source_id", 2, 20).cast("long")
    new = V.relations(spark, d).select(
        "relation_type", F.col("target_id").alias("key"), F.col("source_id").alias("name"), F.when(F.col("confidence") >= 0.5, F.col("chunk_id")).otherwise("").alias("description"),
        F.col("confidence").cast("double").alias("confidence"), F.create_map(F.concat(F.lit("f"), (n % 5).cast("string")), n.cast("string")).alias("fields"), n.alias("seq"),
    )
    got = S.merge_rows(new.drop("seq").limit(0), new, ["relation_type", "key"], ["name"], ["description"], ["confidence"], "fields")
    return got.select("relation_type", "key", "name", "description", "confidence", F.size("fields").cast("long").alias("n_fields"), F.try_element_at("fields", F.lit("f0")).alias("field"))
