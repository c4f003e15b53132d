"""The sixteen tables: their columns, keys and checks, and what rows break them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """Columns as DDL (what must not be null is marked), unique keys (the first is the primary one), checks by name, and foreign keys (columns, table, columns)."""

    columns: str
    keys: tuple[tuple[str, ...], ...]
    checks: dict[str, str] = field(default_factory=dict)
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    #: A key that holds among the rows that a condition names: (columns, condition).
    partial: tuple[tuple[tuple[str, ...], str], ...] = ()


def _one(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_ASSET, _VERSION, _CHUNK = (("asset_id",), "assets", ("asset_id",)), (("version_id",), "asset_versions", ("version_id",)), (("chunk_id",), "chunks", ("chunk_id",))
_PERSON = "employee_name STRING, department STRING, upper_department STRING"

#: Columns, keys and allowed values of the data model.
TABLES = {
    "assets": Table(
        "asset_id STRING NOT NULL, asset_type STRING NOT NULL, subtype STRING NOT NULL, title STRING NOT NULL, vendor STRING, product STRING, system_name STRING, service_name STRING, component STRING, owner_org STRING, "
        "security_level STRING NOT NULL, metadata STRING NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL, deleted_at TIMESTAMP",
        (("asset_id",),), {"asset_type": _one("asset_type", "document", "incident", "error_trace", "source_code")},
    ),
    "asset_versions": Table(
        "version_id STRING NOT NULL, asset_id STRING NOT NULL, version_label STRING NOT NULL, source_filename STRING NOT NULL, source_path STRING NOT NULL, sha256 STRING NOT NULL, repository STRING, branch STRING, logical_path STRING, "
        "lifecycle_status STRING NOT NULL, is_current BOOLEAN NOT NULL, effective_from DATE, effective_to DATE, parser_name STRING, parser_version STRING, metadata STRING NOT NULL, created_at TIMESTAMP NOT NULL, indexed_at TIMESTAMP",
        (("version_id",), ("asset_id", "sha256")), {"lifecycle_status": _one("lifecycle_status", "draft", "approved", "obsolete")}, (_ASSET,), ((("asset_id",), "is_current"),),
    ),
    "ingestion_jobs": Table(
        "job_id STRING NOT NULL, version_id STRING NOT NULL, status STRING NOT NULL, priority INT NOT NULL, attempts INT NOT NULL, max_attempts INT NOT NULL, worker_id STRING, locked_at TIMESTAMP, heartbeat_at TIMESTAMP, error_detail STRING, "
        "chunk_count INT NOT NULL, report STRING NOT NULL, created_at TIMESTAMP NOT NULL, started_at TIMESTAMP, completed_at TIMESTAMP, updated_at TIMESTAMP NOT NULL",
        (("job_id",), ("version_id",)), {"status": _one("status", "queued", "processing", "completed", "failed", "cancelled")}, (_VERSION,),
    ),
    "auth_sessions": Table(
        f"session_id STRING NOT NULL, token_hash STRING NOT NULL, employee_id STRING NOT NULL, user_id STRING, {_PERSON}, email STRING, roles ARRAY<STRING> NOT NULL, expires_at TIMESTAMP NOT NULL, client_ip STRING, user_agent STRING, "
        "created_at TIMESTAMP NOT NULL, last_seen_at TIMESTAMP, revoked_at TIMESTAMP",
        (("session_id",), ("token_hash",)),
    ),
    "user_access_roles": Table(
        f"employee_id STRING NOT NULL, {_PERSON}, role STRING NOT NULL, updated_by STRING NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
        (("employee_id",),), {"role": _one("role", "viewer", "uploader", "admin")},
    ),
    "chunks": Table(
        "chunk_id STRING NOT NULL, asset_id STRING NOT NULL, version_id STRING NOT NULL, chunk_seq INT NOT NULL, kind STRING NOT NULL, display_content STRING NOT NULL, embedding_content STRING NOT NULL, parent_id STRING, previous_chunk_id STRING, "
        "next_chunk_id STRING, page_start INT, page_end INT, line_start INT, line_end INT, identifier STRING, heading_path STRING, metadata STRING NOT NULL, embedding_model STRING, embedding ARRAY<FLOAT> NOT NULL, created_at TIMESTAMP NOT NULL",
        (("chunk_id",), ("version_id", "chunk_seq")), {}, (_ASSET, _VERSION),
    ),
    "error_events": Table(
        "error_event_id STRING NOT NULL, asset_id STRING NOT NULL, version_id STRING NOT NULL, chunk_id STRING, occurred_at TIMESTAMP, error_code STRING, exception_class STRING, severity STRING, message STRING, root_cause STRING, raw_trace STRING NOT NULL, "
        "fingerprint STRING NOT NULL, system_name STRING",
        (("error_event_id",),), {}, (_ASSET, _VERSION, _CHUNK),
    ),
    "stack_frames": Table(
        "error_event_id STRING NOT NULL, frame_seq INT NOT NULL, class_name STRING, method_name STRING, file_name STRING, line_number INT, is_application_code BOOLEAN",
        (("error_event_id", "frame_seq"),), {}, ((("error_event_id",), "error_events", ("error_event_id",)),),
    ),
    "code_symbols": Table(
        "symbol_id STRING NOT NULL, asset_id STRING NOT NULL, version_id STRING NOT NULL, chunk_id STRING NOT NULL, repository STRING, branch STRING, file_path STRING NOT NULL, language STRING NOT NULL, symbol_type STRING NOT NULL, package_name STRING, "
        "class_name STRING, symbol_name STRING NOT NULL, signature STRING, start_line INT NOT NULL, end_line INT NOT NULL",
        (("symbol_id",),), {}, (_ASSET, _VERSION, _CHUNK),
    ),
    "asset_relations": Table(
        "source_asset_id STRING NOT NULL, target_asset_id STRING NOT NULL, relation_type STRING NOT NULL, evidence STRING, created_at TIMESTAMP NOT NULL",
        (("source_asset_id", "target_asset_id", "relation_type"),), {"no_loop": "source_asset_id <> target_asset_id"}, ((("source_asset_id",), "assets", ("asset_id",)), (("target_asset_id",), "assets", ("asset_id",))),
    ),
    "upload_audit": Table(
        "audit_id STRING NOT NULL, asset_id STRING, version_id STRING, job_id STRING, action STRING NOT NULL, employee_id STRING, employee_name STRING, department STRING, client_ip STRING, user_agent STRING, created_at TIMESTAMP NOT NULL",
        (("audit_id",),), {"action": _one("action", "new_asset", "new_version")}, (_ASSET, _VERSION),
    ),
    "response_templates": Table(
        "template_key STRING NOT NULL, content STRING NOT NULL, updated_by STRING, updated_at TIMESTAMP NOT NULL",
        (("template_key",),), {"key_length": "length(template_key) <= 100", "content_length": "length(content) BETWEEN 1 AND 4000"},
    ),
    "knowledge_entities": Table(
        "entity_id STRING NOT NULL, entity_type STRING NOT NULL, canonical_name STRING NOT NULL, normalized_name STRING NOT NULL, description STRING NOT NULL, properties STRING NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
        (("entity_id",), ("entity_type", "normalized_name")),
    ),
    "chunk_entities": Table(
        "chunk_id STRING NOT NULL, entity_id STRING NOT NULL, mention_text STRING, relevance FLOAT NOT NULL, created_at TIMESTAMP NOT NULL",
        (("chunk_id", "entity_id"),), {"relevance": "relevance BETWEEN 0 AND 1"}, (_CHUNK, (("entity_id",), "knowledge_entities", ("entity_id",))),
    ),
    "knowledge_relations": Table(
        "relation_id STRING NOT NULL, source_entity_id STRING NOT NULL, target_entity_id STRING NOT NULL, relation_type STRING NOT NULL, description STRING NOT NULL, confidence FLOAT NOT NULL, properties STRING NOT NULL, created_at TIMESTAMP NOT NULL, "
        "updated_at TIMESTAMP NOT NULL",
        (("relation_id",), ("source_entity_id", "target_entity_id", "relation_type")), {"confidence": "confidence BETWEEN 0 AND 1", "no_loop": "source_entity_id <> target_entity_id"},
        ((("source_entity_id",), "knowledge_entities", ("entity_id",)), (("target_entity_id",), "knowledge_entities", ("entity_id",))),
    ),
    "relation_evidence": Table(
        "relation_id STRING NOT NULL, chunk_id STRING NOT NULL, evidence_text STRING, created_at TIMESTAMP NOT NULL",
        (("relation_id", "chunk_id"),), {}, ((("relation_id",), "knowledge_relations", ("relation_id",)), _CHUNK),
    ),
}


def required(table: Table) -> list[str]:
    return [c.split()[0] for c in table.columns.split(", ") if c.endswith(" NOT NULL")]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder with its declared columns; no file is opened to learn them."""
    return spark.read.schema(TABLES[name].columns.replace(" NOT NULL", "")).parquet(f"{folder}/{name}.parquet")


def violations(frames: dict[str, DataFrame], tables: dict[str, Table] | None = None) -> DataFrame:
    """(table, rule, n): for each rule of the tables at hand the rows that break it; a key is broken by every row beyond its first.

    Null keys and foreign keys with a null are no violation, as in SQL. A rule whose columns or
    whose other table a frame lacks is left out. Nulls and checks of a table share one pass.
    """
    found = []
    for name, table in (tables or TABLES).items():
        if name not in frames:
            continue
        rows = frames[name]
        have = set(rows.columns)
        simple = {f"not null {c}": F.col(c).isNull() for c in required(table) if c in have}
        simple |= {f"check {k}": ~F.expr(v) for k, v in table.checks.items() if have >= _named(rows, v)}
        if simple:
            counted = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(k) for k, bad in simple.items()])
            pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in simple])).alias("p")
            found.append(counted.select(F.lit(name).alias("table"), pairs).select("table", "p.*"))
        for key, where in [*((k, None) for k in table.keys), *table.partial]:
            if have >= set(key) and (where is None or have >= _named(rows, where)):
                said = f"unique {','.join(key)}" + (f" where {where}" if where else "")
                held = rows.filter(where) if where else rows
                groups = held.select(*key).dropna().groupBy(*key).count()
                found.append(groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("table"), F.lit(said).alias("rule"), "n"))
        for columns, other, theirs in table.references:
            if other in frames and have >= set(columns) and set(frames[other].columns) >= set(theirs):
                targets = frames[other].select(*[F.col(t).alias(c) for c, t in zip(columns, theirs)])
                alone = rows.select(*columns).dropna().join(targets, list(columns), "left_anti").agg(F.count(F.lit(1)).alias("n"))
                found.append(alone.select(F.lit(name).alias("table"), F.lit(f"reference {','.join(columns)} to {other}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found)


def _named(rows: DataFrame, condition: str) -> set[str]:
    """Columns of any table that a condition names."""
    words = set(condition.replace("(", " ").replace(")", " ").split())
    return words & {c.split()[0] for t in TABLES.values() for c in t.columns.split(", ")}
