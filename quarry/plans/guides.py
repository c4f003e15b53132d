"""Answers and guides to many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import guidance as G
from ..operators import logs as L
from ..sources import views as V
from ..sources.store import written
from . import search
from .registry import query

#: Characters of a context; the stand-in for a model refuses contexts that fill it.
_MOST = 3000
_TEMPLATE = "## Cause\n\n## Action"


def _model(prompts: DataFrame) -> DataFrame:
    """Stands in for a model: quotes the context's beginning, and is not available for contexts that were cut."""
    return prompts.select("request_id", F.when(F.length("context") < _MOST, F.concat(F.lit("Found: "), F.substring("context", 1, 300))).alias("answer"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """For each entity the ten youngest chunks that mention it."""
    chunks = search._shown(spark, d).join(V.mentions(spark, d), "chunk_id")
    first = Window.partitionBy("entity_id").orderBy(F.col("created_at").desc(), "chunk_id")
    top = chunks.withColumn("position", F.row_number().over(first).cast("long")).filter("position <= 10")
    shown = top.join(V.assets(spark, d).select("asset_id", "title", "asset_type"), "asset_id").join(V.versions(spark, d).select("version_id", "source_filename", "version_no"), "version_id")
    return shown.select(
        F.col("entity_id").alias("request_id"), "position", "chunk_id", "title", "source_filename", F.col("version_no").cast("string").alias("version_label"), F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), F.col("display_content").alias("content"), F.when((F.col("asset_type") == "source_code") & (F.col("version_no") == 2), "decompiled_code").otherwise("text").alias("kind"),
        F.lit(None).cast("string").alias("metadata"),
    )


_LABELS = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.LABELS.items()) + " ELSE relation_type END"


@query(f""", {search._SHOWN}, res AS (SELECT * FROM (
    SELECT m.entity_id AS request_id, row_number() OVER (PARTITION BY m.entity_id ORDER BY s.created_at DESC, s.chunk_id) AS position, s.chunk_id, s.version_id, a.title, v.source_filename, v.version_no, s.display_content AS content,
      a.asset_type = 'source_code' AND v.version_no = 2 AS decompiled
    FROM shown s JOIN v_mentions m USING (chunk_id) JOIN v_assets a ON a.asset_id = s.asset_id JOIN v_versions v ON v.version_id = s.version_id) WHERE position <= 10),
  hit AS (SELECT DISTINCT request_id, version_id FROM res),
  seed AS (SELECT DISTINCT request_id, entity_id FROM hit JOIN v_chunks USING (version_id) JOIN v_mentions USING (chunk_id)),
  known AS (SELECT request_id, source_id, target_id, relation_type, max(confidence) AS confidence FROM hit JOIN v_chunks USING (version_id) JOIN v_relations USING (chunk_id) GROUP BY ALL),
  hop AS (SELECT * FROM seed UNION SELECT k.request_id, target_id FROM known k JOIN seed s ON s.request_id = k.request_id AND s.entity_id = source_id
    UNION SELECT k.request_id, source_id FROM known k JOIN seed s ON s.request_id = k.request_id AND s.entity_id = target_id),
  top AS (SELECT * FROM (SELECT h.request_id, e.*, row_number() OVER (PARTITION BY h.request_id ORDER BY (s.entity_id IS NOT NULL) DESC, canonical_name, e.entity_id) AS n
    FROM hop h JOIN v_entities e USING (entity_id) LEFT JOIN seed s ON s.request_id = h.request_id AND s.entity_id = h.entity_id) WHERE n <= 30),
  edges AS (SELECT * FROM (SELECT k.*, a.canonical_name AS s, b.canonical_name AS t, row_number() OVER (PARTITION BY k.request_id ORDER BY confidence DESC, source_id, target_id, relation_type) AS n
    FROM known k JOIN top a ON a.request_id = k.request_id AND a.entity_id = source_id JOIN top b ON b.request_id = k.request_id AND b.entity_id = target_id) WHERE n <= 50),
  rel AS (SELECT request_id, '{G.RELATIONS_HEAD}' || chr(10) || string_agg('- ' || s || ' → ' || t || ' (' || {_LABELS} || ')', chr(10) ORDER BY n) AS said,
    CASE WHEN count(*) FILTER (source_id <> target_id) = 0 THEN NULL WHEN bool_and(relation_type = 'precedes') THEN 'flow' ELSE 'architecture' END AS diagram FROM edges WHERE s <> '' AND t <> '' GROUP BY request_id),
  blocks AS (SELECT request_id, position, '[' || position || '] 제목: ' || coalesce(nullif(title, ''), '{G.NO_TITLE}') || chr(10) || '파일: ' || source_filename || ' / 버전: ' || version_no || ' / {G.NO_PAGE}' || chr(10) || '본문:' || chr(10)
      || regexp_replace(content || CASE WHEN position = 1 AND said IS NOT NULL THEN chr(10) || said ELSE '' END, '^\\s+|\\s+$', '', 'g') AS b FROM res LEFT JOIN rel USING (request_id)),
  placed AS (SELECT *, coalesce(sum(length(b)) OVER (PARTITION BY request_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM blocks),
  ctx AS (SELECT request_id, string_agg(substr(b, 1, ({_MOST} - start)::INT), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS c FROM placed WHERE start < {_MOST} GROUP BY request_id),
  seen AS (SELECT request_id, count(*) AS n_results, bool_or(decompiled) AS used FROM res GROUP BY request_id),
  every AS (SELECT e.entity_id AS request_id, coalesce(n_results, 0) AS n_results, coalesce(used, false) AS used, diagram, CASE WHEN length(c) < {_MOST} THEN 'Found: ' || substr(c, 1, 300) END AS said,
    FROM v_entities e LEFT JOIN seen ON seen.request_id = e.entity_id LEFT JOIN ctx ON ctx.request_id = e.entity_id LEFT JOIN rel ON rel.request_id = e.entity_id),
  judged AS (SELECT *, said IS NOT NULL AND NOT regexp_matches(lower(regexp_replace(said, '\\s+', ' ', 'g')), '{"|".join(text.INSUFFICIENT)}') AS enough FROM every)
  SELECT request_id, CASE WHEN n_results = 0 THEN '{G.OUT_OF_SCOPE}' ELSE coalesce(said, '{G.UNAVAILABLE}') || CASE WHEN used THEN chr(10) || chr(10) || '{G.DECOMPILED}' ELSE '' END END AS answer,
    CASE WHEN n_results = 0 THEN 'out_of_scope' WHEN said IS NULL THEN 'unavailable' ELSE 'completed' END AS generation_status, CASE WHEN enough THEN 'sufficient' ELSE 'insufficient' END AS evidence_status,
    CASE WHEN used THEN ['{G.DECOMPILED}'] ELSE [] END AS notices, n_results, CASE WHEN enough THEN diagram END AS diagram FROM judged""", "assets versions chunks entities relations mentions")
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question about each entity: evidence, graph, context, answer, statuses and notices."""
    entities, results = V.entities(spark, d), written(_results(spark, d), "results")
    graph = G.subgraphs(results, V.chunks(spark, d), entities, V.relations(spark, d), V.mentions(spark, d))
    return G.answered(entities.select(F.col("entity_id").alias("request_id"), F.col("canonical_name").alias("query")), results, graph, _model, _MOST)


def _writer(prompts: DataFrame) -> DataFrame:
    """Stands in for a model: writes the context's size under the template's headings, but leaves one out unless it is told so."""
    told = F.contains("query", F.lit(G.MISSING_HEADINGS))
    size = F.length("context").cast("string")
    return prompts.select("request_id", F.when(told & (F.col("request_id") % 2 == 0), F.concat(F.lit("## Cause\n"), size, F.lit("\n\n## Action\nnone"))).otherwise(F.concat(F.lit("## Cause\n"), size)).alias("answer"))


_LEVELS = f"(SELECT log_id, map_from_entries(list((x, n) ORDER BY x)) AS levels FROM (SELECT log_id, CASE WHEN x = 'WARNING' THEN 'WARN' ELSE x END AS x, count(*) AS n FROM (SELECT log_id, upper(unnest(regexp_extract_all(line, '{text.LEVEL}'))) AS x FROM v_log_lines) GROUP BY 1, 2) GROUP BY log_id)"


def _found(pattern: str) -> str:
    return f"""(SELECT log_id, list(x ORDER BY k) AS found FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY p) AS k FROM (
      SELECT log_id, x, min((line_no, i)) AS p FROM (SELECT log_id, line_no, xs[i] AS x, i FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT log_id, line_no, regexp_extract_all(line, '{pattern}') AS xs FROM v_log_lines))) GROUP BY log_id, x)) WHERE k <= 30 GROUP BY log_id)"""


@query(f"""SELECT o.log_id, total_lines, error_line_count, first_at, last_at, first_exception, last_cause, coalesce(c.found, []) AS error_codes, coalesce(e.found, []) AS exception_classes, to_json(l.levels)::VARCHAR AS levels FROM (
    SELECT log_id, count(*) AS total_lines, count(*) FILTER (regexp_matches(line, '{L.MARKER}')) AS error_line_count, arg_min(t, line_no) FILTER (t <> '') AS first_at, arg_max(t, line_no) FILTER (t <> '') AS last_at,
      arg_min(e, line_no) FILTER (e <> '') AS first_exception, arg_max(c, line_no) FILTER (c <> '') AS last_cause
    FROM (SELECT *, regexp_extract(line, '{text.TIMESTAMP}') AS t, regexp_extract(line, '{text.TRACE_EXCEPTION}') AS e, regexp_extract(line, '{text.CAUSE}', 1) AS c FROM v_log_lines) GROUP BY log_id) o
  LEFT JOIN {_found(text.TRACE_CODE)} c USING (log_id) LEFT JOIN {_found(text.TRACE_EXCEPTION)} e USING (log_id) LEFT JOIN {_LEVELS} l USING (log_id)""", "log_lines")
def log_analyses(spark: SparkSession, d: str) -> DataFrame:
    """What a guide tells of each log."""
    return G.log_analysis(V.log_lines(spark, d)).withColumn("levels", F.to_json("levels"))


@query()
def incident_guides(spark: SparkSession, d: str) -> DataFrame:
    """A guide for each log and each asset: its log first, then its chunks, ten at most; half of the answers need a second attempt, the others the template."""
    lines = V.log_lines(spark, d)
    chunks = search._shown(spark, d).filter("chunk_seq < 10")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    results = chunks.select(
        F.col("asset_id").alias("request_id"), (F.col("chunk_seq") + 1).alias("position"), "chunk_id", none("title", "string"), none("source_filename", "string"), none("version_label", "string"),
        none("page_start", "int"), none("page_end", "int"), F.col("display_content").alias("content"), F.lit("text").alias("kind"), none("metadata", "string"),
    )
    asked = lines.select(F.col("log_id").alias("request_id")).unionByName(V.assets(spark, d).select(F.col("asset_id").alias("request_id"))).distinct()
    told = L.search_query(lines, "causes?").withColumnRenamed("log_id", "request_id")
    requests = asked.join(told, "request_id", "left").select("request_id", F.coalesce("query", F.lit("causes?")).alias("query"))
    return G.guided(requests, lines, results, _writer, _TEMPLATE).withColumn("levels", F.to_json("levels"))
