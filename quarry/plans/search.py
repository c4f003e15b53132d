"""Search: filters, lanes, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval as R
from ..sources import views as V
from ..sources.tables import read
from .registry import query

_SHOWN = """shown AS (
  SELECT c.*, a.created_at FROM v_chunks c JOIN v_versions v USING (version_id) JOIN v_assets a ON a.asset_id = c.asset_id
  WHERE a.deleted_at IS NULL AND v.is_current AND v.lifecycle_status = 'approved')"""
_BASE = "assets versions chunks"
_IDENTIFIER = """idl AS (
  SELECT {lane}::BIGINT AS lane_id, row_number() OVER (ORDER BY created_at DESC, chunk_id) AS rank, chunk_id
  FROM (SELECT * FROM shown WHERE identifier = 'DOC0012' OR contains(lower(display_content), 'doc0012') ORDER BY created_at DESC, chunk_id LIMIT 30))"""
_DISTANCES = """dist AS (
  SELECT vec_id, round(1 - list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
    / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS distance
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)),
near AS (SELECT chunk_id, distance FROM shown JOIN dist USING (vec_id) ORDER BY distance, chunk_id LIMIT 40),
vel AS (SELECT {lane}::BIGINT AS lane_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank, chunk_id FROM near WHERE distance <= 0.55)"""
_LEXICAL = """lex AS (
  SELECT {lane}::BIGINT AS lane_id, row_number() OVER (ORDER BY n DESC, chunk_id) AS rank, chunk_id FROM (
    SELECT chunk_id, (len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'of')))::BIGINT AS n
    FROM (SELECT chunk_id, regexp_split_to_array(lower(identifier || ' ' || display_content), '[^\\p{{L}}\\p{{N}}]+') AS w FROM shown)
    WHERE list_contains(w, 'the') AND list_contains(w, 'of') ORDER BY n DESC, chunk_id LIMIT 40))"""


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return R.searchable(V.chunks(spark, d), V.versions(spark, d), V.assets(spark, d))


@query("SELECT asset_id, asset_type, vendor, product, system_name FROM v_assets WHERE deleted_at IS NULL AND asset_type = 'incident'", "assets")
def filter_active_assets(spark: SparkSession, d: str) -> DataFrame:
    return V.assets(spark, d).filter(F.col("deleted_at").isNull() & (F.col("asset_type") == "incident")).select("asset_id", "asset_type", "vendor", "product", "system_name")


@query(
    """SELECT v.version_id, v.asset_id, lifecycle_status, is_current FROM v_versions v JOIN v_assets a USING (asset_id)
    WHERE a.deleted_at IS NULL AND product = 'en'""", "assets versions")
def filter_include_obsolete(spark: SparkSession, d: str) -> DataFrame:
    kept = V.assets(spark, d).filter(F.col("deleted_at").isNull() & (F.col("product") == "en")).select("asset_id")
    return V.versions(spark, d).join(kept, "asset_id", "left_semi").select("version_id", "asset_id", "lifecycle_status", "is_current")


@query("SELECT asset_id, title FROM v_assets WHERE title ILIKE '%th_t%'", "assets")
def search_titles_ilike(spark: SparkSession, d: str) -> DataFrame:
    return V.assets(spark, d).filter(F.col("title").ilike("%th_t%")).select("asset_id", "title")


@query("SELECT chunk_id FROM v_chunks WHERE contains(lower(display_content), '100%') OR contains(lower(display_content), 'a_b') OR contains(lower(display_content), '###')", "chunks")
def literal_substring_escape(spark: SparkSession, d: str) -> DataFrame:
    line = F.lower("display_content")
    return V.chunks(spark, d).filter(F.contains(line, F.lit("100%")) | F.contains(line, F.lit("a_b")) | F.contains(line, F.lit("###"))).select("chunk_id")


@query(f", {_SHOWN}, {_IDENTIFIER.format(lane=1)} SELECT * FROM idl", _BASE)
def exact_lane_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.identifier_lane(_shown(spark, d), "DOC0012", 1)


@query(f", {_SHOWN}, {_DISTANCES.format(lane=1)} SELECT chunk_id, distance FROM near", _BASE)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vecs = read(spark, d, "embeddings", "vec_id", "embedding")
    return R.vector_hits(_shown(spark, d), vecs, R.first_vector(vecs))


@query(f", {_SHOWN}, {_DISTANCES.format(lane=1)} SELECT * FROM vel", _BASE)
def vector_threshold_after_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_lane(vector_topk(spark, d), 1)


@query(f", {_SHOWN}, {_LEXICAL.format(lane=1)} SELECT * FROM lex", _BASE)
def lexical_and_match(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.lexical_hits(_shown(spark, d), ["the", "of"]), R.LEXICAL_K, 1, F.col("n").desc(), F.col("chunk_id").asc())


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIMILARITY = f"""sim AS (
  SELECT *, len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0) AS score
  FROM (SELECT *, {_GRAMS.format(x="canonical_name")} AS x, {_GRAMS.format(x="'supplier 000000003 in nation_5'")} AS y FROM v_entities))"""


@query(f", {_SIMILARITY} SELECT entity_id, round(coalesce(score, 0), 9) AS score FROM sim", "entities")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    score = text.similarity(F.col("canonical_name"), F.lit("supplier 000000003 in nation_5"))
    return V.entities(spark, d).select("entity_id", F.round(score, 9).alias("score"))


_ENTITY = """ent AS (
  SELECT {lane}::BIGINT AS lane_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id FROM (
    SELECT chunk_id, round(max(coalesce(score, 0)), 9) AS score FROM sim JOIN v_mentions USING (entity_id) JOIN shown USING (chunk_id)
    WHERE coalesce(score, 0) >= 0.35 OR contains('supplier000000003innation_5', lower(replace(canonical_name, ' ', '')))
    GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 40))"""


@query(f", {_SHOWN}, {_SIMILARITY}, {_ENTITY.format(lane=1)} SELECT * FROM ent", f"{_BASE} entities mentions")
def graph_entity_lane(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_lane(V.entities(spark, d), V.mentions(spark, d), _shown(spark, d), "supplier 000000003 in nation_5", 1)


def _lanes(spark: SparkSession, d: str, chunks: DataFrame, first: int = 0) -> list[DataFrame]:
    vecs = read(spark, d, "embeddings", "vec_id", "embedding")
    return [
        R.identifier_lane(chunks, "DOC0012", first + 1),
        R.ranked(R.lexical_hits(chunks, ["the", "of"]), R.LEXICAL_K, first + 2, F.col("n").desc(), F.col("chunk_id").asc()),
        R.vector_lane(R.vector_hits(chunks, vecs, R.first_vector(vecs)), first + 3),
    ]


_THREE = f"{_IDENTIFIER.format(lane=1)}, {_LEXICAL.format(lane=2)}, {_DISTANCES.format(lane=3)}"
_FUSED = """every AS (SELECT * FROM idl UNION ALL SELECT * FROM lex UNION ALL SELECT * FROM vel),
fused AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, min(lane_id * 1000000 + rank) AS first FROM every GROUP BY chunk_id ORDER BY rrf_score DESC, first LIMIT 30)"""


@query(f", {_SHOWN}, {_THREE}, {_FUSED} SELECT chunk_id, rrf_score::DOUBLE AS rrf_score FROM fused", _BASE)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lanes(spark, d, _shown(spark, d))).select("chunk_id", "rrf_score")


_AROUND = """around AS (SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM v_chunks WINDOW w AS (PARTITION BY version_id ORDER BY chunk_seq))"""


@query(
    f""", {_SHOWN}, {_THREE}, {_FUSED}, {_AROUND}
    SELECT chunk_id, rrf_score::DOUBLE AS rrf_score, row_number() OVER (ORDER BY rrf_score DESC, first) AS position, c.asset_id, c.display_content, previous_chunk_id, next_chunk_id
    FROM (SELECT * FROM fused ORDER BY rrf_score DESC, first LIMIT 10) JOIN around USING (chunk_id) JOIN v_chunks c USING (chunk_id)""", _BASE)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, lexical and vector lanes, fused; the first ten with their neighbours."""
    order = Window.orderBy(F.col("rrf_score").desc(), F.col("first"))
    top = R.fuse(_lanes(spark, d, _shown(spark, d))).orderBy(F.col("rrf_score").desc(), F.col("first")).limit(10).withColumn("position", F.row_number().over(order).cast("long"))
    # ten rows, made once: neighbours and texts come with the chunks, which know what stands next to them
    wide = V.chunks(spark, d, linked=True).join(F.broadcast(top), "chunk_id")
    return wide.select("chunk_id", "rrf_score", "position", "asset_id", "display_content", "previous_chunk_id", "next_chunk_id")


@query(
    f""", {_SHOWN}, {_AROUND} SELECT chunk_id, previous_chunk_id, next_chunk_id FROM around""", _BASE)
def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = Window.partitionBy("version_id").orderBy("chunk_seq")
    return V.chunks(spark, d).select("chunk_id", F.lag("chunk_id").over(near).alias("previous_chunk_id"), F.lead("chunk_id").over(near).alias("next_chunk_id"))


@query(
    f""", {_SHOWN}, own AS (SELECT * FROM shown WHERE asset_id IN (1, 2, 12)),
    p1 AS (SELECT 1::BIGINT AS lane_id, row_number() OVER (ORDER BY created_at DESC, chunk_id) AS rank, chunk_id FROM (SELECT * FROM own WHERE identifier = 'DOC0012' OR contains(lower(display_content), 'doc0012') ORDER BY created_at DESC, chunk_id LIMIT 30)),
    {_IDENTIFIER.format(lane=11)}
    SELECT lane_id, rank, chunk_id FROM p1 UNION ALL SELECT lane_id, rank, chunk_id FROM idl""", _BASE)
def lane_union(spark: SparkSession, d: str) -> DataFrame:
    """Lanes of preferred assets stand before those of all."""
    shown = _shown(spark, d)
    own = shown.filter(F.col("asset_id").isin(1, 2, 12))
    return R.identifier_lane(own, "DOC0012", 1).unionByName(R.identifier_lane(shown, "DOC0012", 11))


@query(
    f""", {_SHOWN} SELECT chunk_id, list_filter(regexp_extract_all(display_content, '[\\p{{L}}\\p{{N}}_.$/-]{{3,}}'), lambda t: regexp_matches(t, '[0-9.]') OR regexp_matches(t, '^[A-Z]'))[1:8] AS tokens FROM v_chunks""", _BASE)
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("chunk_id", text.identifiers(F.col("display_content")).alias("tokens"))


@query("SELECT entity_id, substr(lower(regexp_replace(canonical_name, '\\s+', '', 'g')), 1, 300) AS normalized_name FROM v_entities", "entities")
def entity_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return V.entities(spark, d).select("entity_id", text.normal_name(F.col("canonical_name")).alias("normalized_name"))
