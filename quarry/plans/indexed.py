"""Searches through indexes: vectors in lists, words in postings, names in trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import indexes as I
from ..operators import retrieval as R
from ..sources import views as V
from ..sources.tables import read
from . import search
from .registry import query

_BASE, _SHOWN = search._BASE, search._SHOWN


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each chunk that searches see, under the chunk's id."""
    vecs = read(spark, d, "embeddings", "vec_id", "embedding")
    return search._shown(spark, d).select("chunk_id", "vec_id").join(vecs, "vec_id").select(F.col("chunk_id").alias("vec_id"), "embedding")


@query(f", {_SHOWN}, {search._DISTANCES.format(lane=1)} SELECT chunk_id, distance FROM near", _BASE)
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The forty nearest chunks by inverted lists; lists that can't hold a nearer one are not read."""
    at = R.first_vector(read(spark, d, "embeddings", "vec_id", "embedding"))
    return I.exact_nearest_vectors(I.build_vectors(_vectors(spark, d)), at, R.VECTOR_K).withColumnRenamed("vec_id", "chunk_id")


@query()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The forty nearest chunks of the four nearest of sixteen lists: nearly always those of ``vector_index_exact``."""
    at = R.first_vector(read(spark, d, "embeddings", "vec_id", "embedding"))
    return I.nearest_vectors(I.build_vectors(_vectors(spark, d)), at, R.VECTOR_K).withColumnRenamed("vec_id", "chunk_id")


_FIELDS = {"identifier": ("D", text.APART), "display_content": ("D", text.APART)}
_PLACES = """plc AS (
  SELECT chunk_id, i AS pos, w[i] AS term FROM (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT chunk_id, list_filter(regexp_split_to_array(lower(identifier || ' ' || display_content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM shown))
  WHERE w[i] IN ('the', 'of')),
cov AS (
  SELECT chunk_id, count(*) AS n, round(coalesce(sum(0.1::DOUBLE / (pos - before)) FILTER (term <> last), 0), 9) AS score FROM (
    SELECT *, lag(pos) OVER w AS before, lag(term) OVER w AS last FROM plc WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)) GROUP BY chunk_id HAVING count(DISTINCT term) = 2)"""
# of two words the covers are neighbouring places of different words, which have pos - before - 1 others between them


@query(f", {_SHOWN}, {_PLACES} SELECT chunk_id, n, score FROM cov ORDER BY score DESC, chunk_id LIMIT 40", _BASE)
def lexical_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with both words by cover density with weights, from postings with places alone."""
    index = I.postings(search._shown(spark, d), "chunk_id", _FIELDS)
    return I.covering(index, "chunk_id", ["the", "of"]).orderBy(F.col("score").desc(), "chunk_id").limit(R.LEXICAL_K)


_LIKE = f"""pairs AS (
  SELECT entity_id, n_nationkey::BIGINT AS nation_id, {search._GRAMS.format(x="canonical_name")} AS x, {search._GRAMS.format(x="n_name || ' nation 1'")} AS y FROM v_entities, nation),
scored AS (SELECT *, len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0) AS score FROM pairs)"""


@query(f", {_LIKE} SELECT nation_id, entity_id, round(score, 9) AS score FROM scored WHERE score >= 0.35", "entities")
def entity_names_alike(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a name like a nation's, for all nations at once: a join on trigrams."""
    asked = read(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("nation_id"), F.concat("n_name", F.lit(" nation 1")).alias("asked"))
    found = I.alike(I.trigram_postings(V.entities(spark, d), "entity_id", "canonical_name"), "entity_id", asked, "nation_id", "asked")
    return found.select("nation_id", "entity_id", F.round("score", 9).alias("score"))


_LANES = f"""{search._IDENTIFIER.format(lane=1)}, {_PLACES},
lex AS (SELECT 2::BIGINT AS lane_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id FROM (SELECT * FROM cov ORDER BY score DESC, chunk_id LIMIT 40)), {search._DISTANCES.format(lane=3)}"""


@query(
    f""", {_SHOWN}, {_LANES}, {search._FUSED}
    SELECT chunk_id, rrf_score::DOUBLE AS rrf_score, row_number() OVER (ORDER BY rrf_score DESC, first) AS position, c.asset_id, c.display_content
    FROM (SELECT * FROM fused ORDER BY rrf_score DESC, first LIMIT 10) JOIN v_chunks c USING (chunk_id)""", _BASE)
def hybrid_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, postings and inverted lists, fused; no lane but the first reads a text."""
    shown = search._shown(spark, d)
    dense = I.covering(I.postings(shown, "chunk_id", _FIELDS), "chunk_id", ["the", "of"])
    at = R.first_vector(read(spark, d, "embeddings", "vec_id", "embedding"))
    near = I.exact_nearest_vectors(I.build_vectors(_vectors(spark, d)), at, R.VECTOR_K).withColumnRenamed("vec_id", "chunk_id")
    lanes = [R.identifier_lane(shown, "DOC0012", 1), R.ranked(dense, R.LEXICAL_K, 2, F.col("score").desc(), F.col("chunk_id").asc()), R.vector_lane(near, 3)]
    order = Window.orderBy(F.col("rrf_score").desc(), F.col("first"))
    top = R.fuse(lanes).orderBy(F.col("rrf_score").desc(), F.col("first")).limit(10).withColumn("position", F.row_number().over(order).cast("long"))
    return V.chunks(spark, d).join(F.broadcast(top), "chunk_id").select("chunk_id", "rrf_score", "position", "asset_id", "display_content")
