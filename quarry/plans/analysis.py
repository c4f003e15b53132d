"""Analysis of logs and traces, blocks under headings, linked context, diagrams and reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import graph as G
from ..operators import logs as L
from ..operators import normalize as N
from ..operators import retrieval as R
from ..operators import tables as T
from ..sources import views as V
from ..sources.store import written
from ..sources.tables import read
from . import content, search
from .registry import query

_BASE = search._BASE


@query("""SELECT log_id, count(*) FILTER (regexp_matches(line, '""" + L.MARKER + """')) AS error_line_count, arg_min(t, line_no) FILTER (t <> '') AS first_at, arg_max(t, line_no) FILTER (t <> '') AS last_at,
    arg_min(e, line_no) FILTER (e <> '') AS first_exception, arg_max(c, line_no) FILTER (c <> '') AS last_cause
  FROM (SELECT *, regexp_extract(line, '""" + text.TIMESTAMP + """') AS t, regexp_extract(line, '""" + text.TRACE_EXCEPTION + """') AS e, regexp_extract(line, '""" + text.CAUSE + """', 1) AS c FROM v_log_lines) GROUP BY log_id""", "log_lines")
def log_overview(spark: SparkSession, d: str) -> DataFrame:
    return L.overview(V.log_lines(spark, d))


def _seen(pattern: str, most: int) -> str:
    return f"""SELECT log_id, list(x ORDER BY k) AS found FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no, i) AS k FROM (
      SELECT log_id, x, min((line_no, i)) AS p, p[1] AS line_no, p[2] AS i FROM (SELECT log_id, line_no, xs[i] AS x, i FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT log_id, line_no, regexp_extract_all(line, '{pattern}') AS xs FROM v_log_lines))) GROUP BY log_id, x)) WHERE k <= {most} GROUP BY log_id"""


@query(_seen(text.TRACE_CODE, 30).replace("found", "error_codes", 1), "log_lines")
def log_codes(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty codes of each log, in the order in which they come."""
    return L.first_seen(V.log_lines(spark, d), text.TRACE_CODE, 30).withColumnRenamed("found", "error_codes")


_CHOSEN = """rows AS (SELECT *, sum(m::BIGINT) OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS i, count(*) FILTER (m) OVER (PARTITION BY log_id) AS n, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY log_id) AS total
    FROM (SELECT log_id, line_no, line, regexp_matches(line, '""" + L.MARKER + """') AS m FROM v_log_lines)),
  near AS (SELECT *, max((m AND (n <= 5 OR list_contains(list_transform(range(0, 5), lambda p: round_even(p * (n - 1) / 4, 0)::BIGINT), i)))::INT) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS w FROM rows),
  kept AS (SELECT * FROM near WHERE CASE WHEN n > 0 THEN w = 1 ELSE k <= 80 OR k > total - 20 END),
  cut AS (SELECT log_id, line_no, substr(line, 1, least(greatest(6000 // count(*) OVER (PARTITION BY log_id), 200), 2000)::INT) AS line FROM kept),
  used AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM cut)"""


@query(", " + _CHOSEN + " SELECT log_id, line_no, substr(line, 1, (6000 - u)::INT) AS line FROM used WHERE u < 6000", "log_lines")
def log_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """At most 6000 characters of each log around markers that are spread over all of it."""
    return L.excerpt(V.log_lines(spark, d), 6000)


@query("""SELECT log_id, segment, part, line_start, n_lines, text, nullif(regexp_extract(text, '""" + text.JAVA_CODE.replace("(?U)", "") + """'), '') AS error_code, nullif(regexp_extract(text, '\\b[\\w.]+(?:Exception|Error)\\b'), '') AS exception_class,
    nullif(regexp_extract(text, '\\b(ERROR|WARN|FATAL|INFO|DEBUG)\\b', 1), '') AS severity, nullif(regexp_extract(text, 'Caused by:\\s*[\\w.]+(?:Exception|Error)(?::\\s*[^\\n]+)?'), '') AS root_cause, substr(split_part(text, chr(10), 1), 1, 2000) AS message,
    sha256(substr(regexp_replace(regexp_replace(text, '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]\\S+', '', 'g'), ':[0-9]+\\)', ':LINE)', 'g'), 1, 4000)) AS fingerprint
  FROM (SELECT log_id, segment, part, min(line_no) AS line_start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (
    SELECT *, ((row_number() OVER (PARTITION BY log_id, segment ORDER BY line_no) - 1) // 250)::BIGINT AS part FROM (
      SELECT *, sum(regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]|^\\[?(?:ERROR|WARN|FATAL)\\b')::BIGINT) OVER (PARTITION BY log_id ORDER BY line_no)::BIGINT AS segment FROM v_log_lines)) GROUP BY log_id, segment, part)""", "log_lines")
def log_record_errors(spark: SparkSession, d: str) -> DataFrame:
    """Records of each log with code, exception, severity, cause, message and fingerprint."""
    return L.records(V.log_lines(spark, d))


@query("SELECT doc_id, len(regexp_extract_all(text, '" + text.JAVA_FRAME + "')) AS frame_count, len(e) > 0 AS has_exception, len(regexp_extract_all(text, '" + text.JAVA_FRAME + "')) >= 2 OR (len(regexp_extract_all(text, '" + text.JAVA_FRAME + "')) >= 1 AND len(e) > 0) AS detected, "
       "list_distinct(regexp_extract_all(text, '" + text.TRACE_CODE + "')).list_sort() AS codes FROM (SELECT doc_id, text, regexp_extract_all(text, '" + text.TRACE_EXCEPTION + "') AS e FROM documents)")
def trace_text_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Every text read as a stack trace."""
    f = L.trace_fields(F.col("text"))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(text.TRACE_CODE), F.lit(0))))
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", f["frame_count"].alias("frame_count"), f["primary_exception"].isNotNull().alias("has_exception"), f["detected"].alias("detected"), codes.alias("codes"))


@query()
def normalized_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks under a stack of headings."""
    return N.blocks(read(spark, d, "documents", "doc_id", "text"))


@query(", " + """near AS (SELECT chunk_id, list(chunk_id) OVER (PARTITION BY version_id ORDER BY chunk_seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM v_chunks) SELECT * FROM near""", "chunks")
def linked_context(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with two before and two after it, as the links lead."""
    return R.context(V.chunks(spark, d), 2)


@query(content._SUB + """, placed AS (SELECT *, row_number() OVER (ORDER BY is_seed DESC, canonical_name, entity_id) AS p FROM top),
  named AS (SELECT *, min(p) OVER (PARTITION BY entity_type) AS f FROM placed)
  SELECT regexp_replace(entity_id, '[^A-Za-z0-9_-]', '-', 'g')[1:80] AS id, substr(canonical_name, 1, 80) AS label, 'group-' || dense_rank() OVER (ORDER BY f) AS "group" FROM named""", "chunks entities relations mentions")
def diagram_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the diagram; groups are numbered in the order in which they are met."""
    return G.nodes(content.subgraph_entities(spark, d))


@query(content._SUB + """, edges AS (SELECT DISTINCT source_id, target_id, relation_type FROM known WHERE source_id IN (SELECT entity_id FROM top) AND target_id IN (SELECT entity_id FROM top))
  SELECT CASE WHEN (SELECT count(*) FROM top) < 2 OR count(*) FILTER (source_id <> target_id) = 0 THEN NULL WHEN bool_and(relation_type = 'precedes') THEN 'flow' ELSE 'architecture' END AS type FROM edges""", "chunks entities relations mentions")
def diagram_type(spark: SparkSession, d: str) -> DataFrame:
    return G.diagram_type(content.subgraph_entities(spark, d), content.subgraph_relations(spark, d))


@query(content._CELLS + "SELECT table_id, string_agg(path, ' | ' ORDER BY c) AS signature FROM paths GROUP BY table_id", "symbols")
def header_signatures(spark: SparkSession, d: str) -> DataFrame:
    return T.signatures(T.header_paths(T.expand(content._cells(spark, d))))


@query(f", {search._SHOWN}, {search._LEXICAL.format(lane=1)}, {search._DISTANCES.format(lane=2)} SELECT chunk_id, position FROM (SELECT chunk_id, row_number() OVER (ORDER BY distance, rank) AS position FROM lex JOIN v_chunks USING (chunk_id) JOIN dist USING (vec_id)) WHERE position <= 10", _BASE)
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Candidates scored anew, here by their vectors; equal scores keep the candidates' order."""
    vecs = read(spark, d, "embeddings", "vec_id", "embedding")
    at = F.array(*[F.lit(x) for x in R.first_vector(vecs)])
    scored = search.lexical_and_match(spark, d).join(V.chunks(spark, d).select("chunk_id", "vec_id"), "chunk_id").join(vecs.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), at), 9).alias("distance")), "vec_id")
    return R.reranked(scored.select("chunk_id", "rank", (-F.col("distance")).alias("score")), 10)


@query(", codes AS (" + _seen(text.TRACE_CODE, 10) + "), types AS (" + _seen(text.TRACE_EXCEPTION, 10) + """), keys AS (SELECT log_id, list(x ORDER BY n) AS found FROM (
    SELECT log_id, x, row_number() OVER (PARTITION BY log_id ORDER BY n) AS n FROM (SELECT log_id, substr(trim(line), 1, 500) AS x, min(line_no) AS n FROM v_log_lines WHERE regexp_matches(line, '""" + L.MARKER + """') GROUP BY 1, 2)) WHERE n <= 6 GROUP BY log_id)
  SELECT log_id, substr('causes?' || coalesce(chr(10) || 'codes: ' || array_to_string(codes.found, ', '), '') || coalesce(chr(10) || 'exceptions: ' || array_to_string(types.found, ', '), '')
    || coalesce(chr(10) || 'lines:' || chr(10) || array_to_string(keys.found, chr(10)), ''), 1, 2000) AS query
  FROM (SELECT DISTINCT log_id FROM v_log_lines) LEFT JOIN codes USING (log_id) LEFT JOIN types USING (log_id) LEFT JOIN keys USING (log_id)""", "log_lines")
def log_search_query(spark: SparkSession, d: str) -> DataFrame:
    """A search query from each log: question, codes, exceptions, and the first lines with a marker."""
    return L.search_query(V.log_lines(spark, d), "causes?")


#: A query with frames, repeated identifiers, words and a name.
_TEXT = """PAY0012 DOC0012 DOC0012 com.acme.pay.Pay3Exception: the cost of supplier 000000003 in nation_5
 at com.acme.b12.Svc12.m0(Svc12.java:10)
 at com.acme.b5.Svc20$Inner.m8(Svc20.java:7)"""
_Q = R.parsed(_TEXT)
_TERMS = ["the", "of"]
_PREFERRED = (1, 2, 12)


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the chunk that holds them."""
    return V.symbols(spark, d).withColumn("chunk_id", F.concat((F.col("symbol_id") % 200).cast("string"), F.lit("-0")))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of traces: a code and an exception for each order."""
    k = F.col("o_orderkey")
    return read(spark, d, "orders", "o_orderkey").select(
        k.alias("trace_id"), F.concat(F.lit("PAY"), F.lpad((k % 100).cast("string"), 4, "0")).alias("error_code"), F.concat(F.lit("com.acme.pay.Pay"), (k % 7).cast("string"), F.lit("Exception")).alias("exception_class")
    )


@dataclass(frozen=True)
class _Hits:
    """What the lanes rank: ``seen`` (chunk_id, asset_id, created_at, vec_id, tokens, n: score of its words) without texts; the rest are a few rows for each chunk that is hit."""

    seen: DataFrame
    named: DataFrame
    entities: DataFrame
    near: DataFrame


def _hits(spark: SparkSession, d: str, dense: bool) -> _Hits:
    """All of it made once for both sets of lanes: texts are read once, and dropped before chunks are shuffled."""
    n_frames, n = len(_Q.frames), len(_Q.tokens)
    at = 1 + n_frames
    symbols = _symbols(spark, d)
    read_once = V.chunks(spark, d).select("chunk_id", "asset_id", "version_id", "vec_id", R.held_tokens(_Q, [at + 2 * i for i in range(n)]).alias("tokens"), R.word_score(_TERMS, dense).alias("n"))
    seen = written(R.searchable(read_once, V.versions(spark, d), V.assets(spark, d)).select("chunk_id", "asset_id", "created_at", "vec_id", "tokens", "n"), "seen-chunks")
    named = R.frame_hits(symbols, _Q).unionByName(R.trace_hits(_errors(spark, d), V.frames(spark, d), symbols, _Q, [at + 2 * i + 1 for i in range(n)]))
    vecs = read(spark, d, "embeddings", "vec_id", "embedding")
    return _Hits(
        seen, written(named, "named-chunks"), written(R.entity_hits(V.entities(spark, d), V.mentions(spark, d), seen, _TEXT), "entity-chunks"),
        written(R.distances(vecs, R.first_vector(vecs)), "distances"),
    )


def _all_lanes(hits: _Hits, first: int, assets: tuple[int, ...] | None = None) -> list[DataFrame]:
    """Every lane of the query, over chunks of some assets or all: frames, then two for each identifier, then graph, lexical, vector."""
    last = first + len(_Q.frames) + 2 * len(_Q.tokens)
    chunks = hits.seen if assets is None else hits.seen.filter(F.col("asset_id").isin(*assets))
    entities = hits.entities if assets is None else hits.entities.join(chunks, "chunk_id", "left_semi")
    return [
        R.named_lanes(chunks, hits.named, first - 1), R.token_lanes(chunks, first - 1),
        R.ranked(entities, R.LEXICAL_K, last, F.col("score").desc(), F.col("chunk_id").asc()), R.ranked(chunks.filter("n > 0"), R.LEXICAL_K, last + 1, F.col("n").desc(), F.col("chunk_id").asc()),
        R.vector_lane(R.nearest(chunks, hits.near), last + 2),
    ]


def _lane_sql(shown: str, first: int) -> list[str]:
    """The same lanes in SQL."""
    out, lane = [], first
    ranked = lambda rows, n: f"SELECT {n}::BIGINT AS lane_id, row_number() OVER (ORDER BY created_at DESC, chunk_id) AS rank, chunk_id FROM (SELECT DISTINCT chunk_id, created_at FROM {shown} WHERE {rows} ORDER BY created_at DESC, chunk_id LIMIT 30)"
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    for package, classes, methods in _Q.frames:
        out.append(ranked(f"chunk_id IN (SELECT chunk_id FROM placed WHERE package_name = '{package}' AND class_name IN ({listed(classes)}) AND symbol_name IN ({listed(methods)}))", lane))
        lane += 1
    for token in _Q.tokens:
        out.append(ranked(f"identifier = '{token}' OR contains(lower(display_content), '{token.lower()}')", lane))
        out.append(ranked(f"chunk_id IN (SELECT chunk_id FROM placed JOIN used USING (package_name, class_name, symbol_name) JOIN errors USING (trace_id) WHERE error_code = '{token}' OR exception_class = '{token}')", lane + 1))
        lane += 2
    rest = "(" + search._ENTITY.format(lane=lane).removeprefix("ent AS (").replace("'supplier000000003innation_5'", "(SELECT q FROM asked)").replace("JOIN shown", f"JOIN {shown}")
    lexical = "(" + search._LEXICAL.format(lane=lane + 1).removeprefix("lex AS (").replace("FROM shown", f"FROM {shown}")
    vector = f"""(SELECT {lane + 2}::BIGINT AS lane_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank, chunk_id FROM (SELECT chunk_id, distance FROM {shown} JOIN dist USING (vec_id) ORDER BY distance, chunk_id LIMIT 40) WHERE distance <= 0.55)"""
    return [f"({x})" for x in out] + [rest, lexical, vector]


_ASKED = _TEXT.replace("'", "''")
_SIM = search._SIMILARITY.replace("'supplier 000000003 in nation_5'", f"'{_ASKED}'")
_FIRST = len(_lane_sql("shown", 1)) + 1
_DIST = search._DISTANCES.split(",\nnear AS")[0]


@query(f""", {search._SHOWN}, own AS (SELECT * FROM shown WHERE asset_id IN {_PREFERRED}), {_SIM}, {_DIST}, asked AS (SELECT lower(regexp_replace('{_ASKED}', '\\s+', '', 'g')) AS q),
  placed AS (SELECT *, (symbol_id % 200) || '-0' AS chunk_id FROM v_symbols),
  errors AS (SELECT o_orderkey AS trace_id, 'PAY' || lpad((o_orderkey % 100)::VARCHAR, 4, '0') AS error_code, 'com.acme.pay.Pay' || (o_orderkey % 7) || 'Exception' AS exception_class FROM orders),
  used AS (SELECT trace_id, regexp_extract(class_name, '^(.*)\\.[^.]+$', 1) AS package_name, split_part(regexp_extract(class_name, '([^.]+)$', 1), '$', 1) AS class_name, method_name AS symbol_name FROM v_frames WHERE {content._APP}),
  every AS ({" UNION ALL ".join(f"SELECT * FROM {x}" for x in [*_lane_sql("own", 1), *_lane_sql("shown", _FIRST)])})
  SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS rrf_score, row_number() OVER (ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, min(lane_id * 1000000 + rank)) AS position FROM every GROUP BY chunk_id QUALIFY position <= 30""", f"{_BASE} frames symbols entities mentions")
def hybrid_all_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes for frames, identifiers, errors, names, words and vectors, those over preferred assets first; fused."""
    return _fused(_hits(spark, d, dense=False))


def _fused(hits: _Hits) -> DataFrame:
    best = R.fuse([*_all_lanes(hits, 1, _PREFERRED), *_all_lanes(hits, _FIRST)])
    order = Window.orderBy(F.col("rrf_score").desc(), "first")
    return best.select("chunk_id", "rrf_score", F.row_number().over(order).cast("long").alias("position"))


@query()
def hybrid_search_full(spark: SparkSession, d: str) -> DataFrame:
    """The same with words ranked by cover density; the first ten with text and neighbours."""
    hits = _hits(spark, d, dense=True)
    top = written(_fused(hits).filter("position <= 10"), "top")
    # of ten chunks; other documents are not cut into lines again
    assets = [r.asset_id for r in hits.seen.join(F.broadcast(top), "chunk_id").select("asset_id").distinct().collect()]
    return V.chunks(spark, d, linked=True).filter(F.col("asset_id").isin(assets)).join(F.broadcast(top), "chunk_id").select("chunk_id", "rrf_score", "position", "asset_id", "display_content", "previous_chunk_id", "next_chunk_id")
