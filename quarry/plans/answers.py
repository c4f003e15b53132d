"""Answers: preferred search, evidence, dispatch, chunkers, and text rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import budget as B
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import logs as L
from ..operators import retrieval as R
from ..operators import tables as T
from ..sources import views as V
from ..sources.tables import read
from . import content, search
from .registry import ORACLE_SQL, query

@query(
    f""", {search._SHOWN}, own AS (SELECT * FROM shown WHERE asset_id IN (1, 2, 12)),
    p1 AS (SELECT 1::BIGINT AS lane_id, row_number() OVER (ORDER BY created_at DESC, chunk_id) AS rank, chunk_id FROM (SELECT * FROM own WHERE identifier = 'DOC0012' OR contains(lower(display_content), 'doc0012') ORDER BY created_at DESC, chunk_id LIMIT 30)),
    p2 AS (SELECT 2::BIGINT AS lane_id, row_number() OVER (ORDER BY n DESC, chunk_id) AS rank, chunk_id FROM (
      SELECT chunk_id, (len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'of')))::BIGINT AS n
      FROM (SELECT chunk_id, regexp_split_to_array(lower(identifier || ' ' || display_content), '[^\\p{{L}}\\p{{N}}]+') AS w FROM own) WHERE list_contains(w, 'the') AND list_contains(w, 'of') ORDER BY n DESC, chunk_id LIMIT 40)),
    {search._IDENTIFIER.format(lane=11)}, {search._LEXICAL.format(lane=12)},
    every AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM idl UNION ALL SELECT * FROM lex)
    SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS rrf_score FROM every GROUP BY chunk_id ORDER BY rrf_score DESC, min(lane_id * 1000000 + rank) LIMIT 30""", search._BASE)
def hybrid_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Lanes over preferred assets stand before the same lanes over all: a boost, not a filter."""
    shown = search._shown(spark, d)

    def lanes(chunks: DataFrame, first: int) -> list[DataFrame]:
        words = R.lexical_hits(chunks, ["the", "of"])
        return [R.identifier_lane(chunks, "DOC0012", first + 1), R.ranked(words, R.LEXICAL_K, first + 2, F.col("n").desc(), F.col("chunk_id").asc())]

    return R.fuse([*lanes(shown.filter(F.col("asset_id").isin(1, 2, 12)), 0), *lanes(shown, 10)]).select("chunk_id", "rrf_score")


@query(ORACLE_SQL["exact_lane_topk"])
def identifier_lane(spark: SparkSession, d: str) -> DataFrame:
    return R.identifier_lane(search._shown(spark, d), "DOC0012", 1)


@query(f", {search._SHOWN}, {search._THREE}, {search._FUSED} SELECT f.chunk_id, c.asset_id, c.version_id, c.display_content, a.title, a.vendor FROM fused f JOIN v_chunks c USING (chunk_id) JOIN v_assets a USING (asset_id)", search._BASE)
def candidate_materialise(spark: SparkSession, d: str) -> DataFrame:
    """Wide columns of the thirty candidates only; filters are not applied again."""
    ids = search.rrf_fusion(spark, d).select("chunk_id")
    wide = V.chunks(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "asset_id", "version_id", "display_content")
    return wide.join(V.assets(spark, d).select("asset_id", "title", "vendor"), "asset_id").select("chunk_id", "asset_id", "version_id", "display_content", "title", "vendor")


@query("""SELECT asset_id, count(*) AS n_evidence, CASE WHEN count(*) >= 3 THEN 'answered' ELSE 'insufficient' END AS status, min_by(chunk_id, chunk_seq) AS first_evidence FROM v_chunks WHERE contains(lower(display_content), 'the') GROUP BY asset_id""", "chunks")
def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    hit = V.chunks(spark, d).filter(F.contains(F.lower("display_content"), F.lit("the")))
    return hit.groupBy("asset_id").agg(n.alias("n_evidence"), F.when(n >= 3, "answered").otherwise("insufficient").alias("status"), F.min_by("chunk_id", "chunk_seq").alias("first_evidence"))


@query("""SELECT log_id, 0::BIGINT AS position, string_agg(line, chr(10) ORDER BY line_no)[1:500] AS evidence FROM v_log_lines WHERE contains(line, 'ERROR') GROUP BY log_id
  UNION ALL SELECT asset_id, chunk_seq + 1, display_content FROM v_chunks WHERE asset_id IN (SELECT log_id FROM v_log_lines WHERE contains(line, 'ERROR'))""", "chunks log_lines")
def incident_evidence_order(spark: SparkSession, d: str) -> DataFrame:
    """The log itself comes first, then the chunks."""
    errors = V.log_lines(spark, d).filter(F.contains("line", F.lit("ERROR")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    first = errors.groupBy("log_id").agg(F.substring(said, 1, 500).alias("evidence")).select("log_id", F.lit(0).cast("long").alias("position"), "evidence")
    rest = V.chunks(spark, d).join(errors.select(F.col("log_id").alias("asset_id")), "asset_id", "left_semi").select(F.col("asset_id").alias("log_id"), (F.col("chunk_seq") + 1).alias("position"), F.col("display_content").alias("evidence"))
    return first.unionByName(rest)


@query("""SELECT log_id, 0::BIGINT AS position, line_no, line AS evidence FROM (
    SELECT *, bool_or(regexp_matches(line, '""" + L.MARKER + """')) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS near FROM v_log_lines) WHERE near
  UNION ALL SELECT asset_id, chunk_seq + 1, NULL, display_content FROM v_chunks WHERE asset_id IN (SELECT log_id FROM v_log_lines WHERE regexp_matches(line, '""" + L.MARKER + """'))""", "chunks log_lines")
def incident_evidence_whole(spark: SparkSession, d: str) -> DataFrame:
    """All lines near a log's markers come first, one row each and none cut, then the chunks."""
    lines = V.log_lines(spark, d)
    first = L.around_markers(lines).select("log_id", F.lit(0).cast("long").alias("position"), "line_no", F.col("line").alias("evidence"))
    marked = lines.filter(F.col("line").rlike(L.MARKER)).select(F.col("log_id").alias("asset_id"))
    rest = V.chunks(spark, d).join(marked, "asset_id", "left_semi").select(F.col("asset_id").alias("log_id"), (F.col("chunk_seq") + 1).alias("position"), F.lit(None).cast("long").alias("line_no"), F.col("display_content").alias("evidence"))
    return first.unionByName(rest)


@query("SELECT asset_id, CASE asset_type WHEN 'source_code' THEN 'code' WHEN 'error_trace' THEN 'log' WHEN 'incident' THEN 'incident' ELSE 'text' END AS parser FROM v_assets", "assets")
def parser_dispatch(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("asset_type")
    return V.assets(spark, d).select("asset_id", F.when(kind == "source_code", "code").when(kind == "error_trace", "log").when(kind == "incident", "incident").otherwise("text").alias("parser"))


@query(content._CELLS + ", named AS (SELECT table_id, r, path, arg_max(text, c) AS text FROM grid JOIN paths USING (table_id, c) WHERE r > 0 GROUP BY table_id, r, path) SELECT table_id, r::BIGINT AS r, count(*) FILTER (trim(text) <> '') AS n_filled FROM named GROUP BY table_id, r HAVING count(*) FILTER (trim(text) <> '') > 0", "symbols")
def grid_to_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows as records: of columns with one name the last counts; rows without text are dropped."""
    grid = T.expand(content._cells(spark, d))
    named = grid.filter("r > 0").join(T.header_paths(grid), ["table_id", "c"]).groupBy("table_id", "r", "path").agg(F.max_by("text", "c").alias("text"))
    return named.filter(F.trim("text") != "").groupBy("table_id", F.col("r").cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n_filled"))


@query("""SELECT trace_id, f.frame_seq, bool_or(coalesce(s.class_name = split_part(regexp_extract(f.class_name, '([^.]+)$', 1), '$', 1), false)) AS matched FROM v_frames f LEFT JOIN v_symbols s ON s.symbol_name = f.method_name AND s.package_name = regexp_extract(f.class_name, '^(.*)\\.[^.]+$', 1) GROUP BY trace_id, f.frame_seq""", "frames symbols")
def frame_source_match(spark: SparkSession, d: str) -> DataFrame:
    symbols = V.symbols(spark, d).select("package_name", F.col("class_name").alias("simple"), F.col("symbol_name").alias("method_name")).distinct().withColumn("hit", F.lit(True))
    full = F.regexp_extract("class_name", r"([^.]+)$", 1)
    frames = V.frames(spark, d).withColumn("package_name", F.regexp_extract("class_name", r"^(.*)\.[^.]+$", 1)).withColumn("simple", F.substring_index(full, "$", 1))
    return frames.join(symbols, ["package_name", "simple", "method_name"], "left").select("trace_id", "frame_seq", F.coalesce("hit", F.lit(False)).alias("matched"))


@query("SELECT chunk_id, regexp_matches(lower(regexp_replace(display_content, '\\s+', ' ', 'g')), '" + "|".join(text.INSUFFICIENT) + "') AS insufficient FROM v_chunks", "chunks")
def insufficient_evidence(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("chunk_id", text.is_insufficient(F.col("display_content")).alias("insufficient"))


_HEADS = "CASE doc_id % 6 WHEN 0 THEN '[별표40-1] ' || lang WHEN 1 THEN '2-4  ' || lang || ' 특별약관' WHEN 2 THEN ' 제1관 ' || lang WHEN 3 THEN lang || ' 제 3조의2 (' || lang || ')' WHEN 4 THEN '특별약관 ' || lang ELSE lang END"


@query(f"""SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(h, '{form}') THEN '{name}'" for name, form in text.HEADINGS.items())} END AS class
  FROM (SELECT doc_id, trim(regexp_replace({_HEADS}, '\\s+', ' ', 'g')) AS h FROM documents)""")
def heading_class(spark: SparkSession, d: str) -> DataFrame:
    k, lang = F.col("doc_id") % 6, F.col("lang")
    head = (
        F.when(k == 0, F.concat(F.lit("[별표40-1] "), lang)).when(k == 1, F.concat(F.lit("2-4  "), lang, F.lit(" 특별약관"))).when(k == 2, F.concat(F.lit(" 제1관 "), lang))
        .when(k == 3, F.concat(lang, F.lit(" 제 3조의2 ("), lang, F.lit(")"))).when(k == 4, F.concat(F.lit("특별약관 "), lang)).otherwise(lang)
    )
    return read(spark, d, "documents", "doc_id", "lang").select("doc_id", text.heading(head).alias("class"))


@query("""SELECT doc_id, max_by(value, i) FILTER (key = 'title') AS title, max_by(value, i) FILTER (key = 'cause') AS cause, count(DISTINCT key) >= 2 AS structured FROM (
  SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN 'title' WHEN i % 4 = 1 THEN 'cause' END AS key, ls[i] AS value FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) GROUP BY doc_id""")
def incident_fields(spark: SparkSession, d: str) -> DataFrame:
    """``key: value`` lines; the last of a key wins, two keys make an incident."""
    lines = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "ln")).withColumn("i", F.col("p") + 1)
    written = F.concat(F.when(F.col("i") % 4 == 0, "title: ").when(F.col("i") % 4 == 1, "cause: ").otherwise(""), F.col("ln"))
    keyed = lines.select("doc_id", "i", F.when(F.col("i") % 4 < 2, F.regexp_extract(written, r"^(\w+): ", 1)).alias("key"), F.when(F.col("i") % 4 < 2, F.regexp_extract(written, r"(?s)^\w+: (.*)$", 1)).alias("value"))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("i")))
    return keyed.groupBy("doc_id").agg(last("title").alias("title"), last("cause").alias("cause"), (F.countDistinct("key") >= 2).alias("structured"))


@query()
def incident_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block of each text with the fields that its ``key: value`` lines give; two fields make an incident."""
    blocks = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(text.blocks(F.col("text"))).alias("block", "content"))
    rows = blocks.select("doc_id", "block", "content", F.explode(text.incident_fields(F.col("content"))).alias("f")).select("doc_id", "block", "content", "f.*")
    return rows.withColumn("structured", sum((F.col(k).isNotNull().cast("int") for k in set(text.INCIDENT_FIELDS.values())), F.lit(0)) >= 2)


@query()
def java_text_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of each text as Java code; its first class is the symbol."""
    docs = read(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("name", F.regexp_extract("text", r"\bclass\s+([A-Za-z_$][\w$]*)", 1))
    found = text.java_diagnostics(F.col("text"), F.lit(None).cast("string"), F.col("name"), F.when(F.col("name") != "", "class"))
    return docs.select("doc_id", *[c.alias(k) for k, c in found.items()])


_POINTS = "3 * (" + " + ".join(f"contains(t, '{w}')::BIGINT" for w in text.ARCHITECTURE) + ") - 3 * (" + " + ".join(f"contains(t, '{w}')::BIGINT" for w in text.ACTIVITY) + ")"


def architecture_points() -> Column:
    """Of a chunk; none here was read from an image."""
    return text.architecture_points(F.col("display_content"), F.lit(False))


@query(f"SELECT chunk_id, {_POINTS} AS score FROM (SELECT chunk_id, chunk_seq, lower(display_content) AS t FROM v_chunks)", "chunks")
def architecture_score(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("chunk_id", architecture_points().alias("score"))


@query("""SELECT asset_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY contains(display_content, 'the') DESC, chunk_seq) AS n FROM v_chunks) WHERE n <= 6""", "chunks")
def select_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each asset six chunks: those that score, then the first."""
    order = Window.partitionBy("asset_id").orderBy(F.contains("display_content", F.lit("the")).desc(), "chunk_seq")
    return V.chunks(spark, d).withColumn("n", F.row_number().over(order)).filter("n <= 6").select("asset_id", "chunk_id")


@query(""", scored AS (SELECT asset_id, chunk_id, chunk_seq, """ + _POINTS + """ AS score FROM (SELECT *, lower(display_content) AS t FROM v_chunks)),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, chunk_seq) AS k FROM scored),
  taken AS (SELECT *, count(*) FILTER (k <= 3 AND score > 0) OVER (PARTITION BY asset_id) AS m FROM ranked),
  kinds AS (SELECT *, CASE WHEN k <= 3 AND score > 0 THEN 0 WHEN n <= 6 OR list_contains(list_transform(range(0, 6 - m), lambda p: round_even(p * (n - 1) / (5 - m), 0)::BIGINT), chunk_seq) THEN 1 ELSE 2 END AS kind FROM taken)
  SELECT asset_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY kind, CASE WHEN kind = 1 THEN chunk_seq ELSE k END) AS place FROM kinds) WHERE place <= 6""", "chunks")
def select_items_spread(spark: SparkSession, d: str) -> DataFrame:
    """Of each asset six chunks: up to three that score best, the others at even positions from first to last.

    A position that scored already leaves its place to the next best. The reference work spreads six positions, of which
    those that find no place any more are the last ones; here only as many are spread as there are places.
    """
    most, seq = 6, F.col("chunk_seq")
    asset = Window.partitionBy("asset_id")
    rows = V.chunks(spark, d).select("asset_id", "chunk_id", "chunk_seq", architecture_points().alias("score"))
    rows = rows.withColumn("k", F.row_number().over(asset.orderBy(F.col("score").desc(), "chunk_seq"))).withColumn("total", F.count(F.lit(1)).over(asset))
    best = (F.col("k") <= most // 2) & (F.col("score") > 0)
    rows = rows.withColumn("taken", F.count_if(best).over(asset))
    spread = F.coalesce(*[F.when(F.col("taken") == t, B.even(F.col("total"), most - t)) for t in range(most // 2 + 1)])
    kind = F.when(best, 0).when(F.array_contains(spread, seq), 1).otherwise(2)
    order = asset.orderBy("kind", F.when(F.col("kind") == 1, seq).otherwise(F.col("k")))
    return rows.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("asset_id", "chunk_id")


@query("SELECT target_id, string_agg(source_id || ' -[' || relation_type || ']-> ' || target_id, chr(10) ORDER BY source_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS n FROM v_relations) WHERE n <= 50 GROUP BY target_id", "relations")
def relation_context_text(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty relations of each target as sentences."""
    first = V.relations(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("source_id"))).filter("n <= 50")
    said = F.struct("source_id", F.concat(F.col("source_id"), F.lit(" -["), F.col("relation_type"), F.lit("]-> "), F.col("target_id")).alias("s"))
    return first.groupBy("target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), "\n").alias("context"))


@query("SELECT source_id, target_id, relation_type, least(1.0, greatest(0.0, max(confidence) * 1.5 - 0.2))::DOUBLE AS confidence FROM v_relations WHERE source_id <> target_id AND source_id IN (SELECT entity_id FROM v_entities) AND target_id IN (SELECT entity_id FROM v_entities) GROUP BY source_id, target_id, relation_type", "entities relations")
def graph_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Relations between known entities, without loops; of copies the greatest confidence, from 0 to 1."""
    ids = V.entities(spark, d).select("entity_id")
    r = V.relations(spark, d).filter("source_id <> target_id").groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"))
    for end in ("source_id", "target_id"):
        r = r.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    return r.select("source_id", "target_id", "relation_type", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").cast("double") * 1.5 - 0.2)).alias("confidence"))


@query("SELECT symbol_id, symbol_id % 7 = 0 OR class_name = 'Svc3' AS decompiled FROM v_symbols", "symbols")
def decompiled_flag(spark: SparkSession, d: str) -> DataFrame:
    """From metadata as JSON, or from the kind."""
    meta = F.to_json(F.struct((F.col("symbol_id") % 7 == 0).alias("decompiled")))
    kind = F.when(F.col("class_name") == "Svc3", "decompiled_code").otherwise("code")
    return V.symbols(spark, d).select("symbol_id", ((F.get_json_object(meta, "$.decompiled") == "true") | kind.startswith("decompiled_code")).alias("decompiled"))


@query("SELECT log_id, 'codes: ' || array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(line, '[A-Z]{2,10}-?[0-9]{3,6}[A-Z]?'))))), ', ') AS context FROM v_log_lines GROUP BY log_id HAVING len(flatten(list(regexp_extract_all(line, '[A-Z]{2,10}-?[0-9]{3,6}[A-Z]?')))) > 0", "log_lines")
def diagnostic_context(spark: SparkSession, d: str) -> DataFrame:
    codes = content.error_codes_extract(spark, d).filter(F.size("codes") > 0)
    return codes.select("log_id", F.concat(F.lit("codes: "), F.array_join("codes", ", ")).alias("context"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props->>'$.k' WHEN event_id % 3 = 1 THEN event_type END AS question FROM events")
def payload_normalise(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object, a plain text, or nothing usable."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.col("props")).when(k == 1, F.col("event_type")).otherwise("{broken")
    whole = F.get_json_object(body, "$.k")
    return read(spark, d, "events", "event_id", "event_type", "props").select("event_id", F.when(body.startswith("{"), whole).otherwise(body).alias("question"))


@query("SELECT chunk_id, regexp_extract_all('**' || identifier || '** ' || chunk_seq || ' `' || identifier || '`', '\\*\\*[^*]+\\*\\*|`[^`]+`|\\*[^*]+\\*') AS tokens FROM v_chunks", "chunks")
def inline_markdown_tokens(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("**"), F.col("identifier"), F.lit("** "), F.col("chunk_seq").cast("string"), F.lit(" `"), F.col("identifier"), F.lit("`"))
    return V.chunks(spark, d).select("chunk_id", F.regexp_extract_all(line, F.lit(r"\*\*[^*]+\*\*|`[^`]+`|\*[^*]+\*"), F.lit(0)).alias("tokens"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (1, 2, 3) THEN 'admin' WHEN e.user_id IS NULL THEN 'uploader' ELSE 'viewer' END AS role FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') e ON e.user_id = c_custkey")
def role_default(spark: SparkSession, d: str) -> DataFrame:
    """A stored role, else uploader; the first administrators are given."""
    stored = read(spark, d, "events", "user_id", "event_type").filter("event_type = 'signup'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("role", F.lit("viewer"))
    joined = read(spark, d, "customer", "c_custkey").join(stored, "c_custkey", "left")
    return joined.select("c_custkey", F.when(F.col("c_custkey").isin(1, 2, 3), "admin").otherwise(F.coalesce("role", F.lit("uploader"))).alias("role"))


@query("""SELECT v.version_id, coalesce(CASE WHEN v.version_id % 20 = 1 THEN 'artifact ' || v.source_filename END, d.document, '') AS markdown FROM v_versions v LEFT JOIN (
  SELECT version_id, string_agg(display_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_seq) || chr(10) AS document FROM v_chunks GROUP BY version_id) d USING (version_id)""", "versions chunks")
def markdown_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A version's own file, else its chunks joined."""
    from .admin import reconstruct_document

    own = F.when(F.col("version_id") % 20 == 1, F.concat(F.lit("artifact "), F.col("source_filename")))
    return V.versions(spark, d).select("version_id", own.alias("own")).join(reconstruct_document(spark, d), "version_id", "left").select("version_id", F.coalesce("own", "document", F.lit("")).alias("markdown"))


@query("SELECT doc_id, i AS seq, 'w' || i AS content FROM (SELECT doc_id, unnest(range(0, (len(string_split(text, chr(10))) + 119) // 120)) AS i FROM documents)")
def code_windows_120(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 120 lines over files."""
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 120).cast("long")
    seqs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    return seqs.select("doc_id", "seq", F.concat(F.lit("w"), F.col("seq").cast("string")).alias("content"))


@query("""SELECT doc_id, i AS seq, i * 120 + 1 AS line_start, least(i * 120 + 120, len(ls)) AS line_end, array_to_string(ls[i * 120 + 1:i * 120 + 120], chr(10)) AS content
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 119) // 120)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""")
def code_windows_text(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 120 lines over files: the lines themselves, and the numbers of the first and the last."""
    docs = read(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(C.windows(F.split("text", "\n"), 120)).alias("w")).select("doc_id", "w.*")


@query()
def paragraph_pack_3000(spark: SparkSession, d: str) -> DataFrame:
    return C.paragraphs(read(spark, d, "documents", "doc_id", "text"))


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of headed blocks: a line in four is a heading."""
    lines = V.chunks(spark, d)
    heading = F.when(F.col("chunk_seq") % 4 == 0, F.substring("display_content", 1, 40))
    return C.semantic(lines.select(F.col("asset_id").alias("doc_id"), F.col("chunk_seq").alias("position"), heading.alias("heading"), F.col("display_content").alias("text")), 70, 100)


@query()
def lexical_cover_density(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with both terms, by how close together these stand; the first forty."""
    words = F.split(F.lower(F.concat_ws(" ", "identifier", "display_content")), text.APART)
    scored = search._shown(spark, d).select("chunk_id", F.round(text.cover_density(words, ["the", "of"]), 9).alias("score"))
    return scored.filter("score > 0").orderBy(F.col("score").desc(), "chunk_id").limit(R.LEXICAL_K)


@query()
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(content.row_facts(spark, d), 40, 4)


@query()
def table_continuation(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring tables with like headers: tables are paired by their number."""
    heads = T.header_paths(T.expand(content._cells(spark, d))).groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "path"))), lambda x: x["path"]), " | ").alias("header"), F.count(F.lit(1)).alias("cols")
    )
    side = lambda p, shift: heads.select((F.col("table_id") + shift).alias("k"), F.col("table_id").alias(p), F.col("header").alias(f"{p}_header"), F.col("cols").alias(f"{p}_cols"))
    pairs = side("a", 1).join(side("b", 0), "k").withColumn("page_gap", F.lit(1))
    return T.continued(pairs).select("a", "b", F.round("ratio", 9).alias("ratio"))


@query("""SELECT trace_id, frame_seq, 'at ' || class_name || '.' || method_name AS raw, class_name, method_name FROM v_frames""", "frames")
def java_frames_extract(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as text and read again."""
    raw = F.concat(F.lit("at "), F.col("class_name"), F.lit("."), F.col("method_name"))
    pattern = r"^at ([\w.$]+)\.([\w$<>]+)$"
    return V.frames(spark, d).withColumn("raw", raw).select("trace_id", "frame_seq", "raw", F.regexp_extract("raw", pattern, 1).alias("class_name"), F.regexp_extract("raw", pattern, 2).alias("method_name"))


@query("""SELECT symbol_id, CASE WHEN symbol_id % 3 = 0 THEN ['PayException', 'java.io.IOException'] ELSE [] END AS declared, 'Svc' || (symbol_id % 40) || 'Exception' AS thrown FROM v_symbols""", "symbols")
def java_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What a method's text declares and throws."""
    k = F.col("symbol_id")
    code = F.concat(F.lit("void "), F.col("symbol_name"), F.lit("()"), F.when(k % 3 == 0, " throws java.io.IOException, PayException").otherwise(""), F.lit(" { throw new "), F.col("class_name"), F.lit("Exception(); }"))
    declared = F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_extract(code, r"\) throws ([\w., ]+)", 1), F.lit(r"[\w.]+"), F.lit(0))))
    return V.symbols(spark, d).select("symbol_id", declared.alias("declared"), F.regexp_extract(code, r"throw new ([\w.]+)", 1).alias("thrown"))
