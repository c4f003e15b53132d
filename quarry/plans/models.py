"""Document models, chunks along their links, graphs of versions that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backfill, links, markdown
from ..operators import docmodel as M
from ..sources import views as V
from ..sources.snapshots import Store
from ..sources.store import new_folder
from ..sources.tables import read
from .registry import query


@query("""SELECT chunk_id, list(chunk_id) OVER (PARTITION BY version_id ORDER BY chunk_seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context FROM v_chunks""", "chunks")
def linked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk among those that three links on both sides lead to."""
    return links.expanded(V.chunks(spark, d, linked=True), window=3)


def _models(spark: SparkSession, d: str) -> DataFrame:
    """A document model for each page: its texts dealt to the three containers, ten to a page of the model."""
    runs = F.regexp_extract_all("html", F.lit(">([^<]+)"), F.lit(1))
    item = lambda name: lambda x: F.struct(x["t"].alias(name), F.array(F.struct(x["p"].alias("page_no"))).alias("prov"))
    dealt = read(spark, d, "pages", "page_id", "html").select("page_id", F.transform(runs, lambda t, i: F.struct(t.alias("t"), i.alias("i"), (F.floor(i / 10) + 1).cast("int").alias("p"))).alias("x"))
    of = lambda k, name: F.transform(F.filter("x", lambda x: x["i"] % 3 == k), item(name))
    return dealt.select("page_id", F.to_json(F.struct(of(0, "text").alias("texts"), of(1, "orig").alias("groups"), of(2, "text").alias("key_value_items"))).alias("payload"))


@query("""SELECT page_id, block, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS text, page FROM (
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY (i - 1) % 3, i) - 1) AS block, t, ((i - 1) // 10 + 1)::INT AS page FROM (
      SELECT page_id, i, runs[i] AS t FROM (SELECT page_id, runs, unnest(range(1, len(runs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '>([^<]+)', 1) AS runs FROM pages))))
  WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def model_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of document models in the order in which these are read."""
    return M.blocks(_models(spark, d), "page_id").select("page_id", "block", "text", "page")


@query("""SELECT r_regionkey::BIGINT AS doc_id, row::INT AS row, col, row_span, col_span, text FROM (
    SELECT r_regionkey, 0 AS row, 0 AS col, 1 AS row_span, 2 AS col_span, r_name AS text FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0, 1, 1, n_nationkey::VARCHAR FROM nation
    UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, 1, 1, n_name FROM nation)""")
def model_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a region's table of nations, half of the models with the older names of fields."""
    rows = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = rows.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = lambda a, b, e: F.array(F.struct(F.lit(0).alias(a), F.lit(0).alias(b), F.lit(2).alias(e), F.col("r_name").alias("text")))
    cell = lambda a, b, k: F.transform("n", lambda x, i: F.struct((i + 1).alias(a), F.lit(k).alias(b), F.lit(k + 1).alias("end_col_offset_idx"), (x["n_nationkey"].cast("string") if k == 0 else x["n_name"]).alias("text")))
    every = lambda a, b: F.concat(head(a, b, "end_col_offset_idx"), cell(a, b, 0), cell(a, b, 1))
    new = F.to_json(F.struct(F.array(F.struct(F.struct(every("start_row_offset_idx", "start_col_offset_idx").alias("table_cells")).alias("data"))).alias("tables")))
    old = F.to_json(F.struct(F.array(F.struct(F.struct(every("row", "col").alias("cells")).alias("table_data"))).alias("tables")))
    models = rows.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.when(F.col("r_regionkey") % 2 == 0, new).otherwise(old).alias("payload"))
    return M.cells(models).select("doc_id", "row", "col", "row_span", "col_span", "text")


def _first_words(texts: DataFrame) -> DataFrame:
    """Stands in for a model: names an entity for each numbered line, by its first word, and relates neighbours."""
    lines = texts.select("version_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    word, n = F.lower(F.regexp_extract("t", r"^\[[0-9]+\] \W*(\w+)", 1)), F.regexp_extract("t", r"^\[([0-9]+)\]", 1)
    return lines.select("version_id", F.col("i").cast("long").alias("line_no"), F.concat_ws("|", F.lit("E"), word, word, F.lit("word"), F.lit(""), n, F.lit("first word")).alias("line"))


@query("""SELECT DISTINCT version_id, lower(regexp_extract(regexp_replace(display_content, '\\s+', ' ', 'g'), '^\\W*(\\w+)', 1)) AS key FROM v_chunks
  WHERE regexp_extract(regexp_replace(display_content, '\\s+', ' ', 'g'), '^\\W*(\\w+)', 1) <> ''""", "chunks")
def backfilled_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all versions' texts after a backfill in batches from an empty store."""
    store = Store(spark, new_folder(spark, "graph"))
    chunks = V.chunks(spark, d).select("version_id", "chunk_seq", "display_content")
    backfill.run(store, chunks.select("version_id"), chunks, _first_words, F.lit(0), batch=100_000, most=1_000_000, characters=100_000_000, max_entities=1_000_000)
    return store.read("entities").select("version_id", "key")


_MARKS = """l AS (SELECT doc_id, i AS line_no, regexp_replace(lines[i], '\\s+$', '') AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT doc_id, string_split(text || chr(10) || '1. ' || source || chr(10) || '- ' || lang, chr(10)) AS lines FROM documents))),
f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence, sum(regexp_matches(line, '^\\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
k AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN NULL WHEN regexp_matches(trim(line), '^(#{1,6})\\s+(.+)$') THEN 'heading' WHEN regexp_matches(line, '^\\s*[0-9]+[.)]\\s+(.+)$') THEN 'numbered'
    WHEN regexp_matches(line, '^\\s*[-*+]\\s+(.+)$') THEN 'bullet' WHEN regexp_matches(line, '^\\s*(?:-{3,}|\\*{3,}|_{3,})\\s*$') THEN 'rule' WHEN line = '' THEN 'blank' ELSE 'text' END AS kind FROM f),
s AS (SELECT *, coalesce(sum((kind = 'numbered')::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS steps FROM k),
e AS (SELECT *, steps - coalesce(max(CASE WHEN kind IN ('heading', 'rule', 'text') THEN steps END) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS n FROM s)"""


@query("WITH " + _MARKS + """ SELECT doc_id, line_no, kind, CASE WHEN kind = 'numbered' THEN n END::BIGINT AS number, (kind = 'bullet' AND n > 0) AS nested FROM e WHERE kind IS NOT NULL
  UNION ALL SELECT doc_id, min(line_no), 'code', NULL, false FROM f WHERE NOT fence AND fences % 2 = 1 GROUP BY doc_id, fences""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the lines of whole texts, to each of which a step and a bullet are added."""
    text = F.concat(F.col("text"), F.lit("\n1. "), F.col("source"), F.lit("\n- "), F.col("lang"))
    lines = read(spark, d, "documents", "doc_id", "text", "source", "lang").select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return markdown.blocks(lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")).select("doc_id", "line_no", "kind", "number", F.coalesce("nested", F.lit(False)).alias("nested"))
