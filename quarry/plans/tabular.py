"""Tables as chunks with text and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources.tables import read
from .registry import query


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """A table of customers for each nation; a segment in seven is blank, and two columns are called Account."""
    key = F.col("c_custkey")
    cell = lambda c, head, text: F.struct(F.lit(c).alias("c"), F.lit(head).alias("head"), text.alias("text"))
    cells = F.array(cell(0, "Segment", F.when(key % 7 == 0, "").otherwise(F.col("c_mktsegment"))), cell(1, "Account", F.col("c_name")), cell(2, "Account", key.cast("string")))
    body = read(spark, d, "customer").select(F.col("c_nationkey").alias("table_id"), (key + 1).alias("r"), F.explode(cells).alias("x"))
    heads = body.select("table_id", F.lit(0).cast("long").alias("r"), "x.c", F.col("x.head").alias("text")).distinct()
    return body.select("table_id", "r", "x.c", "x.text").unionByName(heads)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d)
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    about = nations.select(F.col("n_nationkey").alias("table_id"), F.col("n_name").alias("title"), F.array("r_name", "n_name").alias("article_path"), F.array(F.lit("as of now")).alias("footnotes"))
    return T.sentences(T.records(grid, T.header_paths(grid)), about)


_FACTS = """facts AS (SELECT c_nationkey AS t, c_custkey + 1 AS r, '[표] ' || n_name || chr(10) || '[문맥] ' || r_name || ' > ' || n_name || chr(10)
      || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Segment = ' || c_mktsegment || '; ' END || 'Account = ' || c_custkey || chr(10) || '[각주] as of now' AS fact
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query("WITH " + _FACTS + " SELECT t AS table_id, r, fact FROM facts")
def table_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Each record under its table's title, place and notes."""
    return _facts(spark, d)


@query("WITH RECURSIVE " + _FACTS + """, rows AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS k, greatest(1, length(fact) // 2) AS n FROM facts),
  walk AS (SELECT t, k, r, fact, n, 0::BIGINT AS seq, n AS held, 1::BIGINT AS size FROM rows WHERE k = 1
    UNION ALL SELECT x.t, x.k, x.r, x.fact, x.n, CASE WHEN filled THEN seq + 1 ELSE seq END, CASE WHEN filled THEN last + x.n ELSE held + x.n END, CASE WHEN filled THEN 2 ELSE size + 1 END
    FROM (SELECT rows.*, w.seq, w.held, w.size, w.n AS last, w.size >= 30 OR w.held + rows.n > 900 AS filled FROM walk w JOIN rows ON rows.t = w.t AND rows.k = w.k + 1) x),
  each AS (SELECT t, seq, k, fact FROM walk UNION ALL SELECT a.t, b.seq, a.k, a.fact FROM walk a JOIN walk b ON a.t = b.t AND b.k = a.k + 1 AND b.seq > a.seq),
  made AS (SELECT t, seq, count(*) AS row_count, string_agg(fact, chr(10) ORDER BY k) AS content FROM each GROUP BY t, seq), sized AS (SELECT *, max(seq) OVER (PARTITION BY t) + 1 AS n FROM made)
  SELECT t || ':c:' || lpad(seq::VARCHAR, 4, '0') AS chunk_id, t AS parent_id, seq AS chunk_index, n AS chunk_count, row_count, content, CASE WHEN seq > 0 THEN t || ':c:' || lpad((seq - 1)::VARCHAR, 4, '0') END AS previous_chunk_id,
    CASE WHEN seq + 1 < n THEN t || ':c:' || lpad((seq + 1)::VARCHAR, 4, '0') END AS next_chunk_id FROM sized""")
def table_chunk_items(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of tables: at most 30 rows or 900 tokens, one row of overlap, links to both sides."""
    return T.chunk_items(_facts(spark, d))
