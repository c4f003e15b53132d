"""Corpus cleaning in five stages; each is written as Parquet and read again as the next one's documents.

All stages but the last return the columns of ``documents``. Rules, near-dedup and
decontamination drop whole documents; line dedup changes texts (and ``n_chars``) and drops
documents of which it leaves nothing; the last stage returns tokens.

Defined results: null and empty texts have too few words for the rules and go; null ids are
documents like any other, and count as later than all others; of rows equal in id and text
one stays; further columns pass through all stages but the last, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, near_dedup, pieces, quality_rules
from quarry.llm.common import NOT_BLANK, clear, made, table, written

MODEL = "piece_bpe_32k.model"


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents that lose all their text to it."""
    gone = "n_lines_deleted"
    while gone in docs.columns:
        gone += "_"
    cut = line_dedup.dedup_lines(docs, info=gone)
    left = cut.filter((F.col(gone) == 0) | F.col("text").rlike(NOT_BLANK))
    return left.drop(gone).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the first document stays."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    import public_tokenizers

    coded = pieces.encode(docs, public_tokenizers.path(MODEL), keep=["doc_id", "lang", "source", "text"], decoded=True)
    # the model has one mark for a space, which a text may hold itself
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: SQL can express neither the alignment nor the classes nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    before = made()
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            clear(spark, but=docs, first=before)  # nothing reads the tables of this run's stages before any more
    return docs
