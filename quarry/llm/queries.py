"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, licenses, line_dedup, merkle, near_dedup, pairwise_quality, periodic_runs, pieces, preferences, quality_rules, suffix_dedup, warc
from .common import NOT_BLANK, table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, info="n_lines_deleted").select("doc_id", "text", "n_lines_deleted")


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preferences.formatted(preferences.pairs(table(spark, sf_dir, "conversations")))
    joined = lambda c: F.array_join(F.transform(c, lambda t: t["text"]), "")
    masks = lambda c: F.array_join(F.transform(c, lambda t: t["mask"].cast("string")), "")
    return made.select(
        F.col("pair_id").alias("conv_id"), "chosen_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt",
        joined("chosen").alias("chosen"), masks("chosen").alias("chosen_mask"),
        joined("rejected").alias("rejected"), masks("rejected").alias("rejected_mask"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    book = quality_rules.apply_policy(book, quality_rules.BASE, "_base")
    book = quality_rules.apply_policy(book, quality_rules.POLICIES[-1])
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits"
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = pairwise_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=out())
    return scored.select("doc_id", F.coalesce(out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.when(more, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).drop("proof")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text), of one document in ten with its words from place a on repeated with period p, as the contract fixes it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(NOT_BLANK), F.lit(0))).alias("_words"))
    g, n = ((F.col("_h") - F.col("_h") % 10) / 10).cast("long"), F.size("_words")
    placed = chosen.select("doc_id", "text", "_words", n.alias("_n"), (g % n).cast("int").alias("_a"), g.alias("_g"))
    a, n = F.col("_a"), F.col("_n")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    made = F.concat(F.slice("_words", F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.get("_words", a + (i - a) % p)))
    return placed.select("doc_id", F.when(n > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _made_periodic(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic(docs)
    runs = F.col("runs")
    # exact comparison: length / period is greater if the products crosswise are; runs come by start and period, so the first of equals stays
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("collapsed_sha256").alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_preferences, op3_decontaminate, op4_near_dedup, op5_quality_rules, op6_html_extract, op7_pairwise_quality, op8_sentencepiece, op9_licenses, op10_warc, op11_merkle_manifest, op12_suffix_dedup, op13_periodic_runs)
}
