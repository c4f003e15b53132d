"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document. The ledger keeps the measurements and
one failure bit for each rule; policies are masks over those bits, so a new version of a
policy, or the ablation of a rule, is a bitwise operation on the ledger and never reads
the texts again.

Defined results: a null or empty text has no words and fails ``few_words``; null ids and
repeated rows are kept, a row for a row; an empty table gives an empty ledger; further
columns of the input are ignored. Nothing is shuffled: each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A version of what is enforced: the names of the rules whose failure rejects a document."""

    version: str
    enforced: tuple[str, ...]

    def mask(self) -> int:
        return sum(1 << r.bit for r in rules() if r.name in self.enforced)


def rules() -> list[Rule]:
    """All rules, in bit order; bits are never given to another rule. Compared as whole numbers, without division."""
    c = F.col
    fails = {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        # one line that comes twice in a short text is no fault
        "repeated_lines": (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 100 * c("n_upper") > 60 * c("word_chars"),
        "exclamation": 100 * c("n_exclaim") > 60 * c("n_words"),
        "digits": 100 * c("n_digits") > 50 * c("word_chars"),
    }
    return [Rule(name, bit, column) for bit, (name, column) in enumerate(fails.items())]


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", BASE.enforced + ("symbols", "shouting")),
    Policy("v2", BASE.enforced + ("symbols", "shouting", "exclamation", "repeated_lines", "short_words", "long_words", "digits")),
)


def _kept_length(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements for each row of the input."""
    text = F.col("_text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(NOT_BLANK), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK)).alias("_lines"),
        (F.length(text) - _kept_length(text, NOT_BLANK)).cast("long").alias("word_chars"),
        _kept_length(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _kept_length(text, r"\P{Lu}+").alias("n_upper"),
        _kept_length(text, r"[^!]+").alias("n_exclaim"),
        _kept_length(text, r"[^0-9]+").alias("n_digits"),
    )
    n = F.size("_words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))),
    )
    df = df.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_digits",
        n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_h"),
    )
    # only texts with a repeated window are sorted; the others are done after one hash set
    df = df.withColumn(
        "_order",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    order = F.col("_order")
    same = lambda k, d: F.coalesce(F.get(order, k)["h"] == F.get(order, k + d)["h"], F.lit(False))
    at = F.transform(
        F.sequence(F.lit(0), F.size(order) - 1),
        lambda k: F.when(same(k, -1) | same(k, 1), F.get(order, k)["i"]),
    )
    df = df.withColumn("_at", F.when(order.isNotNull(), F.sort_array(F.filter(at, lambda i: i.isNotNull()))))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_order", "_at")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (bit k: rule k failed), a row for each document."""
    bits = F.lit(0).cast("long")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """Adds the verdict of one policy to a ledger."""
    return book.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(policy.mask()).cast("long")) == 0)


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that fail it, and those that only this rule rejects.

    The ledger is first reduced to a count for each bit pattern, at most 2^rules rows.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(p.mask()).cast("long").alias("mask"))
        for p in policies for r in rules() if r.name in p.enforced
    ]))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.select("fail_bits", "n", cases.alias("c"))
        .groupBy(F.col("c.version").alias("version"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES[-1], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    whole = docs.select(F.struct("*").alias("_row"))
    judged = apply_policy(ledger(whole, "_row", f"_row.{text_col}"), policy, "_kept")
    # a generator, not a filter: a filter would be pushed below the measurements and evaluate them many times over
    return judged.select(F.inline(F.when(F.col("_kept"), F.array("doc_id"))))
