"""License scan by ordered signature rules.

A text is reduced to its lower-cased words, one space between them. Some hundreds of
hand-written signatures (``license_rules``) are regular expressions over those words; each
has a keyword that must occur before the expression is tried, a label, and a priority: a
tag of a file header (4), a name with its version (3), a name or a license's own text (2),
a loose mention (1). A detection whose words lie inside those of a detection of higher
priority, or of a longer one of equal priority, is suppressed; of detections with the same
words and priority the first rule's stays.

Everything happens to a row where it is read: texts without any keyword are not looked at
further; others are scanned in pieces of ``SPAN``
words, each of which answers for the detections that start in its first ``STEP`` words, so
that no text is too long; only detections, numbers and ids are shuffled.

Four base phrases are looked for apart from the rules; their labels always stay.

Defined results: null and empty texts have no words, no labels and score 0; every row has
a result of its own, repeated rows and null ids included; further columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RAW_WORD, n_words, words
from .license_rules import PLUS, RULES, TAG, TAGGED, VERSIONED

#: Phrase and label of the base scan.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Words of a piece, and words whose detections it answers for: no signature is longer than the difference.
SPAN, STEP = 512, 448
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLUS = rf"(?<=[0-9])\+(?!{RAW_WORD})"


def _gate() -> str:
    """An expression that finds a keyword or base phrase, with whatever stands between its words, in lower-cased text."""
    rests = defaultdict(set)
    for keyword in {r.keyword for r in RULES} | {phrase for phrase, _ in BASE}:
        rests[keyword[0]].add(keyword[1:].replace(" ", _BETWEEN) + ("" if keyword.endswith("licen") else "(?![a-uw-z])"))  # a version may follow
    return "(?<![0-9a-z])(?:" + "|".join(f"{first}(?:{'|'.join(sorted(rest))})" for first, rest in sorted(rests.items())) + ")"


#: A text in which this is not found holds no base phrase, and no rule can match it.
GATE = _gate()


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spaced(text: Column) -> Column:
    """The words of a text; a plus behind a number stays with it."""
    return words(F.regexp_replace(text, _PLUS, PLUS))


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, _row (its number), n_words, base counts and places, ``_w`` (words; null where no gate word occurs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"), F.when(F.lower(text).rlike(GATE), spaced(text)).alias("_w")
    )
    # every word stands between spaces of its own, so that places that touch are all counted
    df = df.withColumn("n_words", F.when(F.col("_w").isNull(), n_words(F.col("_text"))).otherwise(F.size("_w").cast("long")))
    df = df.withColumn("_own", F.when(F.col("_w").isNotNull(), F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" "))))
    own = F.col("_own")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        key = " " + phrase.replace(" ", "  ") + " "
        k = len(phrase.split())
        n = F.coalesce(((F.length(own) - F.length(F.replace(own, F.lit(key), F.lit("")))) / len(key)).cast("long"), F.lit(0).cast("long"))
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.substring_index(own, key, 1)) / 2).cast("long"))
        lasts.append(F.when(n > 0, F.col("n_words") - _spaces(F.substring_index(own, key, -1)) / 2 - k).cast("long"))
        labels.append(F.when(n > 0, F.lit(label)))
    return df.select(
        "doc_id", "_row", "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        "_w",
    )


def _walk(found: Column, between: Column, at: Column) -> Column:
    """Places (start, end, words) of a rule's detections in a piece that begins at word ``at``.

    The words before a detection are the spaces before it, less the one in front of the first word.
    """
    return F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f")),
        F.struct(F.lit(0).alias("seen"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("at")),
        lambda a, x: F.struct(
            (a["seen"] + _spaces(x["b"]) + _spaces(x["f"])).alias("seen"),
            F.when(
                a["seen"] + _spaces(x["b"]) <= STEP,
                F.array_append(a["at"], F.struct(
                    (at + a["seen"] + _spaces(x["b"]) - 1).alias("start"), (at + a["seen"] + _spaces(x["b"]) + _spaces(x["f"])).alias("end"), x["f"].alias("found")
                )),
            ).otherwise(a["at"]).alias("at"),
        ),
    )["at"]


def detections(df: DataFrame) -> DataFrame:
    """Rows (_row, _w, ...) with each row's detections: rule, label, priority, start, end, suppressed; words are counted from 0.

    ``_w`` goes; a row without detections stays once, with nulls.
    """
    keep = [c for c in df.columns if c != "_w"]
    n = F.size("_w")
    pieces = F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1, F.lit(STEP)),
        lambda i: F.struct(i.alias("at"), F.concat(F.lit(" "), F.array_join(F.slice("_w", i + 1, SPAN), " "), F.lit(" ")).alias("line")),
    ))
    df = df.select(*keep, F.explode_outer(pieces).alias("_piece"))
    # the rules' literals, in one expression: each is compiled once
    tried = ", ".join(
        f"CASE WHEN contains(_piece.line, ' {r.keyword}') AND rlike(_piece.line, r'(?<= )(?:{r.regex})(?= )') THEN named_struct('rule', {k}, 'label', '{r.label}', 'priority', {r.priority},"
        f" 'regex', r'^(?:{r.regex if r.versioned else '()()'})$', 'found', regexp_extract_all(_piece.line, r'(?<= )(?:{r.regex})(?= )', 0), 'between', split(_piece.line, r'(?<= )(?:{r.regex})(?= )', -1)) END"
        for k, r in enumerate(RULES)
    )
    df = df.select(*keep, F.col("_piece.at").alias("_at"), F.explode_outer(F.expr(f"filter(array({tried}), x -> x IS NOT NULL)")).alias("_hit"))
    df = df.select(*keep, "_at", F.col("_hit").dropFields("found", "between").alias("_rule"), F.explode_outer(_walk(F.col("_hit.found"), F.col("_hit.between"), F.col("_at"))).alias("_d"))
    # each row stays at least once: for its first piece
    df = df.filter(F.col("_d").isNotNull() | F.coalesce(F.col("_at") == 0, F.lit(True)))
    number, later = (F.expr(f"regexp_extract(_d.found, _rule.regex, {group})") for group in (1, 2))
    version = F.when(number != "", F.concat(F.lit("-"), F.replace(number, F.lit(" "), F.lit(".")), F.when(F.contains(number, F.lit(" ")), "").otherwise(".0")))
    label = F.concat("_rule.label", F.coalesce(version, F.lit("")), F.when(version.isNotNull() & (later != ""), "-or-later").otherwise(""))
    priority = F.when(F.startswith("_d.found", F.lit(TAG)), TAGGED).when(version.isNotNull(), VERSIONED).otherwise(F.col("_rule.priority"))
    none = F.col("_d").isNull()
    df = df.select(
        *keep, F.when(~none, F.col("_rule.rule")).alias("rule"), F.when(~none, label).alias("label"), F.when(~none, priority).alias("priority"),
        F.col("_d.start").alias("start"), F.col("_d.end").alias("end"),
    )
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    higher = [F.max(F.when(F.col("priority") > p, F.col("end"))).over(before) for p in (1, 2, 3)]
    reach = F.when(F.col("priority") == 1, higher[0]).when(F.col("priority") == 2, higher[1]).when(F.col("priority") == 3, higher[2])
    # of equal priority all that could hold a detection stand before it: earlier, or as early and longer, or of an earlier rule
    equal = Window.partitionBy("_row", "priority").orderBy("start", F.col("end").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("suppressed", F.coalesce(F.greatest(reach, F.max("end").over(equal)) >= F.col("end"), F.lit(False)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts and labels, all labels, the detections that stay, and a score (0 to 1)."""
    base = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")
    found = detections(base_scan(docs, id_col, text_col))
    stays = ~F.col("suppressed") & F.col("rule").isNotNull()
    per_doc = found.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in base],
        F.collect_set(F.when(stays, F.col("label"))).alias("_labels"),
        F.max(F.when(stays, F.col("priority"))).alias("_top"),
        F.sort_array(F.collect_set(F.when(stays, F.struct("start", "end", "label", "priority")))).alias("spans"),
    )
    return per_doc.select(
        *base,
        F.array_sort(F.array_union("base", "_labels")).alias("labels"),
        "spans",
        F.greatest(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.col("_top"), F.lit(0)) / 4.0).alias("score"),
    )
