"""Benchmark decontamination by a prefix-filtered set join.

An item of the benchmark is cut into windows of 10 consecutive words (an item of fewer
words is one window). A window is a set of 3-word shingles, all of which a document must
hold, so under exact containment the necessary prefix of a window is one shingle: the
rarest in the corpus. Steps:

1. one pass over the documents counts the shingles that some window has; the counts order
   them by rarity (a window with a shingle that is nowhere can't occur);
2. a second pass joins the documents' shingles with the prefixes alone, one for each window;
3. positional and length bounds drop places where the window would leave the document;
4. the words at the place are compared with the window, word for word.

Documents are cut into pieces of ``STEP`` words, with the words around them that a window
can reach, so that no row carries a long text. Equal windows are one, whichever items have them. The
shingles of windows, and later the prefixes, are broadcast after each has been counted; beyond
``broadcast_limit`` of them ids and hashes of shingles are shuffled instead, and the places
found are joined with their pieces. Both ways give the same rows.

Defined results: null or empty texts have no words and are never hit; items without words
are ignored; rows equal in id and text share one result; null ids are documents like any
other; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, row_key, words, written

WINDOW = 10
SHINGLE = 3
#: Words of a document that a row holds, besides those around them.
STEP = 256


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, w: the words of one window, len, wid: 128 bits that equal windows share)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(window))
    return items.select(
        "item_id", "_w", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("_w") - n)).alias("_at")
    ).select("item_id", F.slice("_w", F.col("_at") + 1, F.col("len")).alias("w"), "len").distinct().withColumn("wid", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))))


def _shingles(w: Column, size: Column | int, last: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, size)))


def pieces(docs: DataFrame, window: int) -> DataFrame:
    """(_k, n: words of the document, piece: number, base: place of the first word, _p: words) for rows (_k, _text)."""
    w = docs.select("_k", words(F.col("_text")).alias("_w")).withColumn("n", F.size("_w"))
    each = w.select("_k", "n", "_w", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / STEP).cast("int")))).alias("piece"))
    base = F.greatest(F.col("piece") * STEP - window, F.lit(0))
    return each.select("_k", "n", "piece", base.alias("base"), F.slice("_w", base + 1, F.lit(STEP + 2 * window)).alias("_p"))


def _places(docs: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """(_k, n, base, _p, pos, size, s) of every shingle of these sizes in the documents."""
    cut = pieces(docs, window)
    begin = F.col("piece") * STEP
    each = cut.select("_k", "n", "base", "_p", F.explode(F.sequence(begin, F.least(begin + STEP, F.col("n")) - 1)).alias("pos"))
    each = each.withColumn("size", F.explode(F.lit(sizes)) if len(sizes) > 1 else F.lit(sizes[0])).filter(F.col("pos") + F.col("size") <= F.col("n"))
    return each.withColumn("s", F.xxhash64(F.slice("_p", F.col("pos") - F.col("base") + 1, F.col("size"))))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_limit: int = 200_000) -> DataFrame:
    """Places (_k, start, len, item_id) of windows in documents; ``docs`` has (_k, _text)."""
    per_item = written(windows(benchmark, window), "benchmark-windows")
    each = per_item.groupBy("wid").agg(F.first("w").alias("w"), F.first("len").alias("len")).withColumn("size", F.least(F.col("len"), F.lit(SHINGLE)))
    cut = each.select("wid", "w", "len", "size", F.posexplode(_shingles(F.col("w"), F.col("size"), F.col("len") - F.col("size"))).alias("offset", "s"))
    cut = written(cut, "benchmark-shingles")
    keys = cut.select("size", "s").distinct()
    small = keys.count() <= broadcast_limit
    sizes = sorted(r[0] for r in cut.select("size").distinct().collect()) or [SHINGLE]  # SHINGLE values at most

    shingles = _places(docs, window, sizes)
    if small:
        rarity = shingles.join(F.broadcast(keys), ["size", "s"]).groupBy("size", "s").count()
    else:  # counted before they are shuffled
        rarity = shingles.groupBy("size", "s").count().join(keys, ["size", "s"])
    ranked = cut.join(written(rarity, "shingle-counts"), ["size", "s"]).groupBy("wid", "w", "len", "size").agg(
        F.count(F.lit(1)).alias("present"), F.min(F.struct("count", "offset", "s")).alias("first")
    ).filter(F.col("present") == F.col("len") - F.col("size") + 1)  # else a shingle of the window is nowhere
    prefix = written(ranked.select("wid", "w", "len", "size", F.col("first.offset").alias("offset"), F.col("first.s").alias("s")), "prefixes")

    small = prefix.count() <= broadcast_limit  # one for each distinct window, however many items have it
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("_p", F.col("start") - F.col("base") + 1, F.col("len")) == F.col("w")
    if small:
        found = shingles.join(F.broadcast(prefix), ["size", "s"]).filter(fits).withColumn("start", start)
    else:
        found = shingles.select("_k", "n", "pos", "size", "s").join(prefix, ["size", "s"]).filter(fits)
        found = found.select("_k", start.alias("start"), "len", "wid", "w", F.floor(start / STEP).cast("int").alias("piece"))
        found = found.join(pieces(docs, window).drop("n"), ["_k", "piece"])
    return found.filter(same).select("_k", "start", "len", "wid").join(per_item.select("wid", "item_id"), "wid").select("_k", "start", "len", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside windows), items (sorted ids as strings), spans."""
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), text).alias("_k"), text.alias("_text"))
    found = matches(keyed.select("_k", "_text"), benchmark, window)
    per_doc = found.groupBy("_k").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("_spans"),
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )["n"]
    per_doc = per_doc.select("_k", "items", F.col("_spans").alias("spans"), covered.cast("long").alias("n_hit"))
    return (
        keyed.select("doc_id", "_k", n_words(F.col("_text")).alias("n_words"))
        .join(per_doc, "_k", "left")
        .select(
            "doc_id", "_k", "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns."""
    text = F.col(text_col)
    keyed = docs.select(F.struct("*").alias("_row"), row_key(F.col(id_col), text).alias("_k"), text.alias("_text"))
    hit = matches(keyed.select("_k", "_text"), benchmark).select("_k").distinct()
    return keyed.select("_k", "_row").join(hit, "_k", "left_anti").select("_row.*")
