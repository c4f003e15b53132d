"""Line dedup by pairwise alignment.

Overlapping documents are found through shared rare hashes. A line of few words is common
and no key by itself; it is joined with its neighbours, once forwards and once backwards,
until the run has ``min_words`` words. Runs are counted over all documents. Consecutive
lines of a document that lie in shared runs are a stretch; each of its lines takes the rarest
shared run that it lies in as its key (of equals the first one), and the key pairs the
stretch with the stretch in which the run's first holder, by id, has it first. So pairs grow
with the shared lines and not with their square, common runs pair documents only where
nothing rarer does, and a pair sends the hashes (of 128 bits) of its two stretches alone.

The two stretches of a pair are aligned by patience diff: lines that are unique in both
anchor the alignment, which then grows to both sides and goes on between anchors. Aligned
blocks, which are consecutive in both documents and have ``min_words`` words at least, are
deleted from the later document; what is left of its stretch is aligned again with the whole
earlier one, until there is no new block, so that blocks that have moved or occur more often
are found as well. Only aligned blocks are deleted: a line of few words stays where the
alignment gives its neighbours to another block.

Defined results: null and empty texts have no lines and stay as they are; blank lines are
neither aligned nor deleted, and do not end a block; white space around a line does not
count; rows equal in id and text are one document and all keep the result of that one; null
ids come after all others; a document all of whose lines were deleted keeps a row with the
empty text; an empty table gives an empty table; further columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, row_key, written

MIN_WORDS = 4
_SOLID = re.compile(NOT_BLANK)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence (pairs are sorted by the first) that rises in the second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tails, b)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[p], at[p] = b, k
    found, k = [], at[-1] if at else -1
    while k >= 0:
        found.append(pairs[k])
        k = back[k]
    return found[::-1]


def _once(lines: list[int]) -> dict:
    """Places of lines that occur once."""
    at: dict[int, int] = {}
    for i, h in enumerate(lines):
        at[h] = -1 if h in at else i
    return {h: i for h, i in at.items() if i >= 0}


def _counted(lines: list[int]) -> dict:
    """Places of (line, how often it has occurred before)."""
    seen: dict[int, int] = {}
    at = {}
    for i, h in enumerate(lines):
        at[h, seen.get(h, 0)] = i
        seen[h] = seen.get(h, 0) + 1
    return at


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i in a, j in b), rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once, twin = _once(a[a0:a1]), _once(b[b0:b1])
        both = once.keys() & twin.keys()
        if not both:  # only lines that recur: the k-th on one side goes with the k-th on the other
            once, twin = _counted(a[a0:a1]), _counted(b[b0:b1])
            both = once.keys() & twin.keys()
        anchors = _longest_rising(sorted((a0 + once[h], b0 + twin[h]) for h in both))
        if not anchors:
            continue
        x, y = a0, b0
        for i, j in anchors:
            todo.append((x, i, y, j))
            found.append((i, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(found)


def align(first: list, at_first: list[int], later: list, at_later: list[int], n_words: list[int], min_words: int) -> list[int]:
    """Line numbers of ``later`` in blocks aligned with ``first``; ``at_...`` are the numbers of the lines."""
    hit: set[int] = set()
    rest = list(range(len(later)))
    while rest:
        found = patience(first, [later[j] for j in rest])
        new: list[int] = []
        block: list[tuple[int, int]] = []
        for i, k in [*found, (-1, -1)]:
            j = rest[k]
            if block and (i < 0 or at_first[i] != at_first[block[-1][0]] + 1 or at_later[j] != at_later[block[-1][1]] + 1):
                if sum(n_words[y] for _, y in block) >= min_words:
                    new += [y for _, y in block]
                block = []
            block.append((i, j))
        if not new:
            break
        hit.update(new)
        known = set(first)
        rest = [j for j in rest if j not in hit and later[j] in known]
    return sorted(at_later[j] for j in hit)


def _aligned(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    key = lambda lines: [(x["h"], x["g"]) for x in lines]
    at = lambda lines: [x["i"] for x in lines]
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            found = [
                align(key(a), at(a), key(b), at(b), [x["w"] for x in b], min_words)
                for a, b in zip(part.column("first_lines").to_pylist(), part.column("lines").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([part.column("_k"), pa.array(found, pa.list_(pa.int32()))], ["_k", "hit"])


_HASH = "struct<h:bigint,g:bigint>"
_LINE = "struct<i:int,h:bigint,g:bigint,w:int>"
_STRETCH = f"_k binary, at int, lines array<{_LINE}>, keys array<{_HASH}>, firsts array<{_HASH}>"


def stretches_of(runs: list[dict], key: bytes) -> Iterator[dict]:
    """Stretches of one document's shared runs (run: lines, h, g, n: how often it stands anywhere, first: who has it first).

    ``keys`` are the runs that pair the stretch with earlier documents, ``firsts`` those that later ones find here.
    """
    lines: dict[int, dict] = {}
    rarest: dict[int, dict] = {}
    runs = sorted(runs, key=lambda r: (r["n"], r["run"][0]["i"], len(r["run"]), r["h"], r["g"]))
    for r in runs:
        for x in r["run"]:
            lines[x["i"]] = x
            rarest.setdefault(x["i"], r)
    first_at: dict[tuple[int, int], int] = {}
    for r in runs:
        if r["first"] == key:
            name, at = (r["h"], r["g"]), r["run"][0]["i"]
            first_at[name] = min(at, first_at.get(name, at))
    here: dict[int, list[dict]] = {}
    for (h, g), at in first_at.items():
        here.setdefault(at, []).append({"h": h, "g": g})
    order = sorted(lines)
    begin = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or order[k] != order[k - 1] + 1:
            own = order[begin:k]
            keys = {(r["h"], r["g"]) for r in map(rarest.__getitem__, own) if r["first"] != key}
            yield {
                "_k": key, "at": own[0], "lines": [lines[i] for i in own],
                "keys": [{"h": h, "g": g} for h, g in sorted(keys)], "firsts": [x for i in own for x in here.get(i, ())],
            }
            begin = k


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64())]))
    line = pa.struct([("i", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("w", pa.int32())])
    schema = pa.schema([("_k", pa.binary()), ("at", pa.int32()), ("lines", pa.list_(line)), ("keys", hashes), ("firsts", hashes)])
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            rows = zip(part.column("_k").to_pylist(), part.column("runs").to_pylist())
            yield pa.RecordBatch.from_pylist([s for key, runs in rows for s in stretches_of(runs, key)], schema)


def _order(doc_id: Column, key: Column) -> Column:
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), key.alias("k"))


def _runs_of(lines: Column, min_words: int) -> Column:
    """Of an array of lines (i, h, g, w) the shortest runs with enough words that begin or end at each, as arrays."""
    w = lambda i: F.get(lines, i)["w"]

    def size(i, step):
        total, case = w(i), F.when(w(i) >= min_words, 1)
        for m in range(1, min_words):
            total = total + F.when((i + step * m) >= 0, w(i + step * m))
            case = case.when(total >= min_words, m + 1)
        return F.coalesce(case, F.lit(0))

    long = F.transform(F.filter(lines, lambda x: x["w"] >= min_words), lambda x: F.array(x))
    short = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: w(i) < min_words)
    forwards = F.transform(short, lambda i: F.slice(lines, i + 1, size(i, 1)))
    backwards = F.transform(short, lambda i: F.slice(lines, i + 2 - F.greatest(size(i, -1), F.lit(1)), size(i, -1)))
    joined = F.filter(F.concat(forwards, backwards), lambda r: F.size(r) > 0)
    # a line with enough words is a run by itself; most texts have no others
    return F.when(F.exists(lines, lambda x: x["w"] < min_words), F.concat(long, joined)).otherwise(long)


def shared_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_k, hit: numbers among the non-blank lines, to be deleted) for rows (_k, _order, _text)."""
    solid = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), lambda x: x.rlike(NOT_BLANK))
    bare = F.transform(solid, lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")))
    hashed = F.transform(bare, lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(NOT_BLANK)).alias("w")))
    lines = docs.select("_k", "_order", hashed.alias("_lines")).filter(F.size("_lines") > 0)
    lines = lines.select("_k", "_order", F.explode(_runs_of(F.col("_lines"), min_words)).alias("run"))
    keys, one = F.transform("run", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))), F.size("run") == 1
    each = lines.select(
        "_k", "_order", "run", F.when(one, F.col("run")[0]["h"]).otherwise(F.xxhash64(keys)).alias("h"), F.when(one, F.col("run")[0]["g"]).otherwise(F.xxhash64(F.lit(1), keys)).alias("g")
    )
    each = written(each, "runs")
    # a run's first holder, where it has others; reduced before the shuffle, and read from a table, so that a run with many holders can be split
    first = each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("first"), F.max("_order").alias("last")).filter("first <> last")
    first = written(first.select("h", "g", "n", F.col("first.k").alias("first")), "first-holders")
    shared = written(each.select("_k", "run", "h", "g").join(first, ["h", "g"]), "shared-runs")
    found = shared.groupBy("_k").agg(F.collect_set(F.struct("run", "h", "g", "n", "first")).alias("runs"))
    stretches = written(found.mapInArrow(_stretches, _STRETCH), "stretches")
    earlier = stretches.select(F.col("_k").alias("_first"), F.col("at").alias("first_at"), F.explode("firsts").alias("key"))
    later = stretches.select("_k", "at", F.explode("keys").alias("key"))
    pairs = written(later.join(earlier, "key").select("_k", "at", "_first", "first_at").distinct(), "pairs")
    sides = pairs.join(stretches.select("_k", "at", "lines"), ["_k", "at"]).join(
        stretches.select(F.col("_k").alias("_first"), F.col("at").alias("first_at"), F.col("lines").alias("first_lines")), ["_first", "first_at"]
    )
    hits = sides.select("_k", "lines", "first_lines").mapInArrow(partial(_aligned, min_words=min_words), "_k binary, hit array<int>").filter(F.size("hit") > 0)
    return written(hits.groupBy("_k").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit")), "deleted-lines")


def without_lines(text: str, hit) -> str:
    """The text without the non-blank lines of these numbers."""
    gone, kept, n = set(hit), [], 0
    for line in text.split("\n"):
        if _SOLID.search(line):
            n += 1
            if n - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept) if any(map(_SOLID.search, kept)) else ""


def _without(text: pa.Array, hit: pa.Array) -> pa.Array:
    return pa.array([None if t is None else without_lines(t, h) for t, h in zip(text.to_pylist(), hit.to_pylist())], pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, info: str | None = None) -> DataFrame:
    """``docs`` with the deleted blocks gone from the text; ``info`` names a further column, the number of deleted lines."""
    key = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_k"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hit = shared_lines(keyed.select("_k", _order(F.col("_id"), F.col("_k")).alias("_order"), "_text"), min_words)
    joined = keyed.select("_k", "_row").join(hit, "_k", "left")
    text = F.col(f"_row.{text_col}")
    # only changed texts go through Python
    new = F.when(F.col("hit").isNull(), text).otherwise(F.arrow_udf(_without, "string")(F.when(F.col("hit").isNotNull(), text), F.col("hit")))
    columns = [new.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    if info:
        columns.append(F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias(info))
    return joined.select(*columns)
