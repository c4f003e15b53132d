"""Maximal periodic runs of words by scale-tiled distribution.

A run is a stretch of words with a smallest period q (words q apart are equal) that no
neighbour extends and that is at least ``EXPONENT`` periods and ``LEAST`` words long. Periods
are taken by octave: d <= q < 2 d for d = 1, 2, 4, ... For each octave a document is cut into
tiles of ``TILE`` words or 16 d, whichever is more, which overlap by 4 d, and every tile is
solved by itself:

- places that are a multiple of d are boundaries; any part of a run that lies in a tile and
  is 2 d long has a boundary b whose next d words recur q further on. Hashes of d words, made
  by doubling, find the boundaries where that may be so;
- there, the Z-function of the words from b on gives for all periods at once how far they hold
  to the right, and the Z-function of the reversed words before b + 2 d how far to the left.
  The first also tells which periods are multiples of a smaller one; these are left out.

A tile yields fragments (document, period, begin, end) of the places i whose word equals that
at i + q. Fragments are shuffled by document and period; those that overlap or touch are
stitched, and what is long enough is a run. Long documents (over ``SPREAD`` characters) send
their tiles to other tasks; of others the tiles are solved where the text is read. Texts are
only shuffled for documents that have fragments.

Defined results: null and empty texts have no words; rows equal in id and text share one
result; null ids are documents like any other; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, row_key, small_batches, written

#: A run has as many periods, and as many words, at least.
EXPONENT, LEAST = 4, 6
#: Words of a tile, besides its overlap.
TILE = 4096
#: Characters of a text beyond which its tiles are spread over tasks.
SPREAD = 2_000_000
#: Words that are solved at once.
TOGETHER = 200_000

_WORD = re.compile(NOT_BLANK)
_U = np.uint64
_GOLD, _C1 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)

Fragment = tuple[int, int, int, int]  # document, period, begin, end
Tile = tuple[int, int, np.ndarray, bool]  # document, number of its first word, words, whether it ends the document


def z_function(s: list[int], n: int) -> list[int]:
    """For each of the first n places how many values from there on equal those from the beginning on; whole length at 0."""
    z = [len(s), *[0] * (min(n, len(s)) - 1)]
    left = right = 0
    for i in range(1, len(z)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tiles(codes: np.ndarray, octave: int, doc: int) -> Iterator[Tile]:
    body, overlap = max(TILE, 16 << octave), 4 << octave
    for begin in range(0, len(codes), body):
        yield doc, begin, codes[begin : begin + body + overlap], begin + body + overlap >= len(codes)
        if begin + body + overlap >= len(codes):
            break


def _recurring(words: np.ndarray, octave: int) -> np.ndarray:
    """A row for each boundary, a column for each period of the octave: whether d words may recur that much further on."""
    d = 1 << octave
    h = words.astype(_U)
    with np.errstate(over="ignore"):
        for k in range(octave):
            h = (h[: -(1 << k)] * _GOLD) ^ (h[1 << k :] + _C1)
            h ^= h >> _U(29)
    rows = (len(h) - d) // d  # boundaries whose d next places have a hash; what is cut off at the end is padded
    tail = len(h) - d - rows * d
    if tail:
        h = np.concatenate((h, np.arange(d - tail, dtype=_U) + _U(1 << 63)))
        rows += 1
    if rows <= 0:
        return np.zeros((0, d), bool)
    return h[d : d + rows * d].reshape(rows, d) == h[: rows * d : d][:, None]


def solve(each: list[Tile], octave: int) -> Iterator[Fragment]:
    """The fragments of tiles of one octave, which stand one behind the other with a word of its own after each."""
    d = 1 << octave
    sizes = np.array([len(t[2]) for t in each])
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(each), np.int64)
    for k, (t, at) in enumerate(zip(each, starts.tolist())):
        words[at : at + len(t[2])] = t[2]
        words[at + len(t[2])] = -1 - k
    again = _recurring(words, octave)
    known, tile, text = np.zeros(0, np.int64), -1, []
    for row in np.flatnonzero(again.any(axis=1)).tolist():
        b = row * d
        k = int(np.searchsorted(starts, b, "right")) - 1
        begin, size = int(starts[k]), int(sizes[k])
        if k != tile:
            known, tile, text = np.full(d, -1), k, each[k][2].tolist()
        b -= begin
        # periods that no fragment covers here yet
        open_periods = np.flatnonzero(again[row] & (known < b + d)) + d
        if not len(open_periods) or b + d > size:
            continue
        right = z_function(text[b:], 2 * d)
        before = text[max(b - d, 0) : b][::-1]
        back = z_function([*before, -1, *text[max(b - d, 0) : b + 2 * d - 1][::-1]], len(before) + 3 * d + 1)
        multiple = np.zeros(2 * d, bool)
        for p in range(1, min(d, len(right))):
            if right[p] >= p:
                multiple[2 * p : min(2 * d, p + right[p] + 1) : p] = True
        after = len(text[b : b + 2 * d - 1])
        for q in open_periods.tolist():
            if q >= len(right) or right[q] < d:
                continue
            at = len(before) + 1 + after - q  # of the reversed words that end at b + q
            left = back[at] if at < len(back) else 0
            known[q - d] = b + right[q]
            if multiple[q]:
                continue
            lo, hi = b - left, b + right[q]
            doc, first, _, last = each[k]
            cut = lo == 0 and first > 0 or hi == size - q and not last
            if cut or hi - lo + q >= max(LEAST, EXPONENT * q):
                yield doc, q, first + lo, first + hi


def octaves(n: int) -> range:
    """Those with a period of which n words can be a run."""
    return range(0, max(n // EXPONENT, 0).bit_length()) if n >= LEAST else range(0)


def fragments(docs: list[np.ndarray]) -> Iterator[Fragment]:
    """Of documents given as codes of words; small ones are solved together."""
    waiting: dict[int, list[Tile]] = {}
    size: dict[int, int] = {}
    for k, codes in enumerate(docs):
        for octave in octaves(len(codes)):
            for tile in tiles(codes, octave, k):
                waiting.setdefault(octave, []).append(tile)
                size[octave] = size.get(octave, 0) + len(tile[2])
                if size[octave] > TOGETHER:
                    yield from solve(waiting.pop(octave), octave)
                    size[octave] = 0
    for octave, left in waiting.items():
        yield from solve(left, octave)


def coded(words: list[str]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


_FRAGMENTS = pa.list_(pa.struct([("q", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
_READ = "_k binary, id {}, n long, sha string, words string, found array<struct<q:long,lo:long,hi:long>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words; what is left of a document without fragments as a digest; else its words and fragments. Long texts come without fragments."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            words = [_WORD.findall(t or "") for t in part.column("text").to_pylist()]
            long = part.column("long").to_pylist()
            found: list[list[dict]] = [[] for _ in words]
            for doc, q, lo, hi in fragments([np.empty(0, np.int64) if skip else coded(w) for w, skip in zip(words, long)]):
                found[doc].append({"q": q, "lo": lo, "hi": hi})
            joined = [" ".join(w) for w in words]
            keep = [bool(f) or skip for f, skip in zip(found, long)]
            columns = [
                part.column("_k"), part.column("id"), pa.array([len(w) for w in words], pa.int64()),
                pa.array([None if k else sha256(j.encode()).hexdigest() for j, k in zip(joined, keep)], pa.string()),
                pa.array([j if k else None for j, k in zip(joined, keep)], pa.string()), pa.array(found, _FRAGMENTS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_k", "id", "n", "sha", "words", "found"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of long texts."""
    for batch in batches:
        for key, words in zip(batch.column("_k").to_pylist(), batch.column("words").to_pylist()):
            codes = coded(words.split(" ") if words else [])
            for octave in octaves(len(codes)):
                for _, first, tile, last in tiles(codes, octave, 0):
                    row = {"_k": key, "octave": octave, "first": first, "last": last, "codes": tile.tobytes()}
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), (pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], list(row))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments of spread tiles."""
    for batch in batches:
        keys, q, lo, hi = [], [], [], []
        for row in batch.to_pylist():
            for _, period, begin, end in solve([(0, row["first"], np.frombuffer(row["codes"], np.int64), row["last"])], row["octave"]):
                keys.append(row["_k"]), q.append(period), lo.append(begin), hi.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(q, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["_k", "q", "lo", "hi"])


def stitched(found: DataFrame) -> DataFrame:
    """(_k, runs: array of (start, length, period) in order) from fragments (_k, q, lo, hi), of which overlapping ones are one."""
    empty = F.array().cast("array<struct<lo:long,hi:long>>")
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))), empty,
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= x["lo"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    whole = found.groupBy("_k", "q").agg(joined.alias("at")).select("_k", "q", F.explode("at").alias("x"))
    run = F.struct(F.col("x.lo").alias("start"), (F.col("x.hi") - F.col("x.lo") + F.col("q")).alias("length"), F.col("q").alias("period"))
    long = whole.select("_k", run.alias("run")).filter(F.col("run.length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("run.period")))
    return long.groupBy("_k").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def without_runs(words: list[str], runs) -> list[str]:
    """The words that no run drops: of each run its first period stays."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def _collapsed(words: pa.Array, runs: pa.Array) -> pa.Array:
    return pa.array([" ".join(without_runs(w.split(" ") if w else [], r or [])) for w, r in zip(words.to_pylist(), runs.to_pylist())], pa.string())


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256), a row for each row.

    ``runs`` are (start, length, period) by start and period. ``collapsed`` are the words left,
    joined by one space, of documents with fragments, and null for others, which lose nothing.
    """
    text = F.col(text_col)
    keyed = docs.select(row_key(F.col(id_col), text).alias("_k"), F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.length(text) > spread, F.lit(False)).alias("long"))
    with small_batches(docs.sparkSession):
        read = written(keyed.mapInArrow(_read, _READ.format(docs.schema[id_col].dataType.simpleString())), "words")
    near = read.filter("size(found) > 0").select("_k", F.inline("found"))
    far = read.filter("words is not null and size(found) = 0").select("_k", "words").mapInArrow(_cut, "_k binary, octave int, first long, last boolean, codes binary")
    far = far.repartition("_k", "octave", "first").mapInArrow(_solved, "_k binary, q long, lo long, hi long")
    runs = stitched(near.unionByName(far))
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    hit = read.filter("words is not null").select("_k", "id", "n", "words").join(runs, "_k", "left")
    hit = hit.select("id", "n", F.coalesce("runs", none).alias("runs"), F.arrow_udf(_collapsed, "string")("words", "runs").alias("collapsed"))
    hit = hit.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "runs", "collapsed", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    rest = read.filter("words is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), none.alias("runs"), F.lit(None).cast("string").alias("collapsed"), F.col("sha").alias("collapsed_sha256"))
    return hit.unionByName(rest)
