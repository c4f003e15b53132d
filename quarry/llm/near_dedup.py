"""Near-duplicate classes by DartMinHash.

A text is the multiset of its 5-word shingles. Each unit of a shingle's weight is a region
into which darts are thrown by hashing: their ranks are the arrivals of a Poisson process
that depends on the region alone, so texts that share the region share its darts. Every
coordinate of the signature keeps the dart of least rank; two signatures agree in a
coordinate with the probability of the texts' weighted Jaccard similarity. About
K ln K + 2 K darts are thrown for a text of any length, so signatures are fast to make.

Signatures are cut into bands; texts with an equal band share a bucket. Copies of a text
are one node from the start. Buckets are never expanded into all pairs: in each round a
bucket's members are compared with its pivots (one, then four times as many each round, each
the least of its share of the members), links merge classes, and buckets that lie within one
class are done. Pairs whose signatures leave no doubt are decided by them; the others by
their exact similarity. What one round leaves open (texts that share much but
not enough, such as a long passage) goes through an exact prefix join: only the rarest
shingles, one of which any similar pair must share, make buckets, and rounds go on until
no bucket holds untested members of two classes; of texts that are not similar only those
with a rare shingle in common, or with little but common ones, are compared. No bucket is
capped. A similar pair is missed only if its signatures agree in no band and it shares no
bucket with others of its class, or by the bounds of ``LOW`` and ``HIGH``.

Defined results: null and empty texts are equal texts and one class; a text of fewer than
five words is one shingle; texts without words are only copies of equal texts; null ids
come last in a class; rows equal in id and text are one document, of which ``keep_one``
keeps the row that is least by its further columns as JSON; these pass through it; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RAW_WORD, row_key, small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 30
COORDINATES = ROWS * BANDS
#: Of signatures of 150 coordinates: fewer agreements than LOW are under 0.8, more than HIGH over it
#: (a pair at 0.8 gets there with a probability of 1e-13 and 2e-12); between them shingles are compared.
LOW, HIGH = 80, 147
#: Rounds with buckets of bands before the exact prefix join takes over.
BAND_ROUNDS = 1
#: Shingles of more open texts than this are common: texts that share no other must consist of common ones.
COMMON = 64
#: Of a text's rarest shingles so many tell whether two have met in another bucket.
RARER = 24

_U = np.uint64
_GOLD, _C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_PLACES = np.array([2 * k + 1 for k in range(SHINGLE)], dtype=_U) * _GOLD | _U(1)
_WORD = re.compile(RAW_WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Words' hashes, kept for the next text; emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 60_000:
            self.clear()
        # the same for ASCII words, and faster
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower() if word.isascii() else word.translate(_LOWER))
        return value


_HASHES = _Hashes()


def word_list(text: str | None) -> list[str]:
    """Words as they stand; their hashes do not see the case of A-Z."""
    return _WORD.findall(text or "")


def word_hashes(text: str | None) -> np.ndarray:
    words = word_list(text)
    return np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))


def units(w: np.ndarray) -> np.ndarray:
    """One hash for each unit of weight, from the hashes of words: a shingle that occurs c times has c of them."""
    if not len(w):
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        if len(w) < SHINGLE:
            shingles = _mix((w * _PLACES[: len(w)]).sum(keepdims=True, dtype=_U) + _U(len(w)))
        else:
            n = len(w) - SHINGLE + 1
            shingles = w[:n] * _PLACES[0]
            for k in range(1, SHINGLE):
                shingles += w[k : k + n] * _PLACES[k]
            shingles = _mix(shingles)
        shingles.sort()
        again = shingles[1:] == shingles[:-1]
        if not again.any():
            return shingles
        starts = np.flatnonzero(np.concatenate(([True], ~again)))
        copy = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
        return np.sort(np.where(copy == 0, shingles, _mix(shingles + copy.astype(_U) * _GOLD)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def darts(regions: np.ndarray, of: np.ndarray, n: int, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """Signatures of n texts at once: for each coordinate 32 bits of the dart of least rank.

    ``regions`` are hashes of units of weight and ``of`` the texts (0 to n - 1) that have
    them; ``weights`` (0 to 1 each, default 1) leaves only a part of a unit, for weights
    that aren't whole numbers. Every text has a unit at least.
    """
    total = np.bincount(of, weights, n)
    reach = (k * math.log(k) + 2 * k) / total
    found = np.zeros((n, k), np.uint32)
    todo = np.ones(n, bool)
    while todo.any():
        ranks, names, texts = [], [], []
        on = todo[of]
        key, text, part = regions[on], of[on], None if weights is None else weights[on]
        rank, end = np.zeros(len(key)), reach[text]
        throw = 0
        with np.errstate(over="ignore"):
            while len(key):
                throw += 1
                h = _mix(key + _U(throw) * _C1)
                rank = rank - np.log(_uniform(h))
                inside = rank < end
                key, rank, text, end = key[inside], rank[inside], text[inside], end[inside]
                name = _mix(h[inside] + _GOLD)
                if part is None:
                    hit = slice(None)
                else:
                    part = part[inside]
                    hit = _uniform(_mix(name ^ _C2)) < part
                ranks.append(rank[hit])
                names.append(name[hit])
                texts.append(text[hit])
            rank, name, text = np.concatenate(ranks), np.concatenate(names), np.concatenate(texts)
            cell = text.astype(_U) * _U(k) + (name >> _U(32)) % _U(k)
            # cell and rank in one number: 20 bits for the cells, 44 for ranks of up to 2^12
            order = np.argsort(cell << _U(44) | (np.minimum(rank, 4095.0) * 4294967296.0).astype(_U))
        cell = cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, int)
        cells = cell[first].astype(np.int64)
        full = np.bincount(cells // k, minlength=n) == k
        found.reshape(-1)[cells] = (name[order][first] & _U(0xFFFFFFFF)).astype(np.uint32)
        todo &= ~full
        reach = np.where(todo, reach * 2, reach)  # a coordinate without a dart: throw further
    return found


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    with np.errstate(over="ignore"):
        rows = signature.astype(_U).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=_U)
        for c in range(ROWS):
            key = _mix(key * _GOLD + rows[:, c])
        return key


#: Texts, and units of weight, whose signatures are made at once: more is not faster, and takes more memory. Their cells fit in 20 bits.
TOGETHER, UNITS = 128, 60_000


def _signatures(each: list[np.ndarray]) -> list[np.ndarray]:
    """A signature for each text, empty for texts without units."""
    made = [np.empty(0, np.int32)] * len(each)
    todo = [i for i, u in enumerate(each) if len(u)]
    while todo:
        part, size = [], 0
        while todo and len(part) < TOGETHER and (not part or size + len(each[todo[-1]]) <= UNITS):
            i = todo.pop()
            part.append(i)
            size += len(each[i])
        of = np.repeat(np.arange(len(part)), [len(each[i]) for i in part])
        for i, sig in zip(part, darts(np.concatenate([each[i] for i in part]), of, len(part))):
            made[i] = sig.view(np.int32)
    return made


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text: 128 bits that its copies share (of its words), number of units, signature (empty without words)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(begin, TOGETHER)
            copies, each = [], []
            for text in part.column("_text").to_pylist():
                w = word_hashes(text)
                exact = w.tobytes() if len(w) else b"\x00" + (text or "").encode()
                copies.append(hashlib.md5(exact).digest())
                each.append(units(w))
            signatures = _signatures(each)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in signatures]))).astype(np.int32)
            flat = pa.array(np.concatenate(signatures) if signatures else np.empty(0, np.int32), pa.int32())
            sizes = pa.array([len(u) for u in each], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("_k", "_none", "_id")), pa.array(copies, pa.binary()), sizes, pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["_k", "_none", "_id", "copy", "n", "sig"],
            )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = batch.column("sig")
        keys = [bands(np.asarray(s.values).view(np.uint32)).view(np.int64) for s in sig]
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat), pa.array(np.repeat(np.asarray(batch.column("node")), BANDS)), pa.array(np.repeat(np.asarray(batch.column("n")), BANDS))],
            ["key", "node", "n"],
        )


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(begin, TOGETHER)
            found = [units(word_hashes(t)).view(np.int64) for t in part.column("_text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(u) for u in found]))).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "units"])


def components(edges: DataFrame) -> DataFrame:
    """(node, cls: smallest node connected with it) of the nodes of ``edges`` (a, b).

    Each round every node takes the smallest label around it, then the label of its label,
    so that long chains halve; nothing is gathered but a count of changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("cls")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("cls").alias("m"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "cls", F.least("cls", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("cls").alias("far"))
        new = written(nearer.join(jump, "m").select("node", F.col("cls").alias("old"), F.least("m", "far").alias("cls")), "labels")
        labels = new.select("node", "cls")
        if new.filter("cls <> old").limit(1).count() == 0:
            return labels


def _agreements(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def similar(pairs: DataFrame, sketches: DataFrame, exact: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""
    side = lambda df, n, c: df.select(F.col("node").alias(n), F.col(c).alias(f"{n}_{c}"))
    counted = pairs.join(side(sketches, "a", "sig"), "a").join(side(sketches, "b", "sig"), "b").select("a", "b", _agreements(F.col("a_sig"), F.col("b_sig")).alias("same")).filter(F.col("same") >= LOW)
    counted = written(counted, "agreements")
    open_pairs = counted.filter(F.col("same") <= HIGH).join(side(exact, "a", "units"), "a").join(side(exact, "b", "units"), "b")
    shared = F.size(F.array_intersect("a_units", "b_units"))
    checked = open_pairs.filter(shared >= SIMILARITY * (F.size("a_units") + F.size("b_units") - shared))
    return counted.filter(F.col("same") > HIGH).select("a", "b").unionByName(checked.select("a", "b"))


def _rounds(members: DataFrame, classes: DataFrame | None, sketches: DataFrame, exact: DataFrame, most: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Compares members of buckets (key, node, n, most, rarer) with pivots. Returns (classes, members of open buckets).

    ``n`` is a text's number of units, ``most`` how many of them it can share with others through this bucket.
    """
    pivots = 1
    turn = 0
    while most is None or turn < most:
        turn += 1
        live = members if classes is None else members.join(classes, "node", "left")
        live = live.withColumn("cls", F.col("node") if classes is None else F.coalesce("cls", "node"))
        # as many pivots as there are salts, each the least of its share of the bucket
        mixed = live.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("key")
        live = written(live.join(mixed, "key").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(pivots))), "open-buckets")
        heads = live.groupBy("key", "salt").agg(F.min(F.struct("node", "n", "most", "cls", "rarer")).alias("p")).select(
            "key", F.col("p.node").alias("a"), F.col("p.n").alias("na"), F.col("p.most").alias("ma"), F.col("p.cls").alias("ca"), F.col("p.rarer").alias("ra")
        )
        # units that similar texts must share, against those that these two can share at most;
        # two that share a rarer shingle meet in its bucket, and need not meet here
        met = live.join(heads, "key").filter(
            (F.col("cls") != F.col("ca")) & ~F.arrays_overlap("rarer", "ra") & (F.least("most", "ma") * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + F.col("na")) - 1e-6)
        ).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        links = written(similar(met, sketches, exact), "links")
        if links.limit(1).count():
            named = links if classes is None else (
                links.join(classes.select(F.col("node").alias("a"), F.col("cls").alias("x")), "a", "left")
                .join(classes.select(F.col("node").alias("b"), F.col("cls").alias("y")), "b", "left")
                .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            )
            merged = components(named)
            if classes is None:
                classes = merged
            else:
                to = merged.select(F.col("node").alias("cls"), F.col("cls").alias("to"))
                moved = classes.join(to, "cls", "left").select("node", F.coalesce("to", "cls").alias("cls"))
                new = merged.join(classes, "node", "left_anti").select("node", "cls")
                classes = written(moved.unionByName(new), "classes")
        members = written(live.join(heads.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n", "most", "rarer"), "members")
        if not members.limit(1).count():
            return classes, None
        pivots *= 4
    return classes, members


def _prefixes(nodes: DataFrame, exact: DataFrame) -> DataFrame:
    """Buckets (key: a shingle, node, n, most, rarer: a text's rarest shingles before this one) of the rarest shingles.

    The rarest shingle that a similar pair shares is among the rarest of both. If it is a
    common one, the pair shares common ones only, so a text of which too little is common
    has no partner in that bucket.
    """
    each = exact.join(nodes, "node", "left_semi").select("node", F.size("units").alias("n"), F.explode("units").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(common, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"))
    need = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    n_common = F.size(F.filter("order", lambda o: o["df"] > COMMON))
    prefix = ranked.select(
        "node", "n", n_common.alias("c"), F.transform(F.slice("order", F.lit(1), F.lit(RARER)), lambda o: o["key"]).alias("first"),
        F.posexplode(F.slice("order", F.lit(1), need.cast("int"))).alias("at", "o"),
    ).filter("o.df > 1")
    most = F.when(F.col("o.df") > COMMON, F.col("c")).otherwise(F.col("n"))
    rarer = F.slice("first", F.lit(1), F.least("at", F.lit(RARER)))
    return prefix.select(F.col("o.key").alias("key"), "node", "n", most.alias("most"), rarer.alias("rarer")).filter(F.col("most") >= SIMILARITY * F.col("n") - 1e-6)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, doc_id, node, first: the (none, id, k) of the class's first document), a row for each row."""
    text = F.col(text_col)
    keyed = docs.select(
        row_key(F.col(id_col), text).alias("_k"), F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), text.alias("_text")
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession):
        sketched = written(keyed.mapInArrow(_sketches, f"_k binary, _none boolean, _id {id_type}, copy binary, n int, sig array<int>"), "sketches")
    nodes = written(
        # copies are one node, whose number is fixed when the table is written
        sketched.groupBy("copy").agg(
            F.min(F.struct(F.col("_none").alias("none"), F.col("_id").alias("id"), F.col("_k").alias("k"))).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig")
        ).withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    banded = nodes.filter("n > 0").select("node", "n", "sig").mapInArrow(_banded, "key long, node long, n int")
    full = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    members = written(banded.join(full, "key").withColumns({"most": F.col("n"), "rarer": F.array().cast("array<bigint>")}), "members")
    linked = members.select("node").distinct()
    chosen = written(nodes.join(linked, "node", "left_semi").select("node", "sig", F.col("first.k").alias("_k")), "chosen")
    texts = keyed.select("_k", "_text").join(chosen.select("_k", "node"), "_k").dropDuplicates(["_k"]).select("node", "_text")
    with small_batches(docs.sparkSession):
        exact = written(texts.mapInArrow(_unit_rows, "node long, units array<long>"), "units")
    sketches = chosen.select("node", "sig")
    found, rest = _rounds(members, None, sketches, exact, BAND_ROUNDS)
    if rest is not None:
        open_nodes = rest.select("node").distinct()
        found, _ = _rounds(written(_prefixes(open_nodes, exact), "prefixes"), found, sketches, exact, None)
    slim = nodes.select("node", "copy", "first")
    if found is not None:
        named = slim.join(found, "node", "left").select("node", "copy", "first", F.coalesce("cls", "node").alias("cls"))
        heads = named.groupBy("cls").agg(F.min("first").alias("head"))
        slim = named.join(heads, "cls").select("node", "copy", F.col("head").alias("first"))
    # read from a table, so that a text with many copies can be split
    return sketched.select("_k", F.col("_id").alias("doc_id"), "copy").join(written(slim, "first-of-class"), "copy").drop("copy")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, first): the class is named by the smallest id in it; ``first`` marks that document."""
    found = classes(docs, id_col, text_col)
    return found.select("doc_id", F.col("first.id").alias("class_id"), (F.col("first.k") == F.col("_k")).alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the first document of each class."""
    keep = classes(docs, id_col, text_col).filter(F.col("first.k") == F.col("_k")).select("_k").distinct()
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.struct("*").alias("_row"), F.to_json(F.struct(*rest)).alias("_order"))
    return keyed.join(keep, "_k", "left_semi").groupBy("_k").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
