"""Removal of byte strings that an earlier document has too, by threshold-bounded interval expansion.

A byte goes if a string of ``min_length`` bytes that covers it also starts in a document with
a smaller id. Equal strings have to meet, so they are dealt out by what they hold: every
window of ``min_length`` bytes has a minimizer, the ``gram``-byte string in it of least hash;
consecutive windows with one minimizer are a stretch. Steps:

1. documents are dealt once into groups by a hash of their key; a group is read as a unit, so
   that its stretches always come in the same order;
2. each group posts the distinct minimizers of its stretches to buckets of hashes, five bytes
   each; a bucket answers with one bit for each: whether any other document has it;
3. each group posts the distinct stretches of shared minimizers, with the smallest id that has
   them, to the same buckets. A bucket sorts the suffixes of its stretches by their first
   ``min_length`` bytes and derives the Burrows-Wheeler transform. Breadth-first backward
   extension of intervals, from the empty string on, gives the places in that order where
   common prefixes have the length 0, then 1, and so on, and stops at ``min_length``: between
   the places found, suffixes share a whole window. The answer is one bit for each window:
   whether a document with a smaller id than the group's own has it;
4. each group marks the bytes of removed windows and cuts them out.

Copies cost little: a group posts equal stretches once, and the bucket compares distinct ones
alone. A minimizer that more than ``HOT`` groups have (a phrase that a large part of all
documents holds, within texts that differ) does not gather its stretches in one bucket: they
are dealt as single windows by the window's own hash. Nothing is capped. The documents are
shuffled once; the three steps that read them share that exchange.

Defined results: null and empty texts have no bytes and lose none; texts shorter than
``min_length`` lose none; ids are whole numbers, null counts as larger than all others and
nulls as equal; rows with equal ids do not touch each other; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key

MIN_LENGTH = 50
GRAM = 24
#: Bytes of text of a group and of a bucket, about. There are twice as many groups, and as many buckets, as partitions of a
#: shuffle at least; what groups and buckets exchange is a row for each two of them, which should be long.
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 64 << 20
#: Groups that have a minimizer, beyond which its stretches are dealt as single windows.
HOT = 2_000
#: Bytes of stretches whose suffixes are sorted at once.
SORTED = 1 << 20
#: Bytes that are hashed at once; places in them fit in the low bits of a key.
PIECE_BITS = 20

_U = np.uint64
_GOLD, _C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
LAST = 2**63 - 1
POST = "grp long, bucket long, data binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes that begin at each of the first n places, as one number in the order of the bytes; zeros stand past the end."""
    padded = np.zeros(n + 8, np.uint8)
    padded[: min(len(data), n + 8)] = data[: n + 8]
    four = np.lib.stride_tricks.as_strided(padded, (n + 4, 4), (1, 1))
    half = np.ascontiguousarray(four).view(">u4").ravel().astype(_U)
    return half[:n] << _U(32) | half[4 : n + 4]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes (8 at least)."""
    n = len(data) - size + 1
    word = _words(data, len(data) - 7)
    with np.errstate(over="ignore"):
        h = word[:n] * _GOLD
        for at in [*range(8, size - 7, 8), size - 8][: (size - 1) // 8]:
            h ^= h >> _U(29)
            h += word[at : at + n]
            h *= _C1
        return h ^ (h >> _U(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - width + have], x[width - have :]) if have < width else x


def stretches(data: np.ndarray, ends: np.ndarray, min_length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, hash of the minimizer) of texts that stand one behind the other in ``data``."""
    found = []
    step = (1 << PIECE_BITS) - min_length
    low = _U((1 << PIECE_BITS) - 1)
    for begin in range(0, max(len(data) - min_length + 1, 0), step):
        piece = data[begin : begin + step + min_length - 1]
        n = len(piece) - min_length + 1
        h = _grams(piece, gram)
        least = _least((h & ~low) | np.arange(len(h), dtype=_U), min_length - gram + 1)[:n] & low
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        # windows lie within documents: stretches end where a document's last window does
        first = np.searchsorted(ends, begin, "right")
        inner = ends[first : np.searchsorted(ends, begin + n, "left") + 1] - begin
        cuts = np.concatenate((inner, inner - min_length + 1))
        starts = np.unique(np.concatenate((starts, cuts[(cuts > 0) & (cuts < n)])))
        count = np.diff(np.append(starts, n))
        doc = np.searchsorted(ends, starts + begin, "right")
        whole = starts + begin + min_length <= ends[doc]
        found.append((doc[whole], starts[whole] + begin, count[whole], h[least[starts[whole]].astype(np.int64)]))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U))
    return tuple(map(np.concatenate, zip(*found)))


class Group:
    """The documents of a group in a fixed order, with their stretches and the distinct hashes of these."""

    def __init__(self, table: pa.Table, min_length: int, gram: int, buckets: int):
        rows = sorted(zip(table.column("k").to_pylist(), table.column("id").to_pylist(), table.column("text").to_pylist()), key=lambda r: r[0])
        self.ids = [r[1] for r in rows]
        order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        texts = [(r[2] or "").encode() for r in rows]
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.doc, self.begin, self.count, h = stretches(self.data, self.ends, min_length, gram)
        self.order = order
        with np.errstate(over="ignore"):
            value = _mix(h + _GOLD)
        #: bucket and 40 bits of the hash; the distinct ones in order, with whether documents with two ids have them
        self.value = (value >> _U(40)) % _U(buckets) << _U(40) | value & _U((1 << 40) - 1)
        self.distinct, self.of = np.unique(self.value, return_inverse=True)
        least, most = np.full(len(self.distinct), LAST), np.full(len(self.distinct), -LAST - 1)
        np.minimum.at(least, self.of, order[self.doc])
        np.maximum.at(most, self.of, order[self.doc])
        self.several = least < most

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, begin, end) of the distinct hashes."""
        bucket = (self.distinct >> _U(40)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, int)
        for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]):
            yield int(bucket[b]), b, e


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes, n: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, n * 5, at).reshape(n, 5)
    return out.view("<u8").ravel()


def _bits(marks: np.ndarray) -> bytes:
    return np.packbits(marks).tobytes()


def _from_bits(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones and so on: small numbers then compress well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def _posts(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    group, bucket, data = zip(*rows) if rows else ((), (), ())
    return pa.table({"grp": pa.array(group, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


def _post_hashes(key, docs: pa.Table, **how) -> pa.Table:
    """The distinct hashes of a group: their number, a bit for each (two documents here have it), 40 bits of each."""
    group, number = Group(docs, **how), key[0].as_py()
    return _posts([(number, k, _bits(group.several[b:e]) + _five(group.distinct[b:e])) for k, b, e in group.by_bucket()])


def _answer_hashes(key, posts: pa.Table, hot: int) -> pa.Table:
    """For each group's hashes: a bit for those that two documents have, a bit for those that many groups have."""
    groups, data = posts.column("grp").to_pylist(), posts.column("data").to_pylist()
    sizes = [len(d) * 8 // 41 for d in data]  # n hashes take 5 n bytes and n bits
    values = np.concatenate([_from_five(d, n, (n + 7) // 8) for d, n in zip(data, sizes)])
    several = np.concatenate([_from_bits(d, n) for d, n in zip(data, sizes)])
    _, of, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[of[several]] = True
    shared, often = shared[of], (count > hot)[of]
    rows, at, number = [], 0, key[0].as_py()
    for g, n in zip(groups, sizes):
        rows.append((g, number, _bits(shared[at : at + n]) + _bits(often[at : at + n])))
        at += n
    return _posts(rows)


def _post_stretches(key, docs: pa.Table, answers: pa.Table, min_length: int, buckets: int, **how) -> pa.Table:
    """A group's distinct stretches of shared minimizers, and who has them, which comes back with the answers.

    For a bucket: number, smallest ids, numbers of windows, 16 bits of the minimizers, texts.
    """
    if not docs.num_rows:
        return _posts([])
    group, number = Group(docs, min_length=min_length, buckets=buckets, **how), key[0].as_py()
    answered = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist()))
    shared, often = np.zeros(len(group.distinct), bool), np.zeros(len(group.distinct), bool)
    for k, b, e in group.by_bucket():
        shared[b:e], often[b:e] = _from_bits(answered[k], e - b), _from_bits(answered[k], e - b, (e - b + 7) // 8)
    on = shared[group.of]
    value, doc, begin, count = group.value[on], group.doc[on], group.begin[on], group.count[on]
    single = often[group.of[on]]
    whole = group.data.tobytes()
    if single.any():  # as many stretches of one window as there are windows
        each = np.where(single, count, 1)
        first = np.repeat(np.cumsum(each) - each, each)
        begin = np.repeat(begin, each) + (np.arange(len(first)) - first)
        doc, single, value = np.repeat(doc, each), np.repeat(single, each), np.repeat(value, each)
        count = np.where(single, 1, np.repeat(count, each))
        for x in np.flatnonzero(single).tolist():
            h = xxhash.xxh3_64_intdigest(whole[begin[x] : begin[x] + min_length])
            value[x] = ((h >> 40) % buckets) << 40 | h & ((1 << 40) - 1)
    place: dict[bytes, int] = {}
    texts = [whole[b:e] for b, e in zip(begin.tolist(), (begin + count + min_length - 1).tolist())]
    of = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(texts))
    least = np.full(len(place), LAST)
    np.minimum.at(least, of, group.order[doc])
    where = np.empty(len(place), np.int64)
    where[of] = np.arange(len(of))
    # the stretches in the order in which they are posted: by bucket
    posted = np.argsort(value[where], kind="stable")
    rank = np.empty(len(posted), np.int64)
    rank[posted] = np.arange(len(posted))
    value, size, least, text = value[where][posted], count[where][posted], least[posted], list(place)
    bucket = (value >> _U(40)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, int)
    rows = []
    for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]):
        head = np.int64(e - b).tobytes() + _planes(least[b:e]) + size[b:e].astype("<u4").tobytes() + value[b:e].astype("<u2").tobytes()
        rows.append((number, int(bucket[b]), head + pa.compress(b"".join(text[x] for x in posted[b:e].tolist()), "zstd", asbytes=True)))
    # by document and place, as distances
    order = np.lexsort((begin, doc))
    holders = np.array([len(of), len(size)], np.int64).tobytes() + size.astype("<u4").tobytes()
    for values in (rank[of][order], np.diff(doc[order], prepend=0), np.diff(begin[order], prepend=0)):
        holders += _planes(values)
    rows.append((number, buckets + number, holders))
    return _posts(rows)


def sorted_suffixes(data: np.ndarray, length: int) -> np.ndarray:
    """The places of ``data`` in the order of the ``length`` bytes (or more) that begin there."""
    key = _words(data, len(data))
    have = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate(([False], ranked[1:] != ranked[:-1]))
        if have >= length or new[1:].all():
            return order
        rank = np.empty(len(data), _U)
        rank[order] = np.cumsum(new).astype(_U)
        after = np.zeros(len(data), _U)
        after[:-have] = rank[have:] + _U(1)
        key = rank << _U(32) | after
        have *= 2


def short_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """Marks the places of a suffix order whose suffix shares less than ``length`` bytes with the one before.

    Intervals of the order are those of a string; the characters before its suffixes extend
    it backwards. All strings of one length are extended at once. An interval that ends at a
    new place has a common prefix there of just the length so far; others need no extension.
    """
    n = len(bwt)
    by_char = np.argsort(bwt, kind="stable").astype(np.int64)
    back = np.empty(n, np.int64)
    back[by_char] = np.arange(n)  # the place of the suffix that begins one character before
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[by_char[1:][same]] = by_char[:-1][same]
    following[by_char[:-1][same]] = by_char[1:][same]
    marks = np.zeros(n + 1, bool)
    marks[0] = marks[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        width = hi - lo
        first = np.repeat(lo, width)
        at = first + (np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width))
        begins = back[at[previous[at] < first]]
        ends = back[at[following[at] >= np.repeat(hi, width)]] + 1
        begins.sort()
        ends.sort()  # intervals of different strings do not overlap: the k-th begins and ends belong together
        new = ~marks[ends]
        lo, hi = begins[new], ends[new]
        if not len(lo):
            break
        marks[hi] = True
    return marks[:n]


def _first_ids(texts: list[bytes], ids: np.ndarray, min_length: int) -> list[np.ndarray]:
    """For each window of the distinct ``texts`` the smallest id of the texts that hold it."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that stands in no UTF-8 text
    begins = np.cumsum(sizes + 1) - sizes
    order = sorted_suffixes(data, min_length)
    marks = short_prefixes(data[order - 1], min_length)
    windows = sizes - min_length + 1
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.full(len(data), LAST)
    places = np.repeat(begins, windows) + offset
    owner[places] = np.repeat(ids, windows)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(marks))
    found = np.empty(len(data), np.int64)
    found[order] = least[np.cumsum(marks) - 1]
    return np.split(found[places], np.cumsum(windows)[:-1])


def _shared_out(texts: list[bytes], ids: np.ndarray, min_length: int) -> list[np.ndarray]:
    """``_first_ids`` in bounded memory: very many stretches of one minimizer are cut into windows, in shares by their hashes."""
    shares = sum(map(len, texts)) // (8 * SORTED) * min_length
    if not shares:
        return _first_ids(texts, ids, min_length)
    found = [np.empty(len(t) - min_length + 1, np.int64) for t in texts]
    parts: list[dict[bytes, list[tuple[int, int]]]] = [{} for _ in range(shares)]
    for x, t in enumerate(texts):
        for at in range(len(t) - min_length + 1):
            window = t[at : at + min_length]
            parts[xxhash.xxh3_64_intdigest(window) % shares].setdefault(window, []).append((x, at))
    for part in filter(None, parts):
        least = np.array([min(ids[x] for x, _ in places) for places in part.values()], np.int64)
        for places, first in zip(part.values(), _first_ids(list(part), least, min_length)):
            for x, at in places:
                found[x][at] = first[0]
    return found


def _answer_stretches(key, posts: pa.Table, min_length: int, buckets: int) -> pa.Table:
    """The number of windows of a group's stretches, and a bit for each: whether a smaller id than the group's own has it."""
    number = key[0].as_py()
    if number >= buckets:  # who has them: on to the group
        return posts.select(["grp", "bucket", "data"])
    groups, data = posts.column("grp").to_pylist(), posts.column("data").to_pylist()
    place: dict[bytes, int] = {}
    of, own, counts, values = [], [], [], []
    for d in data:
        n = int(np.frombuffer(d, np.int64, 1)[0])
        own.append(_from_planes(d, n, 8))
        count = np.frombuffer(d, "<u4", n, 8 + 8 * n).astype(np.int64)
        values.append(np.frombuffer(d, "<u2", n, 8 + 12 * n))
        at = [0, *np.cumsum(count + min_length - 1).tolist()]
        text = pa.decompress(d[8 + 14 * n :], at[-1], "zstd", asbytes=True)
        of.append(np.fromiter((place.setdefault(text[b:e], len(place)) for b, e in zip(at, at[1:])), np.int64, n))
        counts.append(count)
    every, value = np.concatenate(of), np.concatenate(values)
    least = np.full(len(place), LAST)
    np.minimum.at(least, every, np.concatenate(own))
    texts = list(place)
    minimizer = np.empty(len(texts), np.uint16)  # bits of it: what is equal goes into one share
    minimizer[every] = value
    # shares of the bucket: all stretches of a minimizer are in one
    order = np.argsort(minimizer, kind="stable")
    size = np.cumsum([len(texts[x]) + 1 for x in order.tolist()])
    share = size // SORTED
    apart = np.flatnonzero(np.concatenate(([True], minimizer[order][1:] != minimizer[order][:-1])))
    share = np.repeat(share[apart], np.diff(np.append(apart, len(order))))
    firsts: list[np.ndarray | None] = [None] * len(texts)
    for part in np.split(order, np.flatnonzero(np.diff(share)) + 1):
        for x, found in zip(part.tolist(), _shared_out([texts[x] for x in part.tolist()], least[part], min_length)):
            firsts[x] = found
    rows = []
    for g, o, mine, count in zip(groups, of, own, counts):
        first = np.concatenate([firsts[x] for x in o.tolist()])
        rows.append((g, number, np.int64(len(first)).tobytes() + _bits(first < np.repeat(mine, count))))
    return _posts(rows)


CUT = "doc_id {}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(docs: pa.Table, answers: pa.Table, min_length: int) -> pa.Table:
    """Cuts a group's documents: of the windows in its stretches those go that a smaller id has, in the group or elsewhere."""
    rows = sorted(zip(docs.column("k").to_pylist(), docs.column("id").to_pylist(), docs.column("text").to_pylist()), key=lambda r: r[0])
    texts = [(r[2] or "").encode() for r in rows]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    gone = np.zeros(len(data) + 1, np.int32)
    told = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist()))
    if told:
        holders = told.pop()[1]
        m, n = np.frombuffer(holders, np.int64, 2).tolist()
        size = np.frombuffer(holders, "<u4", n, 16).astype(np.int64)
        of, doc, begin = (_from_planes(holders, m, 16 + 4 * n + 8 * m * k) for k in range(3))
        doc, begin = np.cumsum(doc), np.cumsum(begin)
        order = np.array([LAST if r[1] is None else r[1] for r in rows], np.int64)
        least = np.full(n, LAST)
        np.minimum.at(least, of, order[doc])
        # bits come bucket by bucket, in the order in which the stretches were posted
        bits = np.concatenate([np.unpackbits(np.frombuffer(d[8:], np.uint8), count=int(np.frombuffer(d, np.int64, 1)[0])) for _, d in told]) if told else np.empty(0, np.uint8)
        start = np.cumsum(size) - size
        count = size[of]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        dropped = bits[np.repeat(start[of], count) + offset].astype(bool) | np.repeat(order[doc] > least[of], count)
        windows = (np.repeat(begin, count) + offset)[dropped]
        np.add.at(gone, windows, 1)
        np.add.at(gone, windows + min_length, -1)
    covered = np.concatenate(([False], np.cumsum(gone[:-1], out=gone[:-1]) > 0, [False]))
    # no window crosses the end of a document, so a span that reaches it ends there
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))] if len(ends) else np.empty(0, np.int64)
    inner = np.unique(inner[covered[inner] & covered[inner + 1]]) if len(inner) else inner
    edges = np.sort(np.concatenate((edges, inner, inner)))
    starts, stops = edges[::2], edges[1::2]
    kept, removed, spans, at = [], [], [], 0
    for text, end in zip(texts, ends.tolist()):
        b, e = np.searchsorted(starts, [at, end])
        own = [(x - at, y - at) for x, y in zip(starts[b:e].tolist(), stops[b:e].tolist())]
        pieces = [text[y:x] for y, x in zip([0, *(y for _, y in own)], [*(x for x, _ in own), len(text)])]
        kept.append(b"".join(pieces))
        removed.append(sum(y - x for x, y in own))
        spans.append([{"start": x, "end": y} for x, y in own])
        at = end
    return pa.table({
        "doc_id": pa.array([r[1] for r in rows], docs.schema.field("id").type), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
    })


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans: of removed bytes, kept: the bytes left), a row for each row."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(2 * tasks, total // GROUP_BYTES), max(tasks, total // BUCKET_BYTES)
    how = {"min_length": min_length, "gram": gram, "buckets": buckets}
    key = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(key.alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = keyed.withColumn("grp", F.pmod(F.xxhash64("k"), F.lit(groups))).repartition(tasks, "grp")
    hashes = dealt.groupBy("grp").applyInArrow(lambda key, docs: _post_hashes(key, docs, **how), POST)
    answers = hashes.groupBy("bucket").applyInArrow(lambda key, posts: _answer_hashes(key, posts, hot), POST)
    posted = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda key, docs, told: _post_stretches(key, docs, told, **how), POST)
    verdicts = posted.groupBy("bucket").applyInArrow(lambda key, posts: _answer_stretches(key, posts, min_length, buckets), POST)
    return dealt.groupBy("grp").cogroup(verdicts.groupBy("grp")).applyInArrow(lambda docs, told: _cut(docs, told, min_length), CUT.format(id_type))
