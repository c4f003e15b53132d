"""Exact SentencePiece encoding and decoding of merge-type models, by backtracking.

A text is encoded as the library does it: spaces become the mark U+2581, one mark is put
in front, and pieces are those that merging adjacent symbols by score would leave. Instead
of merging, a stretch of text takes the longest piece at each position (Aho-Corasick) and
keeps it if it is compatible with the piece before: merging the two pieces' text anew must
leave just these two. Where none fits, the search steps back; a field of marks has positions
from which no way leads on, so that none is tried twice.

Texts are cut where no piece of the vocabulary crosses (new lines, marks, punctuation that
no piece joins to a letter), so stretches are short and their encodings can be kept in a
bounded cache. Runs of marks, whose pieces share one score, are merged from the left.
Characters without a piece fall back to their bytes.

Models with pieces that go on after a space, or that hold several spaces and letters, are
refused with an AssertionError: their stretches could not be cut.

Defined results: null and empty texts give the end id only and decode to the empty text;
long texts are encoded whole, a row at a time beyond ``SLICE_BYTES``;
rows are kept one for one, ties and repeated rows included; an empty table gives an empty
table; further columns pass through, ``ids`` and ``decoded`` replace columns so named.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
NORMAL, CONTROL, BYTE, UNKNOWN = range(4)
#: Stretches that each of two generations of the cache may hold.
CACHE_ENTRIES = 60_000
#: Bytes of text that go through a worker at once.
SLICE_BYTES = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """What a worker needs of a model: pieces, their scores and kinds, and the end id."""

    key: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    end: int


def load(path: str) -> Vocabulary:
    """Reads a model file on the driver; the vocabulary then goes to the executors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kind = lambda i: CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else UNKNOWN if sp.is_unknown(i) else NORMAL
    return Vocabulary(path, tuple(map(sp.id_to_piece, ids)), tuple(map(sp.get_score, ids)), tuple(map(kind, ids)), sp.eos_id())


class _Kept(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make):
        super().__init__()
        self.old: dict = {}
        self.make = make

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Coder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.id_of = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.byte_id = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.runs = {len(p) for p in self.id_of if set(p) == {MARK}}
        self.plain = {p: i for p, i in self.id_of.items() if p == MARK or set(p) != {MARK}}
        # only pieces that merging can make are candidates
        self.known = {p: i for p, i in self.plain.items() if len(p) == 1 or self._merged(p) == [p]}
        self.trie = ahocorasick.Automaton()
        for p, i in self.known.items():
            self.trie.add_word(p, i)
        self.trie.make_automaton()
        self.letters = {p for p in self.known if len(p) == 1}
        self.length = [len(p) for p in v.pieces]
        self.most = max(map(len, self.known), default=1)
        #: For each piece the longest shorter one that it begins with; -1: none.
        self.shorter = [next((self.known[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.known), -1) for p in v.pieces]
        self.compatible: dict[int, bool] = {}
        self.cut = re.compile(self._cuts())
        self.stretch = _Kept(self._stretch)
        self.out = [self._bytes(i) for i in range(len(v.pieces))]
        self.controls = [i for i, k in enumerate(v.kinds) if k == CONTROL]
        self.end = array("i", [v.end]).tobytes()

    def _cuts(self) -> str:
        """An expression for stretches whose borders no piece crosses."""
        inner = {(p[k], p[k + 1]) for p in self.plain for k in range(len(p) - 1)}
        assert not any(b == MARK and a != MARK for a, b in inner), "pieces across a space"
        assert not any(MARK * 2 in p for p in self.plain), "pieces of several spaces and letters"
        apart = "".join(c for c in "\n" if not any(c in pair for pair in inner))
        letter = re.compile(r"[^\W\d_]")
        joined = {b for a, b in inner if letter.match(a)}
        split = "".join(re.escape(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in joined)
        if not split:
            return f"(?: +|[^ {apart}])[^ {apart}]*|[\\s\\S]"
        # a stretch also ends between a letter and a sign that no piece joins to one
        return f"(?: +|[^ {apart}])(?:[^ {apart}{split}]+|(?<![^\\W\\d_])[{split}])*|[\\s\\S]"

    def _merged(self, text: str) -> list[str]:
        """Merging from single characters: best score first, leftmost of equals."""
        parts, score = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = self.plain.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        fits = self.compatible.get(key)
        if fits is None:
            if len(self.compatible) >= 4 * CACHE_ENTRIES:
                self.compatible.clear()
            x, y = self.v.pieces[a], self.v.pieces[b]
            fits = self.compatible[key] = self._merged(x + y) == [x, y]
        return fits

    def _known_stretch(self, text: str) -> list[int]:
        """Pieces of a text all of whose characters have pieces."""
        kept, longest = self.compatible.get, self.trie.iter_long
        found = [i for _, i in longest(text)]
        for k in range(len(found) - 1):
            if not (kept(found[k] << 20 | found[k + 1]) or self._fits(found[k], found[k + 1])):
                break
        else:
            return found
        # the first k + 1 pieces are as the search below would take them
        length, shorter, n = self.length, self.shorter, len(text)
        path, i, most = found[: k + 1], found[k + 1], self.most
        pos, failed = sum(length[x] for x in path), bytearray(n + 1)
        while True:
            while i >= 0:
                to = pos + length[i]
                if not failed[to] and (not path or kept(path[-1] << 20 | i) or self._fits(path[-1], i)):
                    break
                i = shorter[i]
            if i >= 0:
                path.append(i)
                pos = to
                if pos == n:
                    return path
                i = next(longest(text[pos : pos + most]))[1]
            else:  # no way leads on from here: a shorter piece before
                failed[pos] = 1
                i = path.pop()
                pos -= length[i]
                i = shorter[i]

    def _pieces(self, text: str) -> list[int]:
        """Splits off characters without a piece, which become bytes."""
        if self.letters.issuperset(text):
            return self._known_stretch(text) if text else []
        found: list[int] = []
        for known, part in groupby(text, self.letters.__contains__):
            part = "".join(part)
            if known:
                found += self._known_stretch(part)
            elif self.byte_id:
                found += [self.byte_id[b] for b in part.encode()]
            else:
                found += [self.unknown] * len(part)
        return found

    def _run(self, n: int) -> list[int]:
        """A run of marks, whose pieces share one score: merged from the left."""
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-1] + parts[-2] in self.runs:
                parts[-2:] = [parts[-1] + parts[-2]]
        return [self.id_of[MARK * k] for k in parts]

    def _stretch(self, text: str) -> bytes:
        text = text.replace(" ", MARK)
        marks = len(text) - len(text.lstrip(MARK))
        if marks < 2:
            found = self._pieces(text)
        else:  # the mark next to the word may join it; the others only join each other
            found = self._pieces(text[marks - 1 :])
            lone = self.v.pieces[found[0]] == MARK
            found = self._run(marks if lone else marks - 1) + found[lone:]
        return array("i", found).tobytes()

    def forget(self) -> None:
        """Empties the cache of stretches."""
        self.stretch.clear()
        self.stretch.old = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text with the end id, as the bytes of 32-bit integers."""
        if not text:
            return self.end
        if MARK in text:
            text = text.replace(MARK, " ")
        return b"".join(map(self.stretch.__getitem__, self.cut.findall(" " + text))) + self.end

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.v.kinds[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark that encoding put in front is taken off again."""
        runs = [ids]
        for c in self.controls:
            if c in ids[:-1]:  # bytes on both sides of a control piece are not one character
                runs = [[*g] for _, g in groupby(ids, lambda i: self.v.kinds[i] == CONTROL)]
        raw = [b"".join(map(self.out.__getitem__, run)) for run in runs]
        first = next((k for k, i in enumerate(ids) if self.v.kinds[i] != CONTROL), None)
        text = "".join(map(_utf8, raw))
        if first is not None and self.v.kinds[ids[first]] == NORMAL and text[:1] == " ":
            text = text[1:]
        return text


def _utf8(raw: bytes) -> str:
    """Bytes that are no UTF-8 give a replacement each."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", raw.decode(errors="surrogateescape"))


_CODERS: dict[str, Coder] = {}


def _coder(v: Vocabulary) -> Coder:
    """One for each worker process, which runs many tasks."""
    if v.key not in _CODERS:
        _CODERS[v.key] = Coder(v)
    return _CODERS[v.key]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches with a bounded amount of text each, but a row at least."""
    for batch in batches:
        begin, held = 0, 0
        for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            held += size or 0
            if held >= SLICE_BYTES:
                yield batch.slice(begin, k + 1 - begin)
                begin, held = k + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _both(batches: Iterator[pa.RecordBatch], v: Vocabulary, text_col: str, keep: list[str], back: bool) -> Iterator[pa.RecordBatch]:
    coder = _coder(v)
    for batch in _slices(batches, text_col):
        offsets, made, texts = [0], [], []
        for text in batch.column(text_col).to_pylist():
            ids = coder.encode(text or "")
            made.append(ids)
            offsets.append(offsets[-1] + len(ids) // 4)
            if back:
                texts.append(coder.decode(array("i", ids).tolist()))
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(made))])
        columns = [batch.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
        names = [*keep, "ids"]
        if back:
            columns.append(pa.array(texts, pa.string()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names)
        del columns, flat, made, texts, batch
        pa.default_memory_pool().release_unused()  # else the pool keeps what the largest batches took
    coder.forget()  # a worker that waits for the next task holds little


def encode(df: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds ``ids``; with ``decoded`` also the text that the ids decode to. ``keep``: the columns to return besides."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "decoded")]
    v = load(model)
    fields = [df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    needed = df.select(*dict.fromkeys([*keep, text_col]))
    return needed.mapInArrow(partial(_both, v=v, text_col=text_col, keep=keep, back=decoded), T.StructType(fields))


def _texts(batches: Iterator[pa.RecordBatch], v: Vocabulary, ids_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    coder = _coder(v)
    for batch in batches:
        texts = pa.array([coder.decode(ids or []) for ids in batch.column(ids_col).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, "decoded"])


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of an array of ids (null: empty)."""
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    return df.mapInArrow(partial(_texts, v=load(model), ids_col=ids_col, keep=keep), schema)
