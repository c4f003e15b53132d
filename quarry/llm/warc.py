"""WARC archives with a two-level capture index.

Archives: Spark's own text writer makes the files, so a lost task is simply run again and
commits its file once. Each record is a gzip member of its own; a member's last byte is the
writer's line separator (a zero, which the size of a record below 16 MB ends with; longer
members are followed by an empty one). The files are WARC/1.1 files of gzip members,
whatever their names. A page's html is shuffled once, to the archive it goes to.

Of records with equal payloads of at least 1000 bytes, the one with the largest page id is
a ``response``, the others are ``revisit`` records that name it and hold no payload. Which
is which is decided from ids, digests and sizes alone.

Index: a scan of the archives, member by member, gives (reversed-host URL key, id, file,
offset, length) for each record. Sorted by key over all partitions, they are compressed in
blocks of ``BLOCK`` entries, which lie in files as the records do. The sparse directory
keeps each block's first key, file, offset and length, in a folder for each range of keys;
there are at most ``MAX_PARTS`` of these, whose first keys go to every look-up task. A
look-up searches those, then one folder of the directory, then the block that it reads by
its range. Records are read by their ranges too: tasks open archives with Arrow's file
systems (local or mounted folders, HDFS, S3, GCS, ABFS) and never load one whole.

Defined results: a null html is an empty payload, a null url the empty one; null page ids
come first among ids, and a revisit of such a record has a null ``refers_to``; rows equal
in all columns are one record each, and of those with equal payloads and ids one is the
response (rows are numbered as they are scanned, so ``pages`` has to be a table); an empty
table gives no archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, written

REVISIT_BYTES = 1000
#: Entries in a block of the index, and in a range of its keys until there are MAX_PARTS ranges.
BLOCK = 256
PART_ENTRIES = 8192
MAX_PARTS = 1000
#: Bytes of archives that one task reads, about, where there are more than shuffle partitions.
READ_BYTES = 128_000_000
#: Bytes that are inflated at once in a scan.
_STEP = 1 << 18
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``com,example,www)/a?b=c`` (scheme, port, fragment and user left out)."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1), r"\.$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    made = z.compress(data) + z.flush()
    return made if made[-1] == 0 else made + _EMPTY


def _record_id(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {digest} {row}')}>"


def record(row: dict, date: str) -> bytes:
    """A WARC record: headers, the HTTP response (for a revisit its head alone), two line ends."""
    payload, response = (row["html"] or "").encode(), row["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = row["url"] or ""
    target = re.sub(r"[^\x21\x23-\x3b\x3d\x3f-\x7e]", lambda m: quote(m[0], safe=""), url) or "about:blank"
    block = http + payload if response else http
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _record_id(row["page_id"], row["payload_digest"], row["_row"]),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-ID": "" if row["page_id"] is None else str(row["page_id"]),
    }
    if target != url:  # what a header can't hold
        head["X-URL"] = json.dumps(url)
    if not response:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _record_id(row["refers_to"], row["payload_digest"], row["_refers_row"])
        head["X-Refers-To-Page-ID"] = "" if row["refers_to"] is None else str(row["refers_to"])
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Headers of a record, from its beginning."""
    return dict(line.split(": ", 1) for line in raw[: raw.index(b"\r\n\r\n")].decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (without the HTTP head) of a record."""
    head, begin = headers(raw), raw.index(b"\r\n\r\n") + 4
    end = begin + int(head["Content-Length"])
    return head, raw[raw.index(b"\r\n\r\n", begin) + 4 : end]


def _url(head: dict[str, str]) -> str:
    return json.loads(head["X-URL"]) if "X-URL" in head else head["WARC-Target-URI"]


def _number(text: str) -> int | None:
    return int(text) if text else None


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Each row's record as a member, without its last byte."""
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            made = [member(record(row, date))[:-1] for row in batch.slice(k, 100).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])


def _as_files(members: DataFrame, path: str) -> None:
    """Writes members one behind the other; the separator of lines is each member's last byte."""
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").option("compression", "none").text(path)


def typed(pages: DataFrame) -> DataFrame:
    """Pages with payload length and digest, record type, and the page (and row) that a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest")
    ).withColumn("_row", F.monotonically_increasing_id())
    # reduced before the shuffle; html is neither read into it nor shuffled for it
    last = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "_row")).alias("_last"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").select("payload_digest", "_last")
    # read from a table, so that a digest with many rows can be split among tasks
    joined = rows.join(written(last, "last-of-payload").hint("shuffle_hash"), "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("_last").isNotNull() & ~F.struct("page_id", "_row").eqNullSafe(F.col("_last"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", "_row",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_last.page_id")).alias("refers_to"),
        F.when(revisit, F.col("_last._row")).alias("_refers_row"),
    )


def write(pages: DataFrame, path: str | None = None, date: str | None = None) -> str:
    """Writes the archives, with ``date`` (default: now) as the records' date, and returns their folder."""
    path = path or new_folder(pages.sparkSession, "warc")
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    _as_files(typed(pages).mapInArrow(partial(_members, date=date), "value binary"), path)
    return path


def _open(uri: str):
    """A file for reads at any place."""
    if uri.startswith("file:") or "://" not in uri:
        return LocalFileSystem().open_input_file(re.sub("^file:(//)?(?=/)", "", uri))
    fs, at = FileSystem.from_uri(uri)
    return fs.open_input_file(at)


def scan(file, ends: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and beginning (as far as ``ends`` at least) of each thing in a file of gzip members.

    The file is read and inflated in steps, so that neither it nor a member is held whole.
    """
    z, start, at, size, head, waiting = zlib.decompressobj(31), 0, 0, 0, b"", None
    data = file.read(_STEP)
    while data:
        out = z.decompress(data, _STEP)
        rest = z.unused_data if z.eof else z.unconsumed_tail
        at += len(data) - len(rest)
        size += len(out)
        if ends not in head:
            head += out
        if z.eof:
            if size or waiting is None:
                if waiting:
                    yield waiting
                waiting = (start, at - start, head)
            else:  # an empty member belongs to the one before
                waiting = (waiting[0], at - waiting[0], waiting[2])
            z, start, size, head = zlib.decompressobj(31), at, 0, b""
        data = rest or file.read(_STEP)
    if waiting:
        yield waiting


def _inflate(file, offset: int, length: int) -> bytes:
    return zlib.decompressobj(31).decompress(file.read_at(length, offset))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")


def _batches(rows: Iterator[tuple], schema: pa.Schema, sizes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1000 rows and, by the length of the column ``sizes``, 16 MB or a row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 0 if sizes is None else len(row[sizes] or "")
        if len(held) == 1000 or size > 16_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_CAPTURE = pa.schema([("url", pa.string()), ("page", pa.string()), ("type", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY = ("key", "page", "type", "path", "offset", "length")


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    for offset, length, begin in scan(file, b"\r\n\r\n"):
                        head = headers(begin)
                        yield _url(head), head["X-Page-ID"], head["WARC-Type"], path, offset, length

    yield from _batches(rows(), _CAPTURE)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, page, type, path, offset, length) of each record of the archives."""
    found = _files(spark, path).mapInArrow(_captures, "url string, page string, type string, path string, offset long, length long")
    return found.select(url_key(F.col("url")).alias("key"), *_ENTRY[1:])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of up to BLOCK of a partition's sorted entries, a line each."""

    def rows():
        held: list[list] = []
        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in _ENTRY)):
                held.append(entry)
                if len(held) == BLOCK:
                    yield (member("\n".join(map(json.dumps, held)).encode() + b"\n")[:-1],)
                    held = []
        if held:
            yield (member("\n".join(map(json.dumps, held)).encode() + b"\n")[:-1],)

    yield from _batches(rows(), pa.schema([("value", pa.binary())]), sizes=0)


_PLACE = pa.schema([("first_key", pa.string()), ("first_page", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    for offset, length, begin in scan(file, b"\n"):
                        key, page, *_ = json.loads(begin[: begin.index(b"\n")])
                        yield key, page, path, offset, length

    yield from _batches(rows(), _PLACE)


@dataclass(frozen=True)
class Index:
    """The sparse directory's folder, and (first key, first id, number) of its parts, at most MAX_PARTS."""

    folder: str
    tops: tuple[tuple[str, str, int], ...]
    entries: int

    def find(self, wanted: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        """(key, page, path, offset, length) of all captures with these keys and ids; in a task, best in order."""

        @lru_cache(2)
        def directory(part: int) -> list[tuple]:
            fs, at = (LocalFileSystem(), re.sub("^file:(//)?(?=/)", "", self.folder)) if self.folder.startswith("file:") or "://" not in self.folder else FileSystem.from_uri(self.folder)
            rows = pa.dataset.dataset(f"{at}/part={part}", filesystem=fs, format="parquet").to_table(columns=_PLACE.names)
            return sorted(zip(*(c.to_pylist() for c in rows.columns)))

        @lru_cache(4)
        def block(path: str, offset: int, length: int) -> list[list]:
            with _open(path) as file:
                return list(map(json.loads, _inflate(file, offset, length).splitlines()))

        for want in wanted:
            p = max(bisect_left(self.tops, want) - 1, 0)  # the part before may end with the key
            while p < len(self.tops) and self.tops[p][:2] <= want:
                places = directory(self.tops[p][2])
                b = max(bisect_left(places, want) - 1, 0)
                while b < len(places) and places[b][:2] <= want:
                    entries = block(*places[b][2:])
                    e = bisect_left(entries, [*want])
                    while e < len(entries) and entries[e][:2] == [*want]:
                        yield (*want, *entries[e][3:])
                        e += 1
                    b += 1
                p += 1


def build_index(spark: SparkSession, path: str) -> Index:
    """Sorts the captures of the archives into blocks and keeps the directory of them."""
    found = written(captures(spark, path), "captures")
    n = found.count()
    parts = min(MAX_PARTS, -(-n // PART_ENTRIES) or 1)
    folder = new_folder(spark, "capture-index")
    order = ["key", "page", "path", "offset"]
    _as_files(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, "value binary"), f"{folder}/blocks")
    places = _files(spark, f"{folder}/blocks").mapInArrow(_directory, "first_key string, first_page string, path string, offset long, length long")
    # a part of the directory has the blocks of one file
    places = places.withColumn("part", F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int"))
    places.write.partitionBy("part").parquet(f"{folder}/directory")
    if not n:
        return Index(f"{folder}/directory", (), 0)
    tops = spark.read.parquet(f"{folder}/directory").groupBy("part").agg(F.min(F.struct("first_key", "first_page")).alias("f"))
    return Index(f"{folder}/directory", tuple(sorted(map(tuple, tops.select("f.first_key", "f.first_page", "part").collect()))), n)


def _found(batches: Iterator[pa.RecordBatch], index: Index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    wanted = ((k, p) for batch in batches for k, p in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist()))
    yield from _batches(index.find(wanted), schema)


def look_up(index: Index, wanted: DataFrame) -> DataFrame:
    """(key, page, path, offset, length) for rows (key, page) of ``wanted``, equal rows once."""
    spark = wanted.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.entries // 1_000_000)
    # in the order of keys a task meets each part of the directory and each block once
    ordered = wanted.select("key", "page").distinct().repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    schema = pa.schema([("key", pa.string()), *list(_PLACE)[1:]]).set(1, pa.field("page", pa.string()))
    return ordered.mapInArrow(partial(_found, index=index, schema=schema), "key string, page string, path string, offset long, length long")


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()),
])


def _read(batches: Iterator[pa.RecordBatch], html: bool) -> Iterator[pa.RecordBatch]:
    def rows():
        path, file = None, None
        for batch in batches:
            for to, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if to != path:
                    if file:
                        file.close()
                    path, file = to, _open(to)
                head, payload = parse(raw := _inflate(file, offset, length))
                if response := head["WARC-Type"] == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:  # of the payload that it does not hold
                    size = int(re.search(rb"\r\n\r\nHTTP[^\0]*?Content-Length: (\d+)", raw)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = None if response else _number(head["X-Refers-To-Page-ID"])
                yield _number(head["X-Page-ID"]), _url(head), size, digest, head["WARC-Type"], refers, payload.decode() if html and response else None

    yield from _batches(rows(), _RECORD, sizes=6)


def read_ranges(ranges: DataFrame, html: bool = True, n: int | None = None) -> DataFrame:
    """Records at byte ranges (path, offset, length), with their html unless told not to; ``n`` tasks read them."""
    n = n or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ranges.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(partial(_read, html=html), RECORD)


def round_trip(pages: DataFrame, html: bool = True) -> DataFrame:
    """Writes all pages, indexes the archives, looks every page up and reads its record."""
    spark = pages.sparkSession
    path = write(pages)
    index = build_index(spark, path)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"))
    size = _files(spark, path).agg(F.sum("length")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // READ_BYTES)
    return read_ranges(look_up(index, wanted), html, n)
