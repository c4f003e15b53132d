"""Records and chunks of tables, against a walk over whole tables; files that can't be read."""

import random
import zipfile

from pyspark.sql import functions as F

from quarry.operators import tables as T
from quarry.sources import files


def grid(spark, rows):
    return spark.createDataFrame([("t", r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], "table_id string, r long, c long, text string")


def test_records(spark):
    g = grid(spark, [["a", "b", "a"], ["1", "", " 3 "], [" ", None, ""], ["x", "y", ""]])
    got = {r.r: list(r.record.items()) for r in T.records(g, T.header_paths(g)).collect()}
    assert got == {1: [("a", "3"), ("b", "")], 3: [("a", ""), ("b", "y")]}


def test_sentences(spark):
    g = grid(spark, [["a", "b"], ["1", ""], ["2", "3"]])
    about = spark.createDataFrame([("t", "T", ["x", "y"], ["n1", "n2"])], "table_id string, title string, article_path array<string>, footnotes array<string>")
    rows = T.records(g, T.header_paths(g))
    assert {r.r: r.fact for r in T.sentences(rows, about).collect()} == {1: "[표] T\n[문맥] x > y\na = 1\n[각주] n1 [각주] n2", 2: "[표] T\n[문맥] x > y\na = 2; b = 3\n[각주] n1 [각주] n2"}
    bare = about.select("table_id", F.lit("").alias("title"), F.lit(None).cast("array<string>").alias("article_path"), F.array().cast("array<string>").alias("footnotes"))
    assert {r.fact for r in T.sentences(rows, bare).collect()} == {"a = 1", "a = 2; b = 3"} == {r.fact for r in T.sentences(rows, about.limit(0)).collect()}


def walked(facts, tokens, most, overlap):
    groups, now = [], []
    size = lambda fs: sum(max(1, len(f) // 2) for f in fs)
    for f in facts:
        if now and (len(now) >= most or size(now) + size([f]) > tokens):
            groups.append(now)
            now = now[-overlap:] if overlap else []
        now = [*now, f]
    return [*groups, now] if now else groups


def test_chunks_equal_a_walk(spark):
    rng = random.Random(5)
    told = {t: [rng.choice("ab") * rng.choice([1, 7, 40, 90]) + str(k) for k in range(n)] for t, n in enumerate([0, 1, 2, 9, 60])}
    facts = spark.createDataFrame([(t, 3 * k, f) for t, fs in told.items() for k, f in enumerate(fs)], "table_id long, r long, fact string")
    for tokens, most, overlap in ((60, 4, 1), (60, 100, 0), (10, 3, 2), (900, 30, 1)):
        want = set()
        for t, fs in told.items():
            groups = walked(fs, tokens, most, overlap)
            name = lambda k: f"{t}:c:{k:04d}"  # noqa: B023, E731
            want |= {(name(k), t, k, len(groups), len(g), "\n".join(g), name(k - 1) if k else None, name(k + 1) if k + 1 < len(groups) else None) for k, g in enumerate(groups)}
        assert {tuple(r) for r in T.chunk_items(facts, tokens, most, overlap).collect()} == want


def test_locked_and_damaged_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:t>said</w:t></w:p></w:body></w:document>" + " " * 500)
    whole = (tmp_path / "good.docx").read_bytes()
    locked = bytearray(whole)
    locked[6] |= 1
    locked[whole.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.docx").write_bytes(locked)
    damaged = bytearray(whole)
    start = 30 + len("word/document.xml")
    damaged[start : start + 40] = b"\xff" * 40
    (tmp_path / "damaged.docx").write_bytes(damaged)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in files.office_parts(spark, str(tmp_path)).collect()}
    assert got == {"good.docx": ("text", "said"), "locked.docx": ("broken", ""), "damaged.docx": ("broken", "")}
