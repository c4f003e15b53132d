"""Readers and sinks on folders of small files; rules around answers; Java sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import answering as A
from quarry.operators import logs as L
from quarry.operators import normalize as N
from quarry.operators import retrieval as R
from quarry.operators import state as S
from quarry.operators import symbols as J
from quarry.sources import files
from quarry.streaming import ingest

LOG = """2026-10-07 10:00:00 INFO start
2026-10-07 10:00:01 ERROR SRVE0255E: java.lang.IllegalStateException: broken
\tat com.company.payment.PaymentService.pay(PaymentService.java:143)
\tat java.util.ArrayList.get(Native Method)
Caused by: java.sql.SQLException: ORA-00942
2026-10-07 10:00:02 INFO end"""
JAVA = '''package com.company.payment;
// class Comment { void not() {} }
public class PaymentService {
    private final String s = "class Text { void no() { }";
    public PaymentService() { }
    /* void gone() { */
    public String pay(int a, java.util.List<String> b) throws java.io.IOException {
        if (a > 0) { for (char c : "}".toCharArray()) { run(c); } }
        return new Object() { }.toString();
    }
    static class Inner { void work() { } }
}
class PaymentException extends RuntimeException { }
'''


def test_logs_incidents_and_code(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf" + LOG.encode() + b"\r\nbad \xff byte")
    records = files.log_items(spark, str(tmp_path)).orderBy("line_start").collect()
    assert [r.n_lines for r in records] == [1, 4, 2] and records[0].text.startswith("2026") and "�" in records[2].text
    error = records[1]
    assert (error.error_code, error.severity, error.exception_class) == ("SRVE0255E", "ERROR", "java.lang.IllegalStateException")
    assert error.root_cause.startswith("Caused by: java.sql.SQLException") and [f.line_number for f in error.frames] == [143, None] and [f.is_app for f in error.frames] == [True, False]
    (tmp_path / "i.txt").write_text("장애번호: INC-20261007-001\n시스템: pay\n원인: 연결 끊김: 재시도\n\nfree text\n\n")
    incidents = files.incident_items(spark, str(tmp_path), "*.txt").orderBy("block").collect()
    assert [r.structured for r in incidents] == [True, False] and incidents[0].cause == "연결 끊김: 재시도" and incidents[0].identifier == "INC-20261007-001"
    assert incidents[0].embedding_text.startswith("[장애]\n장애번호: INC-20261007-001") and incidents[1].embedding_text == "free text"
    (tmp_path / "q.sql").write_text("\n".join(f"select {k};" for k in range(150)) + "\n")
    assert [(r.language, r.line_start, r.line_end) for r in files.code_windows(spark, str(tmp_path), "*.sql").orderBy("seq").collect()] == [("sql", 1, 120), ("sql", 121, 150)]


def test_java_sources(spark, tmp_path):
    assert len(J.masked(JAVA)) == len(JAVA) and J.masked(JAVA).count("\n") == JAVA.count("\n") and "not" not in J.masked(JAVA)
    (tmp_path / "P.java").write_text(JAVA)
    got = [(r.package_name, r.kind, r.symbol_name, r.class_name, r.start_line, r.end_line) for r in J.symbols(files.texts(spark, str(tmp_path))).collect()]
    p = "com.company.payment"
    assert got == [
        (p, "class", "PaymentService", None, 3, 12), (p, "constructor", "PaymentService", "PaymentService", 5, 5), (p, "method", "pay", "PaymentService", 7, 10),
        (p, "class", "Inner", "PaymentService", 11, 11), (p, "method", "work", "Inner", 11, 11), (p, "class", "PaymentException", None, 13, 13),
    ]
    assert J.definitions("") == [] and J.definitions("class A { void m() { ") == [("class", "A", None, 1, 1, "class A"), ("method", "m", "A", 1, 1, "void m()")]


def test_python_sources_and_windows(spark, tmp_path):
    body = "\n".join("    x = 1" for _ in range(130))
    (tmp_path / "a.py").write_text(f"import os\n\nclass A:\n    def m(self):\n        def inner(): pass\n\ndef f():\n{body}\n")
    (tmp_path / "b.py").write_text("def broken(:\n")
    (tmp_path / "c.sql").write_text("\n".join(f"select {k};" for k in range(150)))
    sources = files.texts(spark, str(tmp_path))
    got = [(r.kind, r.symbol_name, r.class_name, r.start_line, r.end_line) for r in J.symbols(sources).orderBy("start_line").collect()]
    assert got == [("class", "A", None, 3, 5), ("method", "m", "A", 4, 5), ("function", "f", None, 7, 137)]
    spans = {}
    for r in J.windows(sources).orderBy("path", "kind", "line_start").collect():
        spans.setdefault(r.path[-4:], []).append((r.kind, r.symbol_name, r.line_start, r.line_end, r.content.count("\n") + 1))
    assert spans["a.py"] == [("class", "A", 3, 5, 3), ("function", "f", 7, 126, 120), ("function", "f", 127, 137, 11), ("header", None, 1, 70, 70), ("method", "m", 4, 5, 2)]
    assert spans["b.py"] == [("file", None, 1, 1, 1)] and [x[2:4] for x in spans[".sql"]] == [(1, 120), (121, 150)]


def archive(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return held.getvalue()


def test_archives_and_office_files(spark, tmp_path):
    (tmp_path / "good.jar").write_bytes(archive({"a/B.class": b"x" * 10}))
    (tmp_path / "bad.jar").write_bytes(archive({"../B.class": b"x"}))
    (tmp_path / "none.jar").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: (r.usable, r.reason, r.n_classes) for r in files.jars(spark, str(tmp_path)).collect()}
    assert got == {"good.jar": (True, None, 1), "bad.jar": (False, "path", 1), "none.jar": (False, "no archive", 0)}
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    (tmp_path / "d.docx").write_bytes(archive({"word/document.xml": f"<w:document {w}><w:body>{t('one')}<w:tbl><w:tr><w:tc>{t('a')}</w:tc><w:tc>{t('b')}</w:tc></w:tr></w:tbl>{t('')}{t('two')}</w:body></w:document>"}))
    p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda x, y, s, ph="": f'<p:sp>{ph}<a:off x="{x}" y="{y}"/><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p:sp>'
    (tmp_path / "s.pptx").write_bytes(archive({"ppt/slides/slide1.xml": f"<p:sld {p}>{shape(9, 5, 'right')}{shape(1, 5, 'left')}{shape(0, 9, 'Head', '<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}</p:sld>"}))
    (tmp_path / "x.docx").write_bytes(b"broken")
    parts = {}
    for r in files.office_parts(spark, str(tmp_path)).collect():
        parts.setdefault(r.path.rsplit("/", 1)[1], []).append((r.position, r.kind, r.text))
    assert parts == {"d.docx": [(0, "text", "one"), (1, "table", "a | b"), (2, "text", "two")], "s.pptx": [(1, "title", "Head"), (1, "text", "left"), (1, "text", "right")], "x.docx": [(0, "broken", "")]}


def test_sinks(spark, tmp_path):
    rows = lambda pairs: spark.createDataFrame(pairs, "version_id long, content string")
    files.replace_versions(rows([(1, "a"), (2, "b"), (2, "c")]), f"{tmp_path}/t")
    for _ in range(2):
        files.replace_versions(rows([(2, "new")]), f"{tmp_path}/t")
    assert sorted((r.version_id, r.content) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "new")]
    files.write_items(rows([(1, "é")]), f"{tmp_path}/j")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/j").select("version_id", "content").collect()] == [(1, "é")]
    value = spark.range(1).select(files.expanded(F.lit("u=${USER:-me};h=${HOST};p=${PORT:-1}"), {"PORT": "80"})).first()[0]
    assert value == "u=me;h=;p=80"


def test_segments_go_on_over_batches(spark, tmp_path):
    lines = [(7, k, "ERROR x" if k in (3, 300) else f"line {k}") for k in range(1, 400)]
    schema = "log_id long, line_no long, line string"
    whole = {(r.line_no): (r.segment, r.part) for r in L.segments(spark.createDataFrame(lines, schema)).collect()}
    for n, part in enumerate((lines[:100], lines[100:320], lines[320:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.uploads(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        ingest.segments_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert {r.line_no: (r.segment, r.part) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == whole


def test_traces(spark):
    trace = "java.lang.RuntimeException: PAY1001\n\tat com.company.A.pay(A.java:1)\n\tat java.util.List.get(List.java:2)\n\tat com.company.B.run(B.java:3)\nCaused by: java.sql.SQLException: ORA-00942: no table"
    f = L.trace_fields(F.col("t"))
    rows = spark.createDataFrame([(trace,), ("오늘 점심은 무엇인가요?",)], "t string").select(*[c.alias(n) for n, c in f.items()], L.trace_query(F.col("t"), f, F.lit("why?")).alias("query")).collect()
    r = rows[0]
    assert r.detected and (r.primary_exception, r.root_exception, r.root_message) == ("java.lang.RuntimeException", "java.sql.SQLException", "ORA-00942: no table")
    assert (r.frame_count, len(r.app_frames), r.app_frames[0].method_name, r.error_codes) == (3, 2, "pay", ["PAY1001", "ORA-00942"])
    assert len(r.query) <= 2000 and "com.company.B.run(B.java:3)" in r.query and not rows[1].detected


def test_excerpts_are_spread_over_the_log(spark):
    lines = [(1, k, f"ERROR CASE-{k:04d}") for k in range(500)] + [(2, k, f"calm {k}") for k in range(300)] + [(3, 0, "ERROR " + "x" * 9000)]
    got = L.excerpt(spark.createDataFrame(lines, "log_id long, line_no long, line string"), 16_000).collect()
    of = lambda n: sorted((r.line_no, r.line) for r in got if r.log_id == n)
    assert of(1)[0][1] == "ERROR CASE-0000" and of(1)[-1][1] == "ERROR CASE-0499" and sum(len(x) + 1 for _, x in of(1)) <= 16_001
    assert [n for n, _ in of(2)] == [*range(80), *range(280, 300)] and len(of(3)[0][1]) == 2000


def test_heading_stack():
    text = "제2관 보험금\n제1조 (목적)\n본문\n제2조\n[별표40-1] 표\n제3조의2 (정의)\n2-4 암진단 특별약관\n\n끝"
    got = [(kind, len(path), path[-1] if path else None) for _, _, _, path, kind in N.walked(text)]
    assert got == [
        ("section", 1, "제2관 보험금"), ("article", 2, "제1조 (목적)"), (None, 2, "제1조 (목적)"), ("article", 3, "제2조"), ("appendix", 1, "[별표40-1] 표"),
        ("article", 2, "제3조의2 (정의)"), ("special_clause", 1, "2-4 암진단 특별약관"), (None, 1, "2-4 암진단 특별약관"),
    ]


def test_queries_are_parsed():
    q = R.parsed("at com.company.Batch$Worker.<init>(Batch.java:20)\n at com.company.payment.PaymentService.pay(PaymentService.java:143) PAY0001 PAY0001 the")
    assert q.frames[0] == ("com.company", ("Batch$Worker", "Batch", "Worker"), ("<init>", "Batch$Worker", "Batch", "Worker"))
    assert q.frames[1] == ("com.company.payment", ("PaymentService",), ("pay",)) and q.tokens.count("PAY0001") == 2 and "the" not in q.tokens


def test_answers(spark):
    page = '<p onclick="x">a &lt; b<script>alert(1)</script><a href="javascript:x">j</a><a href="https://x.org?a=1&b=2">k</a><img src=x></p>'
    rows = spark.createDataFrame([(page,), (None,)], "h string").select(A.sanitized(F.col("h"))).collect()
    assert rows[0][0] == '<p>a &lt; balert(1)<a>j</a><a href="https://x.org?a=1&amp;b=2" target="_blank" rel="noopener noreferrer">k</a></p>' and rows[1][0] == ""
    unsafe = ["java&#115;cript:x", "java\tscript:x", " JavaScript:x", "data:text/html,x", "javascript&colon;x", ":x", "vbscript:x"]
    safe = {"/a?b=1&amp;c": "/a?b=1&amp;c", "mailto:a@b": "mailto:a@b", "#x:y": "#x:y"}
    links = [f"<a href='{u}'>x</a>" for u in [*unsafe, *safe]] + ["<A TITLE='t\"<' data-href=evil:x>y</A><!-- <p> --><br/></br>1 < 2 & 3 &copy;<style>p</style", "<a title='><img src=x onerror=y>'>"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in links], "h string").select(A.sanitized(F.col("h"))).collect()]
    assert got[: len(unsafe)] == ["<a>x</a>"] * len(unsafe) and got[len(unsafe) : -2] == [f'<a href="{v}">x</a>' for v in safe.values()]
    assert got[-2:] == ['<a title="t&quot;&lt;">y</a><br>1 &lt; 2 &amp; 3 &copy;p&lt;/style', '<a title="&gt;&lt;img src=x onerror=y&gt;">']
    template = "# 요약\n## 원인\n## 조치"
    one = lambda of, said: spark.createDataFrame([(said,)], "a string").select(of(F.col("a"), template)).first()[0]
    assert one(A.missing_headings, "# 요약\nx\n## 조치\ny") == ["## 원인"] and one(A.missing_headings, "## 원인\n# 요약\n## 조치") == ["## 원인"]
    assert one(A.coerced, "intro\n## 조치\ndo it\n### more") == f"# 요약\nintro\n\n## 원인\n{A.FILLER}\n\n## 조치\ndo it\nmore"
    kept = spark.createDataFrame([("# 요약\n## 원인\n## 조치",), ("x",), (None,)], "a string").select(A.in_template(F.col("a"), template)).collect()
    assert kept[0][0] == template and kept[1][0].startswith("# 요약\nx") and kept[2][0] is None
    ips = ["10.0.0.255", "256.1.1.1", "fe80::1", "::1", "1::2::3", "unknown", None, "2001:DB8:0:0:0:0:0:1"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ips], "v string").select(A.client_address(F.col("v"))).collect()] == ["10.0.0.255", None, "fe80::1", "::1", None, None, None, "2001:db8:0:0:0:0:0:1"]
    codes = spark.createDataFrame([(400, "Exceeds the available context size"), (400, "bad"), (500, "context length"), (400, None)], "s int, b string")
    assert [r[0] for r in codes.select(A.too_long_for_model(F.col("s"), F.col("b"))).collect()] == [True, False, False, False]
    waits = spark.createDataFrame([(0, None), (1, None), (9, None), (0, "7"), (0, "soon")], "n int, h string").select(A.retry_after(F.col("n"), F.col("h"))).collect()
    assert [r[0] for r in waits] == [0.5, 1.0, 3.0, 7.0, 0.5]


def test_state_of_inserts_and_progress(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string")
    assert sorted(map(tuple, S.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, S.replace_rows(old, new.distinct(), ["k"]).collect())) == [(1, "b"), (2, "c")]
    jobs = spark.createDataFrame([(1, "processing", "w1", '{"k":"1","processing_stage":"old"}', None), (2, "processing", "w2", None, None), (3, "queued", "w1", "{}", None)], "job_id long, status string, worker_id string, report string, heartbeat_at timestamp_ntz")
    after = {r.job_id: r for r in S.progress(jobs, "w1", F.expr("timestamp_ntz '2024-01-01 00:00:00'"), "report", {"processing_stage": F.lit("new")}).collect()}
    assert after[1].report == {"k": "1", "processing_stage": "new"} and after[1].heartbeat_at is not None
    assert after[2].report == {} and after[2].heartbeat_at is None and after[3].report == {}
    empty = S.gate(jobs.filter("false"), 1, 0).first()
    assert tuple(empty) == (0, False, None) and tuple(S.gate(jobs, 3, 0).first()) == (3, True, 1)


if __name__ == "__main__":
    pytest.main([__file__])
