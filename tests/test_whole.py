"""Queries that do the whole job where the SQL of another fixes a reduced one."""

import datetime

import pytest

from quarry.plans import catalog


@pytest.fixture
def planted(spark, tmp_path):
    """A function that writes documents (by id) and error lines (user, code) as tables and gives their folder."""

    def write(texts, errors=()):
        spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
        # ids in threes, as lines of such events have no time
        rows = [(3 * k, user, "error", datetime.datetime(2024, 1, 1), '{"k": %d}' % code) for k, (user, code) in enumerate(errors)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def run(spark, name, d):
    return catalog.QUERIES[name](spark, d).collect()


def test_evidence_has_all_errors_of_a_log(spark, planted):
    d = planted({1: "a\nb", 2: "c"}, [(1, k) for k in range(60)])
    got = run(spark, "incident_evidence_whole", d)
    log = sorted((r.line_no, r.evidence) for r in got if r.position == 0)
    assert [e.split()[1] for _, e in log] == [f"PAY{k:04d}" for k in range(60)]
    assert sorted((r.log_id, r.position, r.evidence) for r in got if r.position > 0) == [(1, 1, "a"), (1, 2, "b")]


def test_lines_that_differ_late_are_kept(spark, planted):
    # one code, seven exceptions; then copies of the first line
    d = planted({1: "a"}, [(1, 10010 + k) for k in range(7)] + [(1, 10010), (1, 10010)])
    got = sorted((r.line_no, r.line) for r in run(spark, "dedupe_whole_lines", d))
    assert [n for n, _ in got] == [3 * k for k in range(7)] and len({x for _, x in got}) == 7
    assert len({x[:30] for _, x in got}) == 1


def test_items_come_from_the_whole_document(spark, planted):
    scored = {5, 6, 7, 8, 9, 10}
    d = planted({1: "\n".join("api" if k in scored else "x" for k in range(101)), 2: "\n".join("x" * 101), 3: "x\napi\nx"})
    got = {}
    for r in run(spark, "select_items_spread", d):
        got.setdefault(r.asset_id, set()).add(int(r.chunk_id.split("-")[1]))
    assert got == {1: {5, 6, 7, 0, 50, 100}, 2: {0, 20, 40, 60, 80, 100}, 3: {0, 1, 2}}


def test_windows_hold_all_lines(spark, planted):
    text = "\n".join(f"line {k}" for k in range(1, 251))
    d = planted({1: text, 2: "", 3: "\n".join("x" * 120)})
    got = sorted((r.doc_id, r.seq, r.line_start, r.line_end, r.content) for r in run(spark, "code_windows_text", d))
    assert [x[:4] for x in got] == [(1, 0, 1, 120), (1, 1, 121, 240), (1, 2, 241, 250), (2, 0, 1, 1), (3, 0, 1, 120)]
    assert "\n".join(x[4] for x in got if x[0] == 1) == text


def test_incident_fields_of_a_text(spark, planted):
    d = planted({1: "장애번호: A-1\n 시스템 ： pay \nnote: x\nCause: first: disk\ncause: second\n \nsystem: only one\n\n\nfree text", 2: ""})
    got = sorted(run(spark, "incident_blocks", d), key=lambda r: r.block)
    assert [(r.doc_id, r.block, r.structured) for r in got] == [(1, 0, True), (1, 1, False), (1, 2, False)]
    assert (got[0].incident_id, got[0].system, got[0].cause, got[0].product, got[0].result) == ("A-1", "pay", "second", None, None)
    assert got[1].system == "only one" and got[2].content == "free text"


def test_java_diagnostics_of_a_text(spark, planted):
    code = """public class PayFailure extends base.PayException {
  void a() throws java.io.IOException, PayException {
    try { b(); } catch (final SQLException | TimeoutError e) { throw new com.acme.RetryException("ORA-00942 PAY1234"); }
  }
}"""
    d = planted({1: code, 2: "class Plain { }", 3: "no code"})
    got = {r.doc_id: r for r in run(spark, "java_text_diagnostics", d)}
    assert got[1].exception_types == ["PayException", "SQLException", "TimeoutError", "base.PayException", "com.acme.RetryException", "java.io.IOException"]
    assert got[1].declared_exceptions == ["PayException", "java.io.IOException"]
    assert got[1].thrown_exceptions == ["com.acme.RetryException"] and got[1].caught_exceptions == ["SQLException", "TimeoutError"]
    assert got[1].error_codes == ["ORA-00942", "PAY1234"]
    assert [got[k].is_exception_class for k in (1, 2, 3)] == [True, False, False] and got[2].exception_types == []
