"""Answers and guides for many requests."""

from pyspark.sql import functions as F

from quarry.operators import guidance as G
from quarry.plans import catalog

RESULT = "request_id long, position long, chunk_id string, title string, source_filename string, version_label string, page_start int, page_end int, content string, kind string, metadata string"


def results(spark, *rows):
    return spark.createDataFrame([(r, p, f"c{r}-{p}", "T", None, None, page, page and page + 1, said, kind, meta) for r, p, said, page, kind, meta in rows], RESULT)


def requests(spark, *ids):
    return spark.createDataFrame([(k, f"q{k}") for k in ids], "request_id long, query string")


def saying(answers):
    def model(prompts):
        known = prompts.sparkSession.createDataFrame(list(answers.items()), "request_id long, answer string")
        return prompts.select("request_id").join(known, "request_id")

    return model


def test_statuses_evidence_and_notices(spark):
    found = results(spark, (1, 1, "a", None, "text", None), (2, 1, "b", None, "text", '{"decompiled": true}'), (3, 1, "c", None, "decompiled_code_class", None), (4, 1, "d", None, None, '{"decompiled": "true"}'))
    got = {r.request_id: r for r in G.answered(requests(spark, 1, 2, 3, 4, 5), found, None, saying({1: "This is not found in the\n documents.", 2: "fine", 4: "ok", 5: "never asked"})).collect()}
    assert {k: (r.generation_status, r.evidence_status, len(r.notices), r.n_results) for k, r in got.items()} == {
        1: ("completed", "insufficient", 0, 1), 2: ("completed", "sufficient", 1, 1), 3: ("unavailable", "insufficient", 1, 1), 4: ("completed", "sufficient", 0, 1), 5: ("out_of_scope", "insufficient", 0, 0),
    }
    assert got[2].answer == "fine\n\n" + G.DECOMPILED
    assert got[3].answer.startswith(G.UNAVAILABLE)
    assert got[5].answer == G.OUT_OF_SCOPE


def test_context_is_numbered_and_cut(spark):
    found = results(spark, (1, 1, " first ", 3, "text", None), (1, 2, "second" * 50, None, "text", None), (1, 3, "third", None, "text", None)).withColumn("neighbor_context", F.when(F.col("position") == 1, "near"))
    context = G.contexts(found, 120).first().context
    one, two = context.split(G.SEPARATOR)
    assert one == "[1] 제목: T\n파일: 파일명 없음 / 버전: - / 3-4쪽\n본문:\nfirst \nnear"
    assert two.startswith("[2] 제목: T\n") and len(one) + len(two) == 120


def test_relations_stand_with_the_first_result(spark):
    chunks = spark.createDataFrame([("c1-1", 7), ("x", 7), ("y", 8)], "chunk_id string, version_id long")
    entities = spark.createDataFrame([("a", "t", "A"), ("b", "t", "B"), ("z", "t", "Z")], "entity_id string, entity_type string, canonical_name string")
    relations = spark.createDataFrame([("a", "b", "calls", 0.4, "x"), ("a", "b", "calls", 0.9, "x"), ("a", "a", "own", 1.0, "x"), ("a", "z", "calls", 1.0, "y")], "source_id string, target_id string, relation_type string, confidence double, chunk_id string")
    mentions = spark.createDataFrame([("x", "a")], "chunk_id string, entity_id string")
    found = results(spark, (1, 1, "text", None, "text", None), (2, 1, "other", None, "text", None))
    graph = G.subgraphs(found, chunks, entities, relations, mentions)
    assert sorted((r.request_id, r.entity_id, r.is_seed) for r in graph[0].collect()) == [(1, "a", True), (1, "b", False)]
    assert sorted((r.target_id, r.confidence) for r in graph[1].collect()) == [("a", 1.0), ("b", 0.9)]
    said = G.relation_contexts(*graph).first()
    assert (said.relation_context, said.diagram) == (G.RELATIONS_HEAD + "\n- A → A (own)\n- A → B (호출)", "architecture")
    echo = lambda prompts: prompts.select("request_id", F.col("context").alias("answer"))
    got = {r.request_id: r for r in G.answered(requests(spark, 1, 2), found, graph, echo).collect()}
    assert "A → B" in got[1].answer and got[1].diagram == "architecture"
    assert "→" not in got[2].answer and got[2].diagram is None


def test_few_relations_are_kept_by_confidence(spark):
    chunks = spark.createDataFrame([("c1-1", 7)], "chunk_id string, version_id long")
    entities = spark.createDataFrame([(f"e{k}", "t", f"N{k:02d}") for k in range(9)], "entity_id string, entity_type string, canonical_name string")
    relations = spark.createDataFrame([("e0", f"e{k}", "calls", k / 10, "c1-1") for k in range(1, 9)], "source_id string, target_id string, relation_type string, confidence double, chunk_id string")
    mentions = spark.createDataFrame([("c1-1", "e0")], "chunk_id string, entity_id string")
    top, edges = G.subgraphs(results(spark, (1, 1, "x", None, "t", None)), chunks, entities, relations, mentions, most_entities=6, most_relations=2)
    assert sorted(r.entity_id for r in top.collect()) == [f"e{k}" for k in range(6)]
    assert sorted(r.target_id for r in edges.collect()) == ["e4", "e5"]


def test_a_service_runs_in_tasks(spark):
    prompts = spark.createDataFrame([(1, "q", "c"), (2, "no", "c")], "request_id long, query string, context string")
    got = G.by_service(lambda q, c: None if q == "no" else q + c)(prompts).collect()
    assert sorted((r.request_id, r.answer) for r in got) == [(1, "qc"), (2, None)]


def test_guides_put_the_log_first_and_keep_to_the_template(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["2024-01-01 10:00:00 ERROR PAY0001 boom", "Caused by: java.io.IOException: disk", "INFO done"])], "log_id long, line_no long, line string")
    found = results(spark, (1, 1, "known fix", None, "decompiled_code", None), (2, 1, "alone", None, "text", None))
    template = "## Cause\n\n## Action"
    asked = []

    def model(prompts):
        asked.append({r.request_id: r.query for r in prompts.collect()})
        answer = F.when(F.contains("query", F.lit(G.MISSING_HEADINGS)) & (F.col("request_id") == 1), F.concat(F.lit("## Cause\n"), "context", F.lit("\n## Action\ngo"))).when(F.col("request_id") == 2, "plain")
        return prompts.select("request_id", F.coalesce(answer, F.lit("## Action\nfirst")).alias("answer"))

    got = {r.request_id: r for r in G.guided(requests(spark, 1, 2, 3), lines, found, model, template).collect()}
    assert got[1].answer.index(G.LOG_TITLE) < got[1].answer.index("known fix") and got[1].answer.endswith(G.DECOMPILED)
    assert got[2].answer == "## Cause\nplain\n\n## Action\n- 추가 확인 필요"
    assert (got[3].generation_status, got[3].answer) == ("out_of_scope", G.GUIDE_OUT_OF_SCOPE)
    assert (got[1].n_results, got[1].error_codes, got[1].last_cause, got[1].levels) == (1, ["PAY0001"], "java.io.IOException", {"ERROR": 1, "INFO": 1})
    assert set(asked[0]) == {1, 2} and set(asked[1]) == {1, 2} and "## Cause" in asked[1][1] and '"error_codes":["PAY0001"]' in asked[0][1]


def test_no_requests(spark):
    none = results(spark, (1, 1, "x", None, "t", None)).limit(0)
    lines = spark.createDataFrame([], "log_id long, line_no long, line string")
    assert G.answered(requests(spark, 1).limit(0), none, None, saying({1: "x"})).count() == 0
    assert G.guided(requests(spark, 1), lines, none, saying({1: "x"}), "## A").first().generation_status == "out_of_scope"


def test_guides_of_all_logs(spark):
    rows = catalog.QUERIES["incident_guides"](spark, "/root/testdata/sf0.001")
    kept = rows.filter("generation_status = 'completed'")
    assert kept.count() > 0 and kept.filter(~F.col("answer").rlike(r"(?s)^## Cause\n\d+\n\n## Action\n")).count() == 0
    assert rows.groupBy("request_id").count().filter("count > 1").count() == 0


def test_long_results_are_cut_before_they_are_sorted(spark):
    """Texts beyond the context are the same evidence as before, stripped once and cut where it ends; they are made once."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    most, said = 200, ["  " + "a" * 120 + " " * 400 + "b", "\n" + "c" * 900, "never"]
    found = results(spark, *[(1, k + 1, t, None, "text", None) for k, t in enumerate(said)])
    lines = spark.createDataFrame([], "log_id long, line_no long, line string")
    seen = []

    def model(prompts):
        seen.extend(prompts.collect())
        return prompts.select("request_id", F.lit("## A").alias("answer"))

    once = found.mapInPandas(counted, found.schema)
    assert G.guided(requests(spark, 1), lines, once, model, "## A", most=most).first().answer == "## A"
    whole = "[1] 제목: T\n파일: 파일명 없음 / 버전: - / " + G.NO_PAGE + "\n본문:\n" + said[0].strip()
    assert seen[0].context == whole[:most] and len(seen[0].context) == most
    assert made.value <= 9  # for contexts, and for the counts of results where they are met


def test_cut_texts_fill_contexts_like_whole_ones(spark):
    for body in ("x" * 50, " x" * 50, "x" * 30 + " " * 99 + "y", "y" + "\n" * 99, "", None):
        row = results(spark, (1, 1, body, None, "text", None), (1, 2, "second", None, "text", None)).withColumn("neighbor_context", F.lit(None).cast("string"))
        for most in (40, 45, 60, 90, 400):
            plain = [f"[{k}] 제목: T\n파일: 파일명 없음 / 버전: - / {G.NO_PAGE}\n본문:\n{t}" for k, t in ((1, (body or "").strip()), (2, "second"))]
            left, parts = most, []
            for b in plain:
                if left > 0:
                    parts.append(b[:left])
                left -= len(b)
            assert G.contexts(row.withColumn("content", G.within(F.col("content"), most)), most).first().context == G.SEPARATOR.join(parts)
