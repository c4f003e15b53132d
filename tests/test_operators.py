"""Fixed cases of operators."""

import datetime

from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.operators import budget, graph, logs, retrieval, state, tables


def one(spark, value, **columns):
    return spark.range(1).select(value.alias("x"), *[F.lit(v).alias(k) for k, v in columns.items()]).first()["x"]


def test_fusion_orders_ties_by_lane(spark):
    lane = lambda n, *ids: spark.createDataFrame([(n, k + 1, c) for k, c in enumerate(ids)], "lane_id long, rank long, chunk_id string")
    fused = [r.chunk_id for r in retrieval.fuse([lane(1, "a", "b"), lane(2, "b", "c"), lane(3, "d")]).orderBy(F.col("rrf_score").desc(), "first").collect()]
    assert fused == ["b", "a", "d", "c"]


def test_threshold_comes_after_the_limit(spark):
    hits = spark.createDataFrame([("near", 0.31), ("far", 0.82)], "chunk_id string, distance double")
    assert [r.chunk_id for r in retrieval.vector_lane(hits, 1).collect()] == ["near"]


def test_trigrams(spark):
    sim = lambda a, b: one(spark, text.similarity(F.lit(a), F.lit(b)))
    assert sim("word", "word") == 1.0
    assert sim("abc", "xyz") == 0.0
    assert sim("", "") == 0.0
    assert abs(sim("word", "two words") - 4 / 11) < 1e-9


def test_cosine_of_a_zero_vector_is_null(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine_distance(v(0.0, 0.0), v(1.0, 0.0))) is None
    assert abs(one(spark, vectors.cosine_distance(v(1.0, 0.0), v(1.0, 1.0))) - (1 - 2**-0.5)) < 1e-12


def test_even_positions(spark):
    assert one(spark, budget.even(F.lit(100).cast("long"), 4)) == [0, 33, 66, 99]
    assert one(spark, budget.even(F.lit(3).cast("long"), 4)) == [0, 1, 2]


def test_prompt_budget(spark):
    assert one(spark, budget.prompt(F.lit(8192), F.lit(1200), 1000, 1.0)) == 5992
    assert one(spark, budget.prompt(F.lit(2600), F.lit(1200), 1000, 1.0)) is None


def test_prefix_cuts_the_last_row(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "g int, k int, t string")
    assert [r.t for r in budget.prefix(df, ["g"], [F.col("k")], "t", 6).orderBy("k").collect()] == ["aaaa", "bb"]


def test_frame_keys_of_an_inner_constructor(spark):
    keys = logs.frame_keys(F.lit("com.company.Batch$Worker"), F.lit("<init>"))
    assert one(spark, keys["package_name"]) == "com.company"
    assert one(spark, keys["classes"]) == ["Batch$Worker", "Batch", "Worker"]
    assert one(spark, keys["methods"]) == ["<init>", "Batch$Worker", "Batch", "Worker"]


def test_segments_have_250_lines_at_most(spark):
    lines = spark.createDataFrame([(1, k, "2024-01-01 00:00:00 INFO x" if k == 0 else "more") for k in range(251)], "log_id int, line_no int, line string")
    assert [r["n"] for r in logs.segments(lines).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [250, 1]


def test_spans_fill_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, "kind", 1, 1), (1, 1, 0, "A", 2, 1), (1, 1, 1, "x", 1, 1), (1, 2, 1, "y", 1, 1)], "table_id int, row int, col int, text string, row_span int, col_span int")
    grid = {(r.r, r.c): r.text for r in tables.expand(cells).collect()}
    assert grid[1, 0] == grid[2, 0] == "A"


def test_null_heartbeats_never_expire(spark):
    now = datetime.datetime(2024, 1, 31)
    old = now - datetime.timedelta(hours=1)
    jobs = spark.createDataFrame(
        [(1, "processing", 0, 0, 3, None, old), (2, "processing", 0, 3, 3, old, old), (3, "processing", 1, 1, 3, old, old), (4, "queued", 0, 0, 3, None, old), (5, "queued", 2, 0, 3, None, old)],
        "job_id int, status string, priority int, attempts long, max_attempts long, heartbeat_at timestamp_ntz, created_at timestamp_ntz",
    )
    after = {r.job_id: (r.status, r.attempts) for r in state.claim(jobs, F.lit(now).cast("timestamp_ntz"), 2).collect()}
    assert after == {1: ("processing", 0), 2: ("failed", 3), 3: ("processing", 2), 4: ("processing", 1), 5: ("queued", 0)}


def test_empty_descriptions_keep_the_old(spark):
    schema = "k string, description string, confidence double"
    old = spark.createDataFrame([("a", "old", 0.3), ("b", "old", 0.9)], schema)
    new = spark.createDataFrame([("a", "", 0.5), ("b", "new", 0.1), ("c", "", 0.2)], schema)
    after = {r.k: (r.description, r.confidence) for r in state.upsert(old, new, ["k"], ["description"], ["confidence"]).collect()}
    assert after == {"a": ("old", 0.5), "b": ("new", 0.9), "c": (None, 0.2)}


def test_lines_of_the_graph_protocol(spark):
    parsed = lambda line, c: one(spark, graph.parse_line(F.lit(line))[c])
    assert parsed("E|k|Name|system|core|3,4,3|said|more", "chunk_seqs") == [3, 4]
    assert parsed("E|k|Name|system|core|3|said|more", "description") == "said|more"
    assert parsed("R|a|b|sends_to|1|how", "type") == "sends_to"
    assert parsed("E|short|row", "kind") is None


def test_paragraph_cuts():
    from quarry.operators.chunking import cut, packed

    assert [len(x) for x in cut("a" * 3001)] == [3000, 1] and cut("a" * 3000) == ["a" * 3000]
    assert cut("a" * 1500 + "\n" + "b" * 2000)[1][0] == "\n" and len(cut("a" * 900 + "\n" + "b" * 2500)[0]) == 3000
    assert packed(["a", " b "]) == ["a\n\n b "] and packed(["a" * 2999, "b"]) == ["a" * 2999, "b"]


def test_semantic_chunks(spark):
    from quarry.operators.chunking import semantic

    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "A", words(30)), (1, 1, "B", words(30)), (1, 2, None, words(30)), (1, 3, "C", words(30))]
    got = semantic(spark.createDataFrame(rows, "doc_id int, position int, heading string, text string"), 100, 150).orderBy("seq").collect()
    assert [(r.heading, len(r.content.split())) for r in got] == [("B", 60), ("C", 60)]


def test_streams_work_off_a_folder(spark, tmp_path):
    from quarry.streaming import ingest

    rows = [(1, "x", datetime.datetime(2024, 1, 1)), (1, "x", datetime.datetime(2024, 1, 1)), (2, "x", datetime.datetime(2024, 1, 2)), (1, "y", datetime.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "asset_id int, text string, created_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.first_by_content(ingest.uploads(spark, f"{tmp_path}/in", df.schema))
    ingest.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_cover_density_matches_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    for terms in (["a"], ["a", "b"], ["a", "b", "c"], []):
        for _ in range(6):
            words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
            covers = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(words)), 2) if terms and set(terms) <= set(words[i : j + 1])]
            least = [c for c in covers if not any(x != c and c[0] <= x[0] and x[1] <= c[1] for x in covers)]
            want = sum(1.0 if j - i + 1 <= 16 else 16 / (j - i + 1) for i, j in least)
            got = one(spark, text.cover_density(F.split(F.lit(" ".join(words)), " "), terms))
            assert abs(got - want) < 1e-9


def test_table_chunks_overlap_by_a_row(spark):
    rows = spark.createDataFrame([(1, k, "x" * 10) for k in range(7)], "table_id int, r int, fact string")
    got = {}
    for x in tables.chunks(rows, 900, 3).orderBy("seq", "r").collect():
        got.setdefault(x.seq, []).append(x.r)
    assert got == {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5, 6]}


def test_continued_tables(spark):
    pairs = spark.createDataFrame([("k | v", "k | v", 1, 2, 2), ("k | v", "k | v", 2, 2, 2), ("k | v", "other", 1, 2, 2), ("k | v", "k | v", 0, 2, 3)], "a_header string, b_header string, page_gap int, a_cols int, b_cols int")
    assert tables.continued(pairs).count() == 1


def test_words_of_any_script(spark):
    rows = spark.createDataFrame([("한국 보험", "한국 보험"), ("한국", "중국"), ("", ""), ("Straße", "straße")], "a string, b string")
    assert [r[0] for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 1.0]
    heads = ["[별표40-1] 본인일부부담금", "2-4  암진단Ⅱ 보장 특별약관", "제2관 보험금의 지급", "제15조 (중도인출금)", "제3조의2", "특별약관 아님", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h string").select(text.heading(F.col("h"))).collect()]
    assert got == ["appendix", "special_clause", "section", "article", "article", None, None]


def test_answers_that_found_too_little(spark):
    said = ["문서에서  확인할 수 없습니다", "관련 문서가 부족합니다", "It does NOT contain that", "fine", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in said], "a string").select(text.is_insufficient(F.col("a"))).collect()] == [True, True, True, False, False]
    rows = spark.createDataFrame([("시스템 구성도와 API", False), ("성능 테스트", False), ("x", True)], "t string, image boolean")
    assert [r[0] for r in rows.select(text.architecture_points(F.col("t"), F.col("image"))).collect()] == [9, -3, 8]


def test_ocr_and_levels(spark):
    rows = spark.createDataFrame([("native_text", None), ("native_text", 0.9), ("native_text", 0.8), ("native_text", 0.7), ("scanned", None), ("scanned", 0.7)], "k string, s double")
    assert [r[0] for r in rows.select(text.ocr_engine(F.col("k"), F.col("s"))).collect()] == [None, None, "easyocr", "rapidocr", "easyocr", "rapidocr"]
    lines = spark.createDataFrame([("Severe: x, warning",), ("error ERROR",), ("terror",)], "line string")
    assert {r.level: r.n for r in logs.levels(lines).collect()} == {"SEVERE": 1, "WARN": 1, "ERROR": 2}
