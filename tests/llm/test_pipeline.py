"""The stages of the corpus pipeline on planted cases."""

import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = {i: "\n".join(line(15) for _ in range(6)) for i in range(20)}
    item, passage = line(30), line(60)
    near = clean[0].split()  # other line breaks: line dedup can't see it
    near[10] = "changed"
    texts = clean | {50: " ".join(near), 51: clean[1], 52: line(40) + " " + item, 53: "junk ### " * 30, 54: "too short"}
    texts |= {60: line(40) + "\n" + passage, 61: line(40) + "\n" + passage}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, rows = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in rows.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == COLUMNS
        assert set(clean) <= set(seen[name])
    assert not {53, 54} & set(seen["quality rules"])
    assert passage in seen["line dedup"][60].text and passage not in seen["line dedup"][61].text and 51 not in seen["line dedup"]
    assert 50 not in seen["MinHash near-dedup"] and 52 not in seen["benchmark decontamination"]
    last = seen["SentencePiece encoding and decoding"]
    assert all(r.round_trip for r in last.values()) and {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(last)


def test_stages_on_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(15)) for _ in range(6))
    a, b, long = text(), text(), "\n".join(text() for _ in range(400))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines_deleted string, _k int, copy string, node string, hit string"
    rows = [(1, None), (2, ""), (3, " \n "), (None, a), (5, b), (5, b), (6, long)]
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, expected in ((rows, [None, 5, 6]), ([], [])):
        docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, "c", "n", "h") for i, t in rows], schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        got = docs.collect()
        assert sorted((r.doc_id for r in got), key=lambda i: i or 0) == expected and all(r.round_trip for r in got)
