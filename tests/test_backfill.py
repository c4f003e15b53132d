"""The graph of versions: what is left is worked off, once, and only what is well-formed gets in."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import backfill as B
from quarry.sources.snapshots import Store


def lines_of(*lines):
    def extract(texts):
        made = F.array(*map(F.lit, lines))
        return texts.select("version_id", F.posexplode(made).alias("i", "line")).select("version_id", F.col("i").cast("long").alias("line_no"), "line")

    return extract


def chunks(spark, versions, n=3):
    return spark.createDataFrame([(v, k, f"text {v} {k}") for v in versions for k in range(n)], "version_id long, chunk_seq long, display_content string")


def test_only_well_formed_rows_get_in(spark):
    lines = [
        "E|db|Order DB|database||1,9|stores", "`E|api|API|service|core|2, 3|serves`", "E|db|Other|x||2|later", "E||nameless|x||1|", "E|none||x||1|",
        "R|api|db|reads|2|by SQL", "R|api|db|reads|3|again", "R|api|gone|reads|1|", "R|api|api|self|1|", "R|db|api|late|9|out of range", "R|db|api|none||no evidence", "chat",
    ]
    entities, relations = B.extracted(chunks(spark, [1]), lines_of(*lines), F.lit(0))
    assert sorted((r.key, r.name, list(r.chunk_seqs), r.normalized_name) for r in entities.collect()) == [("api", "API", [2, 3], "api"), ("db", "Order DB", [1, 2], "orderdb")]
    assert [(r.source_key, r.target_key, r.type, list(r.chunk_seqs), r.description) for r in relations.collect()] == [("api", "db", "reads", [2, 3], "by SQL")]
    few, none = B.extracted(chunks(spark, [1]), lines_of(*lines), F.lit(0), max_entities=1)
    assert [r.key for r in few.collect()] == ["db"] and none.count() == 0


def test_selection_and_budget(spark):
    rows = chunks(spark, [1, 2], 30)
    points = F.when(F.col("chunk_seq").isin(7, 11, 17), 5).otherwise(0)
    got = sorted(r.chunk_seq for r in B.selected(rows, points, 6).filter("version_id = 1").collect())
    assert len(got) == 6 and {7, 11, 17} <= set(got) and max(got) - min(got) > 15
    assert B.selected(rows, points, 100).count() == 60
    said = {r.version_id: r.text for r in B.texts(rows, 40).collect()}
    assert said[1] == "[1] text 1 0\n[2] text 1 1\n[3] text 1 2"


def test_an_interrupted_run_goes_on(spark, tmp_path):
    store, rows, seen = Store(spark, str(tmp_path)), chunks(spark, range(1, 8)), []

    def extractor(texts, fail_at=None):
        ids = sorted(r.version_id for r in texts.select("version_id").collect())
        if fail_at in ids:
            raise RuntimeError("service is away")
        seen.append(ids)
        return lines_of("E|a|A|x||1|", "E|b|B|x||2|", "R|a|b|to|1|")(texts)

    go = lambda f=extractor, **how: B.run(store, rows.select("version_id"), rows, f, F.lit(0), batch=3, **how)
    with pytest.raises(RuntimeError):
        go(lambda t: extractor(t, fail_at=5))
    assert seen == [[1, 2, 3]] and store.read("relations").count() == 3
    assert go() == 4 and seen[1:] == [[4, 5, 6], [7]]
    assert go() == 0 and len(seen) == 3  # a second run does nothing
    assert store.read("entities").count() == 14 and store.read("ledger").count() == 7
    assert go(force=True) == 7 and store.read("entities").count() == 14 and store.read("ledger").count() == 7


def test_chunks_are_made_once_for_all_batches(spark, tmp_path):
    store, made = Store(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = chunks(spark, range(1, 21))
    once = rows.mapInPandas(counted, rows.schema)
    assert B.run(store, rows.select("version_id"), once, lines_of("E|a|A|x||1|"), F.lit(0), batch=4) == 20
    assert made.value == 60 and store.read("entities").count() == 20


def test_batches_are_whole_and_in_order(spark):
    ids = spark.createDataFrame([(3 * i,) for i in range(50)] + [(None,)], "version_id long").repartition(7)
    got = {}
    for r in B.in_batches(ids, 8).collect():
        got.setdefault(r["_batch"], []).append(r.version_id)
    assert sorted(x for xs in got.values() for x in xs) == [3 * i for i in range(50)]
    assert [(k, min(xs), len(xs)) for k, xs in sorted(got.items())] == [(k, 24 * k, min(8, 50 - 8 * k)) for k in range(7)]
