"""Indexes against brute force: recall and exactness of vectors, cover density by hand, trigrams of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import indexes as I

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters and lone vectors, copies, a null and one without direction."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.4, size=16)]) for i in range(900)]
    rows += [(900 + i, [float(x) for x in rng.normal(size=16)]) for i in range(100)] + [(2000, rows[5][1]), (2001, rows[5][1]), (2002, [0.0] * 16), (2003, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {i: np.array(v) for i, v in rows if v and any(v)}


def nearest(held, q, k):
    q = np.array(q)
    scored = sorted((round(1 - float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 9), i) for i, v in held.items())
    return [i for _, i in scored[:k]]


def test_inverted_lists(spark, vectors):
    df, held = vectors
    index = I.build_vectors(df, n_lists=12)
    assert sorted(r.vec_id for r in index.lists.select("vec_id").collect()) == sorted([*held, 2002])
    hits = total = 0
    for i in range(0, 1000, 100):  # the queries of the index's contract: ids divisible by 100, against all rows
        q = held[i].tolist()
        expected = nearest(held, q, 40)
        assert [r.vec_id for r in I.exact_nearest_vectors(index, q, 40, probes=1).collect()] == expected
        hits += len(set(expected) & {r.vec_id for r in I.nearest_vectors(index, q, 40).collect()})
        total += 40
    assert hits / total >= 0.9
    assert I.nearest_vectors(index, [0.0] * 16, 5).count() == 0
    plan = I.nearest_vectors(index, held[0].tolist(), 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list#" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]


def test_recall_over_the_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    index = I.build_vectors(df)
    held = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    hits = total = 0
    for i in [i for i in held if i % 100 == 0]:
        expected = nearest(held, held[i], 10)
        hits += len(set(expected) & {r.vec_id for r in I.nearest_vectors(index, held[i].tolist(), 10, probes=10).collect()})
        total += len(expected)
        assert [r.vec_id for r in I.exact_nearest_vectors(index, held[i].tolist(), 10).collect()] == expected
    assert hits / total >= 0.9


def test_vectors_of_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    none = I.build_vectors(spark.createDataFrame([], schema))
    assert I.exact_nearest_vectors(none, [1.0, 0.0], 3).count() == 0
    one = I.build_vectors(spark.createDataFrame([(1, [0.0, 2.0]), (2, [0.0, 0.0])], schema))
    assert [tuple(r) for r in I.exact_nearest_vectors(one, [0.0, 1.0], 3).collect()] == [(1, 0.0)]


def density(words, labels, terms, weights):
    """All stretches with all terms that hold no shorter one, by hand."""
    found = []
    for a in range(len(words)):
        for b in range(a, len(words)):
            if set(terms) <= set(words[a : b + 1]) and not any(set(terms) <= set(words[c : e + 1]) for c, e in ((a + 1, b), (a, b - 1))):
                found.append((a, b))
    score = 0.0
    for a, b in found:
        at = [k for k in range(a, b + 1) if words[k] in terms]
        score += len(at) / sum(1 / weights[labels[k]] for k in at) / (1 + (b - a) - (len(at) - 1))
    return round(score, 9)


def test_postings_and_cover_density(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("ABCX") for _ in range(rng.randrange(3))), " ".join(rng.choice("a b c x y é 한글".split()) for _ in range(rng.randrange(25)))) for i in range(80)]
    docs += [(100, None, "a, B; c"), (101, "", ""), (102, "A B C", None)]
    df = spark.createDataFrame(docs, "id long, head string, body string")
    index = I.postings(df, "id", {"head": ("A", text.APART), "body": ("D", text.APART)}, buckets=8)
    for terms in (["a", "b"], ["a", "b", "c"], ["A"], ["a", "a"], ["한글", "é"], ["a", "nowhere"], []):
        wanted = list(dict.fromkeys(t.lower() for t in terms))
        expected = {}
        for i, head, body in docs:
            h, b = (head or "").lower().split(), [w.strip(",;") for w in (body or "").lower().split()]
            if wanted and set(wanted) <= set(h + b):
                expected[i] = (sum(w in wanted for w in h + b), density(h + b, ["A"] * len(h) + ["D"] * len(b), wanted, I.WEIGHTS))
        got = {r.id: (r.n, r.score) for r in I.covering(index, "id", terms, buckets=8).collect()}
        assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], abs=2e-9) for i in got)
    plan = I.covering(index, "id", ["a", "b"], buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0] and "body" not in plan


def test_alike_equals_all_pairs(spark):
    rng = random.Random(8)
    part = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    names = [(i, " ".join(part() for _ in range(rng.randrange(1, 4)))) for i in range(120)] + [(200, ""), (201, None), (202, "한글 이름"), (203, "한글 이름"), (204, "...")]
    df = spark.createDataFrame(names, "id long, name string")
    asked = df.filter("id % 5 < 3").select(F.col("id").alias("q"), F.col("name").alias("asked"))
    got = {(r.q, r.id): r.score for r in I.alike(I.trigram_postings(df, "id", "name", buckets=4), "id", asked, "q", "asked").collect()}
    both = df.join(asked).select("q", "id", text.similarity(F.coalesce("name", F.lit("")), F.coalesce("asked", F.lit(""))).alias("s")).filter("s >= 0.35")
    assert got == pytest.approx({(r.q, r.id): r.s for r in both.collect()})
    assert len(got) > 100 and (202, 203) in got


def test_a_sample_takes_little_through_one_task(spark):
    """Of many parts only rows near the sample are handed on, and they are those of the lowest hashes; vectors are made once."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    ids = spark.range(0, 40_000, 1, 8).withColumnRenamed("id", "vec_id")
    got = [r.vec_id for r in I.lowest(ids, "vec_id", 500).collect()]
    assert got == [r.vec_id for r in ids.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()]
    assert I.lowest(ids.limit(30), "vec_id", 500).count() == 30 and I.lowest(ids.limit(0), "vec_id", 5).count() == 0
    every = ids.limit(3000).select("vec_id", F.array(F.sin("vec_id"), F.cos("vec_id")).alias("embedding")).localCheckpoint()
    index = I.build_vectors(every.mapInPandas(counted, every.schema), n_lists=4, sample=200)
    assert index.lists.count() == 3000 and made.value == 3000


def test_postings_are_lists_of_many_texts(spark):
    """A row of the index has a word's places in many texts; rows of one key meet again in a search, and their covers count once."""
    df = spark.range(0, 3000, 1, 3).select("id", F.lit("a b c").alias("body"))
    index = I.postings(df, "id", {"body": ("D", text.APART)}, buckets=4)
    assert index.count() == 9 and index.select(F.explode("at")).count() == 9000
    twice = I.postings(df.unionByName(df), "id", {"body": ("D", text.APART)}, buckets=4)
    once = {(r.id, r.n, r.score) for r in I.covering(index, "id", ["a", "b"], buckets=4).collect()}
    assert {(r.id, r.n / 2, r.score) for r in I.covering(twice, "id", ["a", "b"], buckets=4).collect()} == once and len(once) == 3000
