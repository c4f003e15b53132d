"""Indexes as tables: inverted lists of vectors, postings of words with places, postings of trigrams.

Each is built by Spark, written in folders by a key, and searched by reading the folders
that a query needs: the filter on the key prunes the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..sources.store import small_batches, written

#: Files that a folder's rows are dealt to, so that a folder with a large part of all rows is several tasks' work.
FILES = 8


def _spread(rows: DataFrame, folder: str, key: str) -> DataFrame:
    return rows.repartition(F.col(folder), F.pmod(F.xxhash64(key), F.lit(FILES)))


# Vectors


@dataclass(frozen=True)
class VectorIndex:
    """``lists``: (list, vec_id, embedding, angle: to the list's centre) in folders by list; ``centres``: directions; ``reach``: the largest angle of each list.

    List -1 has the vectors of length 0, which have no direction and are near nothing.
    """

    lists: DataFrame
    centres: np.ndarray
    reach: dict[int, float]


def _unit(v: Column) -> Column:
    length = F.sqrt(vectors.dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / length)


def lowest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows whose keys hash lowest.

    Rows are counted in 65,536 stretches of hashes, so that tasks hand on only those up to the
    stretch in which the last one lies, and not ``most`` each.
    """
    hashed = F.xxhash64(key)
    stretch = F.shiftright(hashed, 48)
    counted = rows.groupBy(stretch.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    cut = counted.withColumn("n", F.sum("n").over(Window.orderBy("at"))).filter(F.col("n") >= most).agg(F.min("at")).first()[0]
    return (rows if cut is None else rows.filter(stretch <= cut)).orderBy(hashed, key).limit(most)


def build_vectors(embeddings: DataFrame, n_lists: int = 16, sample: int = 20_000, seed: int = 7) -> VectorIndex:
    """Inverted lists under a coarse quantiser: the centres are fitted on ``sample`` vectors at most (those whose ids hash lowest), every vector gets into a list.

    The sample is the only bound: it fits the centres and drops no vector. Null embeddings are in no list.
    """
    # made once, as they may come from joins, and met three times
    usable = written(embeddings.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding", (vectors.dot(F.col("embedding"), F.col("embedding")) > 0).alias("solid")), "vectors")
    solid = F.col("solid")
    learn = lowest(usable.filter(solid), "vec_id", sample).select(array_to_vector(_unit(F.col("embedding"))).alias("features")).cache()
    n = min(n_lists, learn.count())
    if n > 1:
        found = KMeans(k=n, seed=seed, maxIter=15, initMode="random", distanceMeasure="cosine").fit(learn).clusterCenters()
        centres = np.array([c / np.linalg.norm(c) for c in found if np.linalg.norm(c) > 0])
    else:
        centres = np.array([row.features.toArray() for row in learn.limit(1).collect()])
    learn.unpersist()

    @F.pandas_udf("struct<list:int,angle:double>")
    def nearest(v):
        """Of each vector the centre of the smallest angle."""
        import pandas as pd

        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, centres.shape[1]))
        cosine = np.clip(x / np.linalg.norm(x, axis=1, keepdims=True) @ centres.T, -1, 1)
        best = cosine.argmax(axis=1)
        return pd.DataFrame({"list": best.astype("int32"), "angle": np.arccos(cosine[np.arange(len(best)), best])})

    placed = usable.filter(solid).withColumn("at", nearest("embedding")).select("vec_id", "embedding", "at.angle", "at.list") if len(centres) else None
    nowhere = usable.filter(~solid).select("vec_id", "embedding", F.lit(0.0).alias("angle"), F.lit(-1).alias("list"))
    every = nowhere if placed is None else placed.unionByName(nowhere)
    lists = written(_spread(every, "list", "vec_id"), "vector-lists", "list")
    reach = {r.list: r.reach for r in lists.filter("list >= 0").groupBy("list").agg(F.max("angle").alias("reach")).collect()}  # one row a list
    return VectorIndex(lists, centres, reach)


def _within(index: VectorIndex, query: list[float], lists: list[int], k: int) -> DataFrame:
    at = F.array(*[F.lit(float(x)) for x in query])
    near = index.lists.filter(F.col("list").isin(lists)).select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), at), 9).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(k)


def _angles(index: VectorIndex, query: list[float]) -> list[tuple[float, int]]:
    """(angle to the centre, list), nearest first."""
    q = np.array(query, float)
    cosine = np.clip(index.centres @ (q / np.linalg.norm(q)), -1, 1) if len(index.centres) else []
    return sorted((float(math.acos(c)), k) for k, c in enumerate(cosine) if k in index.reach)


def nearest_vectors(index: VectorIndex, query: list[float], k: int, probes: int = 4) -> DataFrame:
    """(vec_id, distance): the k nearest in the ``probes`` nearest lists; only those are read."""
    if not any(query):
        return _within(index, query, [], k)
    return _within(index, query, [n for _, n in _angles(index, query)[:probes]], k)


def exact_nearest_vectors(index: VectorIndex, query: list[float], k: int, probes: int = 4) -> DataFrame:
    """(vec_id, distance): the k nearest of all, ties at the k-th included as far as k goes.

    No vector of a list is nearer than the angle to its centre less the list's reach. The
    nearest lists give a k-th distance; of the others only those are read that may go below it.
    """
    ranked = _angles(index, query) if any(query) else []
    first = [n for _, n in ranked[:probes]]
    found = _within(index, query, first, k).collect()  # k rows
    if len(found) == k:
        bound = found[-1].distance
        rest = [n for angle, n in ranked[probes:] if 1 - math.cos(max(angle - index.reach[n], 0.0)) <= bound + 1e-8]
    else:
        rest = [n for _, n in ranked[probes:]]
    return _within(index, query, first + rest, k)


# Words with places

#: What a word counts by its label, the weakest first.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Texts that are passed on at once, and words of which the places of one make a row of the index: more takes memory, fewer make more rows.
TEXTS, BLOCK = 1_000, 500_000


def _blocks(labels: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (key, words of each field) a row for each word of a field in a block of them: (term, label, keys, at)."""
    def listed(parts: list[tuple[pa.Array, pa.Array, np.ndarray]], label: str) -> pa.RecordBatch:
        word, key, at = zip(*parts)
        named = pa.concat_arrays(word).dictionary_encode()
        code = named.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(named.dictionary))))).astype(np.int32))
        keys, at = pa.concat_arrays(key).take(pa.array(order)), pa.array(np.concatenate(at)[order].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [named.dictionary, pa.array([label] * len(named.dictionary), pa.string()), pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, at)], ["term", "label", "keys", "at"]
        )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in labels], 0
        for batch in batches:
            begin = np.zeros(batch.num_rows, np.int64)
            for k in range(len(labels)):
                column = batch.column(k + 1)
                word, row = column.flatten(), pc.list_parent_indices(column).to_numpy()
                some = pc.not_equal(word, "")
                word, row = word.filter(some), row[some.to_numpy(zero_copy_only=False)]
                n = np.bincount(row, minlength=batch.num_rows)
                at = np.arange(len(row)) - (np.cumsum(n) - n - begin)[row]
                begin += n
                held[k].append((word, batch.column(0).take(pa.array(row)), at))
                size += len(row)
            if size >= BLOCK:
                yield from map(listed, held, labels)
                held, size = [[] for _ in labels], 0
        if size:
            yield from map(listed, held, labels)

    return made


def postings(docs: DataFrame, key: str, fields: dict[str, tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, label, keys, at: a place for each key) in folders by bucket of the word's hash.

    ``fields``: column -> (label, what separates its words); places go on from one field to the next.
    A row has a word's places among ``BLOCK`` words (and the rest of ``TEXTS`` texts) at most, so a word that stands in
    a third of all texts is many rows, and no list of all its places is gathered. Each task writes what it
    has read: places are neither shuffled nor rows of their own.
    """
    split = [F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), apart).alias(f"_{n}") for n, (c, (_, apart)) in enumerate(fields.items())]
    key_type = docs.schema[key].dataType.simpleString()
    made = docs.select(key, *split).mapInArrow(_blocks([label for label, _ in fields.values()]), f"term string, label string, keys array<{key_type}>, at array<int>")
    with small_batches(docs.sparkSession, TEXTS):
        return written(made.withColumn("bucket", _bucket(F.col("term"), buckets)), "postings", "bucket")


def _places(index: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    spark = index.sparkSession
    wanted = sorted({r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(_bucket(F.col("t"), buckets)).collect()})  # one for each word of the query
    return index.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))


def covering(index: DataFrame, key: str, terms: list[str], buckets: int = BUCKETS, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, n, score) of texts that hold all terms: how often they do, and their cover density.

    Only postings of the query's words are read; texts are intersected by counting words. A
    cover is a shortest stretch with all terms; it counts with the harmonic mean of its places'
    weights, divided by one more than the places between its ends that hold none of the terms.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return index.select(F.explode("keys").alias(key)).select(key, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score")).limit(0)
    scale = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])
    which = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int")
    each = _places(index, terms, buckets).select(which.alias("t"), scale[F.col("label")].alias("w"), F.inline(F.arrays_zip(F.col("keys").alias(key), "at")))
    held = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "t", "w"))).alias("places")).filter(F.size(F.array_distinct("places.t")) == len(terms))
    return held.select(key, F.size("places").cast("long").alias("n"), F.round(_density(F.col("places"), len(terms)), 9).alias("score"))


def _density(places: Column, n_terms: int) -> Column:
    """Of places in order; ``last``: for each term the number of its last place, so that a cover is a slice."""
    state = "struct<last:array<int>,from:int,score:double>"
    start = F.struct(F.array(*[F.lit(-1)] * n_terms).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score")).cast(state)
    numbered = F.transform(places, lambda x, i: F.struct(x["at"].alias("at"), x["t"].alias("t"), i.alias("i")))

    def gain(first: Column, x: Column) -> Column:
        inside = F.slice(places, first + 1, x["i"] - first + 1)
        noise = F.greatest((x["at"] - inside[0]["at"]) - (F.size(inside) - 1), F.lit(0))  # rows of one key count once
        return F.size(inside) / F.aggregate(inside, F.lit(0.0), lambda a, p: a + F.lit(1.0) / p["w"]) / (noise + 1)

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, k: F.when(k + 1 == x["t"], x["i"]).otherwise(v))
        first = F.array_min(last)
        return F.struct(last.alias("last"), F.greatest(first, s["from"]).alias("from"), (s["score"] + F.when(first > s["from"], gain(first, x)).otherwise(0.0)).alias("score")).cast(state)

    return F.aggregate(numbered, start, step)["score"]


# Trigrams


def trigram_postings(named: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gram, key, n: distinct trigrams of the name) in folders by bucket of the trigram's hash."""
    grams = named.select(key, text.trigrams(F.coalesce(F.col(name), F.lit(""))).alias("_g"))
    each = grams.select(key, F.size("_g").alias("n"), F.explode("_g").alias("gram"))
    return written(_spread(each.withColumn("bucket", _bucket(F.col("gram"), buckets)), "bucket", key), "trigrams", "bucket")


def alike(index: DataFrame, key: str, queries: DataFrame, query_key: str, query: str, least: float = 0.35) -> DataFrame:
    """(query_key, key, score) of names whose trigram similarity with a query's is ``least`` or more: a join on trigrams.

    Names of x and y trigrams that share c have the similarity c / (x + y - c), so they share
    c >= least / (1 + least) * (x + y), and x and y differ by the factor ``least`` at most. Of a
    query only the rarest trigrams have to meet: whoever shares c of its y shares one of any
    y - c + 1. Pairs that do are then counted over all of the query's trigrams.
    """
    grams = queries.select(query_key, text.trigrams(F.coalesce(F.col(query), F.lit(""))).alias("_g")).filter(F.size("_g") > 0).withColumn("m", F.size("_g"))
    asked = written(grams.select(query_key, "m", F.explode("_g").alias("gram")), "query-trigrams")
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = asked.join(common, "gram").groupBy(query_key, "m").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"))
    # c >= least * max(x, y) >= least * y: all but so many of the query's trigrams, the rarest ones
    need = (F.col("m") - F.ceil(least * F.col("m") - 1e-9) + 1).cast("int")
    missing = F.col("m") - F.size("order")  # trigrams that no name has
    prefix = ranked.select(query_key, "m", F.explode(F.slice("order", F.lit(1), F.greatest(need - missing, F.lit(0)))).alias("o")).select(query_key, "m", F.col("o.gram").alias("gram"))
    size = (F.col("n") >= least * F.col("m") - 1e-9) & (F.col("n") * least <= F.col("m") + 1e-9)
    met = prefix.join(index, "gram").filter(size).select(query_key, "m", key, "n").distinct()
    counted = met.join(asked.select(query_key, "gram"), query_key).join(index.select(key, "gram"), [key, "gram"]).groupBy(query_key, key, "m", "n").agg(F.count(F.lit(1)).alias("c"))
    score = F.col("c") / (F.col("m") + F.col("n") - F.col("c"))
    return counted.select(query_key, key, score.alias("score")).filter(F.col("score") >= least)
