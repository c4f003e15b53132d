"""Vectors of texts from a pluggable service: batches, cut inputs, checked answers, attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A service: a list of texts to one vector each, in order.
Embedder = Callable[[list[str]], list[list[float]]]


class Retryable(Exception):
    """What a service raises when a later attempt may succeed; ``after``: the seconds that it asks for."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def _asked(embed: Embedder, texts: list[str], attempts: int, base: float, most: float) -> list[list[float]]:
    for attempt in range(1, attempts + 1):
        try:
            return embed(texts)
        except Retryable as error:
            if attempt == attempts:
                raise
            time.sleep(max(0.0, error.after) if error.after is not None else min(base * 2 ** (attempt - 1), most))
    raise ValueError("at least one attempt is needed")


def _checked(vectors: list[list[float]], n: int, dimension: int) -> list[np.ndarray]:
    if len(vectors) != n:
        raise ValueError(f"the service gave {len(vectors)} vectors for {n} texts")
    made = [np.asarray(v, dtype="float32") for v in vectors]
    for v in made:
        if v.shape != (dimension,) or not np.isfinite(v).all():
            raise ValueError(f"vectors must have {dimension} finite numbers")
    return made


def embedded(texts: DataFrame, embed: Embedder, dimension: int, key: str, content: str, batch: int = 8, most_characters: int = 8000, attempts: int = 3, base: float = 0.5, most_wait: float = 3.0) -> DataFrame:
    """(key, embedding): the vector of each text, of which the service gets ``most_characters``; a null text is read as an empty one.

    Tasks ask for ``batch`` texts at a time and hold no more vectors than an Arrow batch has
    rows. A wrong count, a wrong dimension or a number that is not finite ends the job. Equal
    texts are asked for once in an Arrow batch; an empty table asks nothing.
    """

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [(t or "")[:most_characters] for t in f[content]]
            each = list(dict.fromkeys(said))
            known: dict[str, np.ndarray] = {}
            for k in range(0, len(each), batch):
                some = each[k : k + batch]
                known.update(zip(some, _checked(_asked(embed, some, attempts, base, most_wait), len(some), dimension)))
            yield pd.DataFrame({key: f[key], "embedding": [known[t] for t in said]})

    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<float>"
    return texts.select(key, content).mapInPandas(made, schema)


def again(chunks: DataFrame, old: DataFrame, embed: Embedder, dimension: int, key: str, content: str, **limits) -> DataFrame:
    """(key, content_hash, embedding): vectors of ``old`` (of the same columns) stay where the text is the same; only others are asked for. Keys that are gone go."""
    now = chunks.select(key, content, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"))
    kept = old.join(now.select(key, "content_hash"), [key, "content_hash"], "left_semi").select(key, "content_hash", "embedding")
    new = now.join(kept.select(key), key, "left_anti")
    made = embedded(new.withColumn("_key", F.struct(key, "content_hash")), embed, dimension, "_key", content, **limits)
    return kept.unionByName(made.select(f"_key.{key}", "_key.content_hash", "embedding"))
