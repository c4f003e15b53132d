"""Quality scores by Bradley-Terry ranking.

A document's worth is a linear function of its features; that a good document beats a bad
one has the probability 1 / (1 + exp(-(difference of worths))). Fitting is logistic
regression on feature differences of (good, bad) pairs. Worths become scores from 0 to 1
by a shift that puts a quantile of the worths at the threshold: with a share q of bad
documents among the labelled ones, the q-quantile scores 0.7.

Fitting uses a bounded sample of labelled rows (``max_rows``, taken by a hash of the id,
so that it is the same at every run) and ``max_pairs`` pairs of them; scoring runs over
all rows inside Spark without Python.

Defined results: null and empty texts have zero features and get the score that the model
gives them; null labels and null ids are not learned from; documents labelled twice count
twice; without labels of both kinds every score is 0.5; long texts count whole; rows are
scored one for one, repeated ones alike; an empty table of documents gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_length", "symbols", "exclaims", "pipes", "upper", "digits", "capitals", "stops", "distinct", "repeats", "line_length", "lone_signs",
)


def features(text: Column) -> dict[str, Column]:
    """Features of a text, from counts over the whole of it."""
    text = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    kept = lambda p: F.length(F.regexp_replace(text, p, "")).cast("double")
    return {
        "_n": F.size("_w").cast("double"),
        "_chars": F.length(text).cast("double"),
        "_solid": kept(r"[\x20\x09-\x0D]+"),
        "_symbols": kept(r"[^#*$%&<>@^~]+"),
        "_exclaims": kept(r"[^!]+"),
        "_pipes": kept(r"[^|]+"),
        "_upper": kept(r"\P{Lu}+"),
        "_digits": kept(r"\P{Nd}+"),
        "_capitals": count(r"(?<![^\s])\p{Lu}\p{Ll}*"),
        "_stops": kept(r"[^.?]+"),
        "_distinct": F.size(F.array_distinct("_w")).cast("double"),
        "_lines": count(r"\n") + 1,
        "_lone": count(r"(?<![^\s])[^\p{L}\p{N}\s]+(?![^\s])"),
    }


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x: array of features), a row for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_w"))
    df = df.select("doc_id", *[c.alias(n) for n, c in features(F.col("_t")).items()])
    n, solid = F.greatest(F.col("_n"), F.lit(1.0)), F.greatest(F.col("_solid"), F.lit(1.0))
    x = {
        "log_words": F.log1p("_n"),
        "word_length": F.least(F.col("_solid") / n, F.lit(30.0)),
        "symbols": F.least(F.col("_symbols") / n, F.lit(3.0)),
        "exclaims": F.least(F.col("_exclaims") / n, F.lit(3.0)),
        "pipes": F.least(F.col("_pipes") / n, F.lit(3.0)),
        "upper": F.col("_upper") / solid,
        "digits": F.col("_digits") / solid,
        "capitals": F.col("_capitals") / n,
        "stops": F.least(F.col("_stops") / n, F.lit(3.0)),
        "distinct": F.col("_distinct") / n,
        "repeats": F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_distinct") / F.pow(n, F.lit(0.85))),
        "line_length": F.log1p(F.col("_n") / F.col("_lines")),
        "lone_signs": F.col("_lone") / n,
    }
    return df.select("doc_id", F.array(*[x[f] for f in FEATURES]).alias("x"))


@dataclass(frozen=True)
class Model:
    """worth = sum(weights * x); score = 1 / (1 + exp(-(slope * (worth - cut) + shift)))."""

    weights: tuple[float, ...]
    cut: float
    slope: float

    def score(self, x: Column) -> Column:
        worth = sum((F.lit(w) * F.get(x, F.lit(k)) for k, w in enumerate(self.weights)), F.lit(0.0))
        shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * (worth - F.lit(self.cut)) + F.lit(shift))))


#: Gives every document a half.
UNKNOWN = Model((0.0,) * len(FEATURES), float(np.log(THRESHOLD / (1 - THRESHOLD))), 1.0)


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = 200_000, seed: int = 7, steps: int = 60, ridge: float = 1e-4) -> Model:
    """Newton's method on the logistic loss of feature differences."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return UNKNOWN
    scale = np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    d = (good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / n - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = w / scale
    worth = x @ weights
    below, above = worth[y == 0], worth[y == 1]
    # where the two kinds part, the quantile of bad documents is a point between them
    cut = np.quantile(worth, (y == 0).mean())
    order = np.argsort(worth)
    k = int((y == 0).sum())
    if 0 < k < len(order):
        cut = (worth[order[k - 1]] + worth[order[k]]) / 2
    spread = max(above.mean() - below.mean(), 1e-6)
    return Model(tuple(map(float, weights)), float(cut), float(8 / spread))


def train(featured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 40_000) -> Model:
    """Fits on at most ``max_rows`` labelled rows of (doc_id, x)."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = featured.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "_y").limit(max_rows).select("x", "_y").toPandas()
    if rows.empty:
        return UNKNOWN
    return fit(np.stack(rows["x"].to_numpy()).astype(float), rows["_y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, max_rows: int = 40_000) -> DataFrame:
    """(doc_id, score, predicted) of every document; labels where ``held_out`` holds are not learned from."""
    learned = labels if held_out is None else labels.filter(~held_out)
    # texts are joined with the labels before their features are made, so that only labelled ones are
    wanted = learned.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    sample = wanted.orderBy(F.xxhash64("_id")).limit(max_rows)
    some = docs.join(F.broadcast(sample), docs[id_col] == sample["_id"], "left_semi")
    model = train(with_features(some, id_col, text_col), learned, id_col=id_col, max_rows=max_rows)
    scored = with_features(docs, id_col, text_col).select("doc_id", model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
