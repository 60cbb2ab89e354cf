"""Quality classifier by Bradley-Terry pairwise ranking.

A pair (good document, bad document) says that the first is preferred; the
probability of that preference is the logistic function of the difference of the
two documents' scores, and a score is linear in text features. So the weights are
those of a logistic regression without intercept on feature differences. A quantile
of the labelled scores is then the threshold, which the calibrated score puts at a
fixed value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fit_logistic, label_sample, labelled_texts, map_batches, sigmoid
from .textstats import text_stats

#: Where the calibrated score puts the threshold.
CUT = 0.7


def features(text: str | None) -> list[float]:
    """Bounded features of a whole text (all zero for null, empty or blank texts)."""
    n, chars, syms, lines, dup, rep, upper, letters, digits, bangs, adj, distinct = text_stats(text)
    if not n:
        return [0.0] * 14
    root = math.sqrt
    return [
        min(1.0, 4 * syms / chars), root(syms / chars),
        min(1.0, upper / letters) if letters else 0.0, float(bool(letters) and upper > 0.5 * letters),
        min(1.0, bangs / n), root(min(1.0, bangs / n)),
        rep / n, root(rep / n), adj / n, root(adj / n),
        dup / lines if lines else 0.0,
        digits / chars,
        min(1.0, distinct / n * root(n) / 12.0),
        min(1.0, math.log1p(n) / 10.0),
    ]


@dataclass(frozen=True)
class RankModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights)
        return sigmoid(self.slope * (s - self.threshold) + math.log(CUT / (1 - CUT)))


def fit_rank(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, seed: int = 11) -> RankModel | None:
    """Weights from at most ``pairs`` preference pairs; None without both labels.

    Every bad row is paired in turn with good rows drawn by a seeded generator. The
    threshold is the score quantile, among 1/400 steps, with the least balanced error.
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    take = max(1, min(pairs, 40 * max(len(good), len(bad))))
    diff = (good[rng.integers(0, len(good), take)] - bad[np.arange(take) % len(bad)]) / scale
    # each pair counts once in each direction, so that no intercept is needed
    both, won = np.vstack([diff, -diff]), np.r_[np.ones(take), np.zeros(take)]
    w = fit_logistic(both, won, l2=2e-4, intercept=False)
    s = (x - mean) / scale @ w
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    errors = [float((s[y == 1] < c).mean() + (s[y == 0] >= c).mean()) for c in cuts]
    least = min(errors)
    flat = [c for c, e in zip(cuts, errors) if e <= least + 1e-9]
    cut = float((flat[0] + flat[-1]) / 2)
    spread = max(float(np.abs(np.median(s[y == 1]) - cut)), 1e-6)
    return RankModel(tuple(mean), tuple(scale), tuple(w), cut, 3.0 / spread)


def learn(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, max_labelled: int) -> RankModel | None:
    """The model of at most ``max_labelled`` labelled ids outside the held-out remainder."""

    def train(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    sample = label_sample(labels, "quality", modulus, remainder, max_labelled)
    rows = map_batches(labelled_texts(docs, sample), train, "x array<double>, y int").collect()
    if not rows:
        return None
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    order = np.lexsort(np.vstack([y[None, :], x.T]))
    return fit_rank(x[order], y[order])


def scores(model: RankModel | None, texts: list[str | None]) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts])) if model else np.full(len(texts), CUT)


def rank_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2,
                 max_labelled: int = 20_000) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    ``labels`` (doc_id, quality): training uses at most ``max_labelled`` ids, the
    first by a hash of the id, outside the held-out remainder. Without labels of both
    kinds nothing can be ranked: every score is the threshold value. Null and empty
    texts have zero features and a score like any other text; repeated rows get equal
    scores; an empty table gives no rows; other columns are not read.
    """
    model = learn(docs, labels, modulus, remainder, max_labelled)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(model, b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2,
                 max_labelled: int = 20_000) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches the threshold."""
    model = learn(docs, labels, modulus, remainder, max_labelled)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(scores(model, b.column(at).to_pylist()) >= CUT))

    return map_batches(docs, run, docs.schema)
