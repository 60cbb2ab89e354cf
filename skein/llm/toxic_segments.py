"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of toxic against clean use with an informative Dirichlet prior;
a linear scan finds every maximal scoring segment of a text (Ruzzo and Tompa); the
segments' scores are turned into expected counts of chance segments by the extreme
value law (Karlin and Altschul), and a document's least expected count into a score.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, label_sample, labelled_texts, map_batches, sigmoid, written

_WORD = regex.compile(r"\p{L}+")
#: Word beginnings of this length are tokens of their own, so that inflected forms count.
STEM = 4
#: Score of a token that the model does not hold.
DRIFT = -0.2
TOP = 6.0


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence in which
    the listed positions have the given positive scores and all others ``drift`` < 0.

    The stack holds candidates with the cumulative score before and after each; a new
    candidate joins backwards with the nearest one that starts lower, if that one does
    not end higher. Every candidate is pushed and removed at most once: linear time.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, after = 0.0, 0
    for at, s in scores:
        total += drift * (at - after)
        cand = (at, at + 1, total, total + s)
        total, after = total + s, at + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cand[2]:
                j -= 1
            if j < 0 or stack[j][3] >= cand[3]:
                # candidates between j and the end stay: they are maximal on their own
                stack.append(cand)
                break
            cand = (stack[j][0], cand[1], stack[j][2], cand[3])
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


@dataclass(frozen=True)
class ToxicModel:
    odds: dict[str, float]
    lam: float
    log_k: float
    slope: float
    offset: float

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        odds, out = self.odds, []
        for i, w in enumerate(words):
            s = odds.get(w)
            if s is None:
                s = odds.get("^" + w[:STEM]) if len(w) > STEM else None
            if s is not None:
                out.append((i, s))
        return out

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(minus log of the chance count of the best segments, all segments).
        The r best segments count together: the sum of their normalised scores
        against r! ways to order them."""
        words = tokens(text)
        found = segments(self.hits(words))
        if not found:
            return 0.0, []
        base = self.log_k + math.log(len(words) + 50.0)
        best, total, fact = 0.0, 0.0, 0.0
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            total += self.lam * s - base
            fact += math.log(r)
            best = max(best, total + fact)
        return best, found

    def score(self, evidence: float) -> float:
        return float(sigmoid(self.slope * min(evidence, 200.0) + self.offset))


def _token_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """(token, toxic uses, clean uses): a token counts once per text."""
    got: dict[str, list[int]] = {}
    for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        words = set(tokens(t))
        for w in words | {"^" + x[:STEM] for x in words if len(x) > STEM}:
            got.setdefault(w, [0, 0])[0 if y else 1] += 1
    return pa.RecordBatch.from_arrays(
        [pa.array(list(got), pa.string()), pa.array([v[0] for v in got.values()], pa.int64()),
         pa.array([v[1] for v in got.values()], pa.int64())], ["token", "tox", "clean"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per group of (near) copies within a label: texts whose three-word
    shingles have the same least hash. Without this, every word of one much-copied
    toxic text would look toxic."""

    def key(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for t in b.column(0).to_pylist():
            w = tokens(t)
            shingles = zip(w, w[1:], w[2:]) if len(w) > 2 else [tuple(w)]
            keys.append(min(zlib.crc32(" ".join(x).encode()) for x in shingles))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["text", "y", "key"])

    keyed = map_batches(rows, key, "text string, y int, key bigint")
    return keyed.groupBy("key", "y").agg(F.min("text").alias("text")).select("text", "y")


def token_odds(rows: DataFrame, prior_share: float, max_tokens: int, least_z: float, least_odds: float) -> dict[str, float]:
    """The ``max_tokens`` tokens with the largest z of the Dirichlet-smoothed log-odds
    (z and log-odds at least the given), computed natively over all tokens of the sample."""
    counts = map_batches(rows, _token_rows, "token string, tox bigint, clean bigint").groupBy("token").agg(
        F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    n1, n0 = float(n.t), float(n.n - n.t)
    if not n1 or not n0:
        return {}
    # the prior of either class: so many texts, of which the token has its share of all texts
    prior_weight = prior_share * (n1 + n0)
    prior = f"({prior_weight} * (tox + clean + 0.5) / {n1 + n0 + 1})"
    odds = (f"ln((tox + {prior}) / ({n1 + prior_weight} - tox - {prior} + 0.5))"
            f" - ln((clean + {prior}) / ({n0 + prior_weight} - clean - {prior} + 0.5))")
    z = f"({odds}) / sqrt(1 / (tox + {prior}) + 1 / (clean + {prior}))"
    top = (counts.where("tox >= 3").select("token", F.expr(odds).alias("odds"), F.expr(z).alias("z"))
           .where((F.col("z") >= least_z) & (F.col("odds") >= least_odds))
           .orderBy(F.col("z").desc(), "token").limit(max_tokens))
    return {r.token: min(TOP, float(r.odds)) for r in top.collect()}


def solve_lambda(odds: dict[str, float], share: dict[float, float]) -> float:
    """The positive root of E[exp(lambda * s)] = 1 over the clean token scores."""
    rest = 1.0 - sum(share.values())
    f = lambda v: rest * math.exp(v * DRIFT) + sum(p * math.exp(v * s) for s, p in share.items()) - 1.0
    lo, hi = 1e-3, 1e-3
    if not share or f(lo) >= 0:
        return 1.0 if not share else 0.05
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def fit(rows: DataFrame, prior_share: float = 0.03, max_tokens: int = 20_000, least_z: float = 3.0,
        least_odds: float = 3.0) -> ToxicModel:
    """A model from labelled rows (text, y), a bounded sample. Without both labels the
    model knows no token and scores every text 0 evidence."""
    odds = token_odds(written(distinct_texts(rows), "toxic-sample"), prior_share, max_tokens, least_z, least_odds)
    if not odds:
        return ToxicModel({}, 1.0, 0.0, 1.0, -3.0)
    raw = ToxicModel(odds, 1.0, 0.0, 1.0, 0.0)

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        n, hit, best = [], [], []
        for t in b.column(0).to_pylist():
            words = tokens(t)
            h = raw.hits(words)
            n.append(len(words))
            hit.append([s for _, s in h])
            best.append(max((x[2] for x in segments(h)), default=0.0))
        return pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.float64())), pa.array(best, pa.float64())],
            ["y", "n", "hit", "best"])

    clean = map_batches(rows.where("y = 0"), scan, "y int, n bigint, hit array<double>, best double")
    got = clean.agg(F.sum("n").alias("n"), F.sum(F.size("hit")).alias("h"), F.sum(F.expr("aggregate(hit, 0D, (a, x) -> a + x)")).alias("s"),
                    F.avg((F.col("best") > 0).cast("double")).alias("any")).first()
    words, hits = float(got.n or 0) + 1.0, float(got.h or 0) + 1.0
    mean = float(got.s / got.h) if got.h else TOP / 2
    lam = solve_lambda(odds, {mean: min(0.2, hits / words)})
    # K from the clean texts: a text of average length holds a hit with the share seen
    model = ToxicModel(odds, lam, math.log(hits / words) + lam * mean, 1.0, 0.0)

    def evidence(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([model.evidence(t)[0] for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "y"])

    seen = map_batches(rows, evidence, "x double, y int").collect()
    seen.sort(key=lambda r: (r.x, r.y))
    x = np.minimum(np.array([r.x for r in seen]), 200.0)
    y = np.array([r.y for r in seen], dtype=float)
    # both classes weigh alike; the slope stays finite where they separate
    sw = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    slope, offset = fit_logistic(x[:, None], y, l2=1e-4, weights=sw)
    return ToxicModel(odds, lam, model.log_k, float(slope), float(offset))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
                   max_labelled: int = 20_000) -> DataFrame:
    """(doc_id, score, predicted, evidence, passages) of every row, from its whole text.

    ``labels`` (doc_id, toxic): training uses at most ``max_labelled`` ids, the first
    by a hash of the id, outside the held-out remainder. ``passages`` are the
    significant segments as (first word, end word, score). Null, empty and letterless
    texts have evidence 0 and no passage; repeated rows are scored alike.
    """
    model = fit(labelled_texts(docs, label_sample(labels, "toxic", modulus, remainder, max_labelled)))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_tokens tokens
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        mod = sent.value
        ev, spans = zip(*(mod.evidence(t) for t in b.column(1).to_pylist()))
        score = np.array([mod.score(e) for e in ev])
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(ev, pa.float64()),
             pa.array([[dict(first=a, end=e, score=s) for a, e, s in x] for x in spans], pa.list_(span))],
            ["doc_id", "score", "predicted", "evidence", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run,
                       f"doc_id {kind}, score double, predicted int, evidence double, "
                       "passages array<struct<first:bigint,end:bigint,score:double>>")
