"""Quality rules by weak supervision.

Each rule looks at a document's statistics and votes good (+1), bad (-1) or
abstains (0). Expectation-maximisation over the vote patterns of *all* documents
estimates how often each rule says "good" of good and of bad documents, without
labels; a document's posterior probability of being good then replaces the
requirement that it pass every rule.

The corpus only enters EM as counts of vote patterns: at most 3^rules rows,
pre-aggregated on the map side, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, written
from .textstats import text_stats

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
         "upper", "letters", "digits", "bangs", "adjacent_equal", "distinct")


@dataclass(frozen=True)
class Rule:
    """Votes bad when ``bad`` holds, else good when ``good`` holds, else abstains
    (SQL conditions over the statistics; a rule abstains where ``applies`` fails)."""

    name: str
    applies: str
    bad: str
    good: str

    def vote(self):
        return F.expr(f"CAST(CASE WHEN NOT ({self.applies}) THEN 0 WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END AS TINYINT)")


RULES = (
    Rule("symbols", "word_chars >= 20", "n_symbols > 0.05 * word_chars", "n_symbols < 0.02 * word_chars"),
    Rule("capitals", "letters >= 20", "upper > 0.4 * letters", "upper < 0.2 * letters"),
    Rule("repeated_windows", "n_words >= 10", "n_repeat_words > 0.2 * n_words", "n_repeat_words < 0.1 * n_words"),
    Rule("repeated_lines", "n_lines >= 4", "n_dup_lines > 0.3 * n_lines", "n_dup_lines < 0.1 * n_lines"),
    Rule("word_length", "n_words >= 10", "word_chars < 2 * n_words OR word_chars > 15 * n_words",
         "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("exclamations", "n_words >= 10", "bangs > 0.3 * n_words", "bangs < 0.1 * n_words"),
    Rule("stutter", "n_words >= 10", "adjacent_equal > 0.1 * n_words", "adjacent_equal < 0.03 * n_words"),
    Rule("digits", "word_chars >= 20", "digits > 0.3 * word_chars", "digits < 0.1 * word_chars"),
)


@dataclass(frozen=True)
class VoteModel:
    """prior = P(good); p_good[j], p_bad[j] = P(rule j votes good | it votes, class)."""

    prior: float
    p_good: tuple[float, ...]
    p_bad: tuple[float, ...]

    def posterior(self, votes: list):
        """P(good | votes) as a native expression over vote columns."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for v, g, b in zip(votes, self.p_good, self.p_bad):
            odds = odds + F.when(v > 0, float(np.log(g / b))).when(v < 0, float(np.log((1 - g) / (1 - b)))).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarms: float = 0.002) -> VoteModel:
    """EM of the two-class vote model. ``patterns``: distinct vote rows (-1, 0, 1).

    Starts from "bad where some rule says bad". A rule seldom condemns a good
    document: its accuracy on those has a Beta prior around ``1 - false_alarms`` as heavy
    as the corpus, and stays above ``1 - 2 * false_alarms``, so that several kinds of junk stay in one class. A rule
    detects one kind of junk, so it may pass any share from a half of the bad documents,
    but never more than of the good ones: a good vote is weak evidence, a bad vote can
    be strong. With no rows the prior model is returned.
    """
    weight = counts.sum() + 20.0
    k = patterns.shape[1]
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    post = np.where(down.any(axis=1), 0.1, 0.97)
    prior, pg, pb = 0.9, np.full(k, 0.95), np.full(k, 0.5)
    for _ in range(rounds):
        wg, wb = counts * post, counts * (1 - post)
        prior = float(np.clip((wg.sum() + 9.0) / (counts.sum() + 10.0), 0.01, 0.99))
        pg = np.clip((up.T @ wg + (1 - false_alarms) * weight) / ((up + down).T @ wg + weight), 1 - 2 * false_alarms, 0.9999)
        pb = np.minimum(np.clip((up.T @ wb + 8.0) / ((up + down).T @ wb + 10.0), 0.5, 0.99), pg)
        odds = np.log(prior / (1 - prior)) + up @ np.log(pg / pb) + down @ np.log((1 - pg) / (1 - pb))
        new = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
        if not len(new) or np.abs(new - post).max() < 1e-9:
            break
        post = new
    return VoteModel(prior, tuple(map(float, pg)), tuple(map(float, pb)))


def with_stats(docs: DataFrame, text_col: str = "text", name: str = "_stats") -> DataFrame:
    """``docs`` with the whole-text statistics as one more struct column."""
    kind = pa.struct([(c, pa.int64()) for c in STATS])
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [dict(zip(STATS, text_stats(t))) for t in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, name])

    fields = [T.StructField(c, T.LongType()) for c in STATS]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(fields))])
    return map_batches(docs, run, schema)


def _judged(table: DataFrame, rules: tuple[Rule, ...], min_posterior: float) -> DataFrame:
    """``table`` (with statistics and votes) with posterior, base_failed and kept, by
    the model of its vote patterns (at most 3^rules rows reach the driver)."""
    votes = [f"vote_{r.name}" for r in rules]
    seen = table.where("n_words > 0").groupBy(*votes).count().collect()
    pats = np.array([[r[v] for v in votes] for r in seen], dtype=np.int8).reshape(-1, len(votes))
    model = fit_votes(pats, np.array([r["count"] for r in seen], dtype=float))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (table.withColumn("posterior", model.posterior([F.col(v) for v in votes]))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                min_posterior: float = 0.5) -> DataFrame:
    """One row per input row: the id, statistics, one ``vote_<rule>`` per rule,
    ``posterior``, ``base_failed`` and ``kept`` (= not base_failed and posterior >=
    min_posterior).

    Null and empty texts have zero words and fail the base rule. Repeated rows are
    judged alike. An empty table gives an empty result. Other columns are ignored.
    """
    table = with_stats(docs.select(id_col, text_col), text_col).select(id_col, "_stats.*")
    table = table.select("*", *(r.vote().alias(f"vote_{r.name}") for r in rules))
    return _judged(written(table, "quality-votes"), rules, min_posterior)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_posterior: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, that :func:`apply_rules` keeps. Texts are read
    twice (for the vote patterns and for the verdict) rather than shuffled or copied.
    Columns may have any names."""
    stats = free_name("_stats", docs.columns)
    table = with_stats(docs, text_col, stats)
    rows = F.struct(*(table[c] for c in docs.columns)).alias("_row")
    table = table.select(rows, f"{stats}.*").select("*", *(r.vote().alias(f"vote_{r.name}") for r in rules))
    return _judged(table, rules, min_posterior).where("kept").select("_row.*")
