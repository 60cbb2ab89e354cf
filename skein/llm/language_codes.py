"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit of the code a binary n-gram classifier
tells the languages with that bit set from the others. A text's bit margins are
decoded to the codeword with the least weighted loss; a close second flags the
prediction as ambiguous.

The bit classifiers compare n-gram distributions, so training is one count of
(language, hashed byte trigram) over all training documents, summed on the map side
and written. Joined with the codewords, it is summed per feature to the two sides of
every bit: the driver holds features x bits and the codewords, whatever the number of
languages. Each bit's margin is then put on the scale of log-odds with a bounded
sample of training documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, map_batches, written

#: Hashed features (2^FEATURE_BITS); the counts table has one row per language and feature.
FEATURE_BITS = 14
#: Count of every n-gram of a language before its first text.
PRIOR = 0.2
#: Languages whose counts a task holds at once; further ones make it emit what it has.
HELD_LANGUAGES = 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces.
_FOLD = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed byte trigrams of the lower-cased text, with symbols and
    digits folded to single spaces; None where there is no text or no letter."""
    if not text or not _LETTER.search(text):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    a = np.frombuffer(raw + b" ", dtype=np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA6B)) ^ (a[2:] * np.uint32(0xC2B2AE35))
    h *= np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(32 - FEATURE_BITS), minlength=1 << FEATURE_BITS)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """One row of -1/+1 bits per language. Up to five languages get the exhaustive
    code, more get the random code, of many drawn, with the largest least distance."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 5:
        cols = [[1] + [1 if (c >> j) & 1 else -1 for j in range(languages - 1)] for c in range(2 ** (languages - 1) - 1)]
        return np.array(cols, dtype=float).T
    rng = np.random.default_rng(seed)
    bits, best, far = 8 + 4 * int(np.ceil(np.log2(languages))), None, -1.0
    # least distances cost the square of the languages: fewer draws where there are many
    draws = max(1, min(200, 20_000_000 // languages ** 2))
    while draws > 0 or best is None:
        draws -= 1
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        if (dist := least_distance(code)) > max(far, 0.0):
            best, far = code, dist
    return best


def least_distance(code: np.ndarray, rows: int = 1_024) -> float:
    """The least number of bits in which two rows differ, by blocks of ``rows``."""
    n, bits = code.shape
    least = float(bits)
    for a in range(0, n, rows):
        dist = (bits - code[a:a + rows] @ code.T) / 2
        dist[np.arange(len(dist)), np.arange(a, a + len(dist))] = bits
        least = min(least, float(dist.min()))
    return least


@dataclass(frozen=True)
class CodeModel:
    languages: tuple[str, ...]
    code: np.ndarray      # languages x bits, -1/+1
    weights: np.ndarray   # features x bits: log-odds of one n-gram
    scale: np.ndarray     # 2 x bits: slope and offset of each bit's margin
    trust: np.ndarray     # weight of each bit in decoding, sums to one

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / max(1, counts.sum())

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """(language index, probability, gap to the second codeword's loss)."""
        if len(self.languages) == 1:
            return 0, 1.0, float("inf")
        f = margins * self.scale[0] + self.scale[1]
        loss = np.logaddexp(0.0, -self.code * f[None, :]) @ self.trust * self.code.shape[1]
        two = np.argsort(loss, kind="stable")[:2]
        p = np.exp(-(loss - loss[two[0]]))
        return int(two[0]), float(p[two[0]] / p.sum()), float(loss[two[1]] - loss[two[0]])


def bit_weights(counts: DataFrame, languages: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Features x bits: the log of the mean share of a feature over the languages with
    the bit set against the mean over the others. ``counts`` (lang, f, n) is summed in
    Spark per feature, in the order of languages, so that reruns agree to the last bit."""
    size = 1 << FEATURE_BITS
    at = {v: i for i, v in enumerate(languages)}
    unit = 1.0 / (totals + PRIOR * size)  # a language's share of a single use
    sent = counts.sparkSession.sparkContext.broadcast((at, unit, code))  # languages x bits

    def add(batches):
        where, one, words = sent.value
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            lang = np.array([where[v] for v in b.column(0).to_pylist()], dtype=np.int64)
            share = b.column(2).to_numpy() * one[lang]
            for f, k, v in zip(b.column(1).to_pylist(), lang.tolist(), share.tolist()):
                if f not in sums:
                    sums[f] = np.zeros((2, words.shape[1]))
                sums[f][0] += v * (words[k] > 0)
                sums[f][1] += v * (words[k] < 0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))],
                ["f", "v"])

    per_feature = counts.select("lang", "f", "n").repartition("f").sortWithinPartitions("f", "lang")
    got = per_feature.mapInArrow(add, "f int, v array<double>").toArrow()  # at most one row a feature
    bits = code.shape[1]
    sides = np.zeros((size, 2, bits))
    if got.num_rows:
        sides[got.column("f").to_numpy()] = np.array(got.column("v").to_pylist()).reshape(-1, 2, bits)
    has = np.stack([code > 0, code < 0])
    sides += PRIOR * (has * unit[None, :, None]).sum(axis=1)
    sides /= has.sum(axis=1)
    return np.log(sides[:, 0] / sides[:, 1])


def fit(train: DataFrame, calibration_rows: int = 4_000) -> CodeModel | None:
    """A model from ``train`` (text, lang, key): counts of all its rows, and margins
    of the ``calibration_rows`` rows with the least hash of ``key``. Rows with null
    text or lang, or no letter, do not count. None when nothing remains."""
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def rows_of(sums):
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "f", "n"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = trigram_counts(t)
                if c is None:
                    continue
                if lang in sums:
                    sums[lang] += c
                else:
                    if len(sums) >= HELD_LANGUAGES:
                        yield from rows_of(sums)
                        sums = {}
                    sums[lang] = c
        yield from rows_of(sums)

    counts = written(rows.select("text", "lang").mapInArrow(count, "lang string, f int, n bigint")
                     .groupBy("lang", "f").agg(F.sum("n").alias("n")), "language-counts")
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(total)
    if not langs:
        return None
    code = codewords(len(langs))
    weights = bit_weights(counts, langs, np.array([total[v] for v in langs], dtype=float), code) \
        if code.shape[1] else np.zeros((1 << FEATURE_BITS, 0))
    at = {v: i for i, v in enumerate(langs)}
    bits = code.shape[1]
    raw = CodeModel(tuple(langs), code, weights, np.vstack([np.ones(bits), np.zeros(bits)]), np.ones(bits) / max(bits, 1))
    if not bits:
        return raw

    def margin(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if (c := trigram_counts(t)) is None else raw.margins(c) for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.float64()))], ["lang", "m"])

    few = F.broadcast(rows.select("key").orderBy(F.xxhash64("key"), "key").limit(calibration_rows).distinct())
    sample = map_batches(rows.join(few, "key").select("text", "lang"), margin, "lang string, m array<double>")
    sample = sample.where("m IS NOT NULL").collect()
    y = code[[at[r.lang] for r in sample]]
    m = np.array([r.m for r in sample]).reshape(len(sample), bits)
    scale, trust = raw.scale.copy(), np.ones(bits)
    for j in range(bits):
        if len(set(y[:, j])) == 2:
            scale[:, j] = fit_logistic(m[:, j:j + 1], (y[:, j] > 0).astype(float), l2=1e-4)
            trust[j] = max(1e-3, 2 * float(((m[:, j] * scale[0, j] + scale[1, j] > 0) == (y[:, j] > 0)).mean()) - 1)
    return CodeModel(tuple(langs), code, weights, scale, trust / trust.sum())


def identify(docs: DataFrame, model: CodeModel | None, id_col: str = "doc_id", text_col: str = "text",
             ambiguous_gap: float = 0.7) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row, from its whole text alone.

    Null texts, texts without a letter, and all texts when nothing was learned get
    ``und`` with score 0 and are ambiguous. Repeated rows are predicted alike.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # features x bits numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        mod, lang, score, unsure = sent.value, [], [], []
        for t in b.column(1).to_pylist():
            c = trigram_counts(t) if mod else None
            if c is None:
                lang.append(UNKNOWN), score.append(0.0), unsure.append(True)
                continue
            k, p, gap = mod.decode(mod.margins(c))
            lang.append(mod.languages[k]), score.append(p), unsure.append(gap < ambiguous_gap)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
            [id_col, "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, lang_pred string, score double, ambiguous boolean")


def training_rows(docs: DataFrame, is_held_out: Column) -> DataFrame:
    return docs.where(~is_held_out).select("text", "lang", F.col("doc_id").alias("key"))
