"""Quality rules, pairwise ranking, language codes and toxic segments."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skein.llm import language_codes as LC
from skein.llm import quality_rank as QR
from skein.llm import quality_rules as RULES
from skein.llm import toxic_segments as TS
from skein.llm.common import held_out
from skein.llm.textstats import text_stats

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, posterior double, score double, n string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, None, "x") for i, t in enumerate(texts)], DOC)


def naive_stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, straight from their definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(wins)
    marked = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_stats_against_definitions():
    rnd = random.Random(3)
    texts = ["", None, " \n\t", "a", "a\nb\na\n\na ", "é#|ü \x0b x\x1cy", "w " * 30_000, "p q r s t u " * 3 + "end"]
    texts += [" ".join(rnd.choice("ab#\n") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for t in texts:
        s = text_stats(t)
        assert (s[0], s[1], s[2], s[4], s[5]) == naive_stats(t), repr(t)[:80]


def test_quality_rules_rows(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(60)]
    junk = [" ".join(word() + "###&&&" for _ in range(60)) for _ in range(6)]
    texts = [*clean, *junk, None, "", "few words", "same line here\n" * 20, "x " * 50_000]
    got = RULES.apply_rules(docs(spark, texts)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    assert all(by[i].kept for i in range(60))
    assert not any(by[i].kept for i in range(60, len(texts)))
    assert [by[i].base_failed for i in range(66, 71)] == [True] * 5 and by[66].n_words == 0
    kept = RULES.keep_good(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == set(range(60))
    assert RULES.apply_rules(docs(spark, [])).count() == 0


def test_vote_model_extremes():
    m = RULES.fit_votes(np.zeros((0, 3), np.int8), np.zeros(0))
    assert 0 < m.prior < 1 and len(m.p_good) == 3
    m = RULES.fit_votes(np.array([[1, 1, 0], [-1, 1, 0]]), np.array([90.0, 10.0]))
    assert m.p_bad[0] < m.p_good[0]


def test_pairwise_quality_held_out(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = QR.rank_quality(d, lab).join(lab, "doc_id").where(held_out(F.col("doc_id"), 4, 2))
    n = r.count()
    assert n and r.where("predicted = quality").count() >= 0.95 * n
    assert QR.rank_quality(d, lab).count() == d.count()


def test_pairwise_quality_edges(spark):
    lab = spark.createDataFrame([(None, 1, 0), (0, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, ["a b c", None, "", "x " * 20_000])
    got = QR.rank_quality(d, lab).collect()  # one class only: nothing to rank
    assert {(r.score, r.predicted) for r in got} == {(QR.CUT, 1)}
    both = spark.createDataFrame([(0, 0, 0), (3, 1, 0), (3, 1, 0), (1, 1, 0)], lab.schema)
    got = QR.rank_quality(d, both, modulus=1, remainder=5).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert QR.rank_quality(docs(spark, []), both).count() == 0
    assert QR.keep_quality(d, lab).columns == d.columns


def test_language_codes_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    m = LC.fit(LC.training_rows(d, out))
    r = LC.identify(d, m).join(d.select("doc_id", "lang"), "doc_id").where(out)
    assert r.where("lang_pred = lang").count() >= 0.97 * r.count()
    odd = LC.identify(docs(spark, [None, "", "123 ## ²", "the and of"]), m).orderBy("doc_id").collect()
    assert [x.lang_pred for x in odd[:3]] == ["und"] * 3 and all(x.score == 0 and x.ambiguous for x in odd[:3])
    assert odd[3].lang_pred in m.languages


def test_language_codes_edges(spark):
    assert LC.fit(LC.training_rows(docs(spark, ["a b", None]), F.lit(False))) is None
    one = spark.createDataFrame([("abc abc", "xx", 1), ("def", None, 2), (None, "yy", 3)], "text string, lang string, key long")
    m = LC.fit(one)
    assert m.languages == ("xx",)
    assert LC.identify(docs(spark, ["abc"]), m).first().lang_pred == "xx"
    assert LC.identify(docs(spark, ["abc"]), None).first().lang_pred == "und"
    for k in (2, 4, 9, 40):
        code = LC.codewords(k)
        assert len({tuple(c) for c in code}) == k
        assert not (np.abs(code.sum(axis=0)) == k).any()


def dense_weights(rows, languages, code):
    """The weights from a dense table of counts, straight from their definition."""
    size = 1 << LC.FEATURE_BITS
    counts = np.zeros((len(languages), size))
    for text, lang, _ in rows:
        counts[languages.index(lang)] += LC.trigram_counts(text)
    p = (counts + LC.PRIOR) / (counts.sum(axis=1, keepdims=True) + LC.PRIOR * size)
    return np.array([np.log(p[c > 0].mean(axis=0) / p[c < 0].mean(axis=0)) for c in code.T]).T


def test_language_codes_against_dense_counts(spark):
    """300 languages, more than a task holds at once: every one is learned, by the defined weights."""
    rnd = random.Random(7)
    names = [f"l{i:03d}" for i in range(300)]
    letters = {v: rnd.sample("abcdefghijklmnopqrstuvwxyz", 7) for v in names}
    say = lambda v: " ".join("".join(rnd.choices(letters[v], k=4)) for _ in range(60))
    rows = [(say(v), v, i) for i, v in enumerate(names * 3)]
    m = LC.fit(spark.createDataFrame(rows, "text string, lang string, key long"), calibration_rows=900)
    assert m.languages == tuple(names) and LC.least_distance(m.code) >= 4
    assert np.allclose(m.weights, dense_weights(rows, names, m.code), rtol=1e-9, atol=1e-9)
    texts = [say(v) for v in names]
    got = [r.lang_pred for r in LC.identify(docs(spark, texts), m).orderBy("doc_id").collect()]
    want = []  # by definition: the codeword of least weighted loss
    for x in texts:
        c = LC.trigram_counts(x)
        f = c @ m.weights / c.sum() * m.scale[0] + m.scale[1]
        loss = [float(np.sum(m.trust * np.log1p(np.exp(-word * f)))) for word in m.code]
        want.append(names[int(np.argmin(loss))])
    assert got == want
    assert sum(a == v for a, v in zip(got, names)) >= 240  # chance: 1; languages share most trigrams here


def brute_segments(s):
    """Maximal scoring segments by their definition: the best segment, then those left and right of it."""
    out = []

    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            t = 0.0
            for b in range(a, hi):
                t += s[b]
                key = (round(t, 9), -(b + 1 - a))
                if t > 1e-9 and (best is None or key > best[0]):
                    best = (key, a, b + 1)
        if best:
            go(lo, best[1])
            out.append((best[1], best[2], best[0][0]))
            go(best[2], hi)

    go(0, len(s))
    return out


def test_segments_against_definition():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(0, 25)
        s = [rnd.choice([-0.37, -0.37, rnd.uniform(0.1, 2)]) for _ in range(n)]
        got = TS.segments([(i, x) for i, x in enumerate(s) if x > 0], drift=-0.37)
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], s
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity_held_out(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = TS.score_toxicity(d, lab).join(lab, "doc_id").cache()
    assert r.where("predicted = toxic").count() >= 0.94 * r.count()  # few toxic texts to learn from here


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, ["a b c", "idiot", None, "", "123", "word " * 30_000])
    got = TS.score_toxicity(d, lab).collect()
    assert len(got) == 6 and all(r.predicted == 0 and 0 <= r.score <= 1 and r.passages == [] for r in got)
    assert TS.score_toxicity(docs(spark, []), lab).count() == 0
