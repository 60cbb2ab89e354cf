"""Presence-mask search against a brute force over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import mask_search as MS


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(MS.TERM, lower)


def brute(docs, items, top=10):
    tfs = [(i, Counter(words(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(n for *_, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in tfs:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in words(text) if c[t])
            if s > 0:
                scores.append((s, i))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:top])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "a1"] + [f"w{i}" for i in range(60)] + ["é", "ÉA", "日本", "x_y", "\x7fq"]
    texts = [" ,.\n"[rnd.randrange(4)].join(rnd.choices(vocab, k=rnd.choice([0, 1, 5, 30, 200]))) for _ in range(n)]
    docs = [(i, t, "d", 0) for i, t in enumerate(texts)]
    docs += [(None, texts[5], "d", 0), (7, texts[7], "d", 0), (9000, None, "d", 0), (9001, "", "d", 0), (9002, "!!", "d", 0)]
    docs += [(10_000 + i, "same words w1 w2", "d", 0) for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 20, 90]))), 1) for i in range(40)]
    items += [(40, None, 1), (41, "", 1), (42, "nowhere", 1), (3, items[3][1], 1), (None, "w1 w1 w2", 1)]
    return docs, items


@pytest.mark.parametrize("seed,block,per_pass", [(1, 5, 200_000), (2, 64, 150), (3, 4096, 200_000)])
def test_search_against_brute_force(spark, monkeypatch, seed, block, per_pass):
    monkeypatch.setattr(MS, "BLOCK_DOCS", block)
    monkeypatch.setattr(MS, "TERMS_PER_PASS", per_pass)
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in MS.rank_documents(d, q).collect()), key=str)
    assert got == brute([x[:2] for x in docs], [x[:2] for x in items])
    if seed == 1:
        assert MS.rank_documents(d.limit(0), q).count() == 0 and MS.rank_documents(d, q.limit(0)).count() == 0


def test_masks_spare_documents():
    """A rare term decides: most documents are never scored, and the result is that of all."""
    rnd = random.Random(4)
    texts = [" ".join(["common"] * rnd.randint(1, 3) + (["rare"] * 2 if i % 50 == 0 else []) + rnd.choices("abcdefgh", k=40))
             for i in range(2000)]
    n = np.array([len(t.split()) for t in texts])
    numbers = MS.Numbers()
    held = [np.unique([numbers[w] for w in MS.terms(t)], return_counts=True) for t in texts]
    row = {"id": list(range(2000)), "words": MS.pack_words(list(numbers)), "n": MS.pack_ints(n),
           "held": MS.pack_ints(np.array([len(w) for w, _ in held])), "word": MS.pack_ints(np.concatenate([w for w, _ in held])),
           "tf": MS.pack_ints(np.concatenate([c for _, c in held]))}
    block = MS.Block(row, {b"common": 0, b"rare": 1}, 2000, int(n.sum()), MS.Ranking())
    query = (np.array([0, 1]), np.array([1, 4000]))
    kept, scored = block.search(query, np.zeros(2, np.int64), [], 10)
    assert scored < 200 and len(kept) == 10
    every = block.scores(np.arange(2000), np.array([1, 4000]))
    assert kept == sorted(((int(s), i) for i, s in enumerate(every)), key=lambda x: (-x[0], x[1]))[:10]
    assert block.search(query, np.zeros(2, np.int64), kept, 10)[0][0] == kept[0]


def test_query_on_a_whole_table(spark):
    from skein.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in Q.op11_mask_search(spark, sf).collect()), key=str)
    assert got == brute(docs, items)
