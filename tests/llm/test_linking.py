"""Components, n-gram Jaccard join, projection forest."""

import random

import numpy as np

from skein.llm import ngram_rtree as NG
from skein.llm import rp_forest as RP
from skein.llm.components import components


class Dsu:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(230)]
    edges += [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7)]
    d = Dsu()
    for a, b in edges:
        d.unite(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: d.find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def brute_links(ids, texts):
    sets, d = word_sets(texts), Dsu()
    for i in range(len(ids)):
        d.find(ids[i])
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and sets[k] and 100 * both >= 75 * len(sets[i] | sets[k]):
                d.unite(ids[i], ids[k])
    return sets, [d.find(i) for i in ids]


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10 ** 6)}"
    return " ".join(w)


def corpus(seed=4):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(600)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    texts = [None, "", " \n", "a b", "A  B", "a b c", "x y z u v", "x y z u v", "long " * 20_000]
    for _ in range(14):  # groups of near copies around the threshold
        base = [rnd.choice(vocab) for _ in range(rnd.choice([8, 30, 80, 200]))]
        texts += [edited(rnd, base, rnd.randint(0, max(1, len(base) // 14))) for _ in range(rnd.randint(2, 9))]
    hub = [rnd.choice(vocab) for _ in range(120)]  # one large group of near copies
    texts += [edited(rnd, hub, rnd.randint(0, 3)) for _ in range(60)]
    texts += [" ".join(passage + [rnd.choice(vocab) for _ in range(90)]) for _ in range(50)]  # one shared passage
    return texts


def test_jaccard_join_against_brute_force(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(9).shuffle(ids)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, node string, n int").repartition(5)
    sets, comp = brute_links(ids, texts)
    want = {i: (len(s), c) for i, s, c in zip(ids, sets, comp)}
    for j in (NG.Join(), NG.Join(small=2, most=16, frequent=3, bucket=500)):  # also with chunked blocks and groups
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in NG.linked_documents(df, j).collect()}
        assert got == want
    kept = NG.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_jaccard_join_edges(spark):
    schema = "doc_id long, text string"
    assert NG.linked_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "p q r s t u"), (9, "p q r s t u"), (9, "p q r s t u"), (4, None)]
    got = sorted(map(tuple, NG.linked_documents(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (9, 2, 3), (9, 2, 3), (4, 0, 4)], key=str)


def test_large_blocks_and_groups_in_bounded_tasks(spark, monkeypatch):
    """A hot group of distinct near copies, and documents that share only a passage with
    it: no block row, and no comparison, holds more than the chunks' bound, texts are
    not copied to every chunk, and the links are those of brute force."""
    rnd = random.Random(21)
    hot = [f"h{k}" for k in range(60)]
    texts = [edited(rnd, hot, rnd.randint(0, 2)) for _ in range(300)]
    texts += [" ".join(hot[:40] + [f"u{i}_{k}" for k in range(10)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], NG._grouped

    def watched(rows, keys, *rest):
        seen.append((rows.count(), rows.groupBy(*keys).count().agg({"count": "max"}).first()[0], "text" in rows.columns))
        return real(rows, keys, *rest)

    sizes, real_blocks = [], NG._blocks

    def blocks(*a):
        b = real_blocks(*a)
        sizes.append(b.selectExpr("sum(length(refs)) / 8").first()[0])
        return b

    monkeypatch.setattr(NG, "_grouped", watched)
    monkeypatch.setattr(NG, "_blocks", blocks)
    j = NG.Join(small=2, most=20, frequent=3, bucket=500)
    got = {r.doc_id: r.component_id for r in NG.linked_documents(df, j).collect()}
    sets, comp = brute_links(list(range(len(texts))), texts)
    assert got == dict(enumerate(comp))
    assert sizes[0] <= sum(j.prefix(len(s)) for s in sets)  # not more than the postings
    assert max(m for _, m, _ in seen) <= 3 * j.most
    assert sum(n for n, _, text in seen if text) <= 0.5 * len(texts) * len(texts) / (j.most // 2)  # half of each text to each chunk


def test_keep_one_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (None, None, 2), (3, "a b c d e f", 5), (3, "a b c d e f", 4), (3, "p q r s t u", 6),
            (9, "p q r s t u", 7), (4, None, 8), (4, None, 8), (5, "other words stand in here", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = NG.keep_one(df)
    assert got.columns == df.columns
    want = [rows[0], rows[1], rows[2], rows[4], rows[5], rows[7], rows[9]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, NG.keep_one(df.where("doc_id IS NULL")).collect()), key=str) == sorted(rows[:3], key=str)


def test_rtree_finds_all():
    """Every pair of sets that is similar passes the tree and the finer bound."""
    rng = np.random.default_rng(1)
    sets = []
    for n in rng.integers(5, 900, 150):
        s = rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2)
        sets += [np.unique(s), np.unique(np.concatenate((s[: n - n // 8], rng.integers(0, 2 ** 63, n // 9, dtype=np.uint64))))]
    j, size = NG.Join(), np.array([len(s) for s in sets])
    tree = NG.RTree([NG.counts(NG.point(s)) for s in sets], size)
    found = total = 0
    for i in range(len(sets)):
        hits = [k for k in tree.search(i, j).tolist() if tree.near(i, k, j)]
        want = [k for k in range(i) if j.enough(len(np.intersect1d(sets[i], sets[k])), size[i], size[k])]
        assert set(want) <= set(hits)
        found, total = found + len(hits), total + len(want)
    assert total >= 100 and found <= 3 * total


def test_projection_forest(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((700, 16))
    near = np.repeat(base[:40], 3, axis=0) + 0.06 * rng.standard_normal((120, 16))
    vecs = [v.astype("f4").tolist() for v in np.vstack([base, near, base[5:8], base[5:6]])]
    rows = list(enumerate(vecs))
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(n + 10, [1.0, 2.0]), (n + 11, [2.0, 4.0]), (None, vecs[0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, leaf int, node int")
    x = np.array(vecs, dtype="f4").astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = x @ x.T >= 0.95
    np.fill_diagonal(sim, False)
    d = Dsu()
    for a, b in zip(*np.nonzero(sim)):
        d.unite(int(a), int(b))
    got = {r.vec_id: r for r in RP.near_duplicates(df, forest=RP.Forest(leaf=100, per_leaf=64, trees=8)).collect()}
    assert len(got) == len(rows)
    links = [got[i].n_links for i in range(n)]
    assert all(a <= b for a, b in zip(links, sim.sum(axis=1))) and sum(links) >= 0.97 * sim.sum()
    assert np.mean([got[i].component_id == d.find(i) for i in range(n)]) >= 0.97
    assert all((got[n + k].n_links, got[n + k].component_id, got[n + k].kept) == (0, n + k, True) for k in range(6))
    assert got[n + 11].component_id == n + 10 and got[n + 11].n_links == 1 and not got[n + 11].kept
    assert got[None].n_links == 0 and got[None].kept is False
    assert RP.near_duplicates(df.limit(0)).count() == 0


def test_forest_counts_once(spark):
    """Every pair is counted once, however many leaves hold it, also beyond the sampled levels."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(8) + 0.02 * rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = RP.near_duplicates(df, forest=RP.Forest(leaf=200, sample=32, per_leaf=32, spill=0.2)).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}


def test_forest_keeps_a_hot_group_whole(spark):
    """A third of the table is one group of distinct near copies, many times a leaf; other
    points lie around it, on the rim of its cell."""
    rng = np.random.default_rng(12)
    hot, dim = rng.standard_normal(64), 64
    x = np.vstack([rng.standard_normal((3000, dim)), hot + 0.1 * rng.standard_normal((1500, dim)), hot + 0.3 * rng.standard_normal((60, dim))])
    x = np.vstack([x, x[:40] + 0.1 * rng.standard_normal((40, dim))]).astype("f4").astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u @ u.T >= 0.95
    np.fill_diagonal(sim, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for f in (RP.Forest(leaf=100), RP.Forest(leaf=1000, dense=400, per_leaf=256)):  # in chunks, and in one task
        got = {r.vec_id: r for r in RP.near_duplicates(df, forest=f).collect()}
        links = np.array([got[i].n_links for i in range(len(x))])
        assert (links <= sim.sum(axis=1)).all() and links.sum() >= 0.999 * sim.sum()
        assert (links[3000:4500] == sim[3000:4500].sum(axis=1)).all()
        assert {got[i].component_id for i in range(3000, 4500)} == {3000}


def test_forest_counts_what_it_links(spark):
    """Also where groups are split on in their tasks, a link that joins two points is counted."""
    rng = np.random.default_rng(15)
    base = rng.standard_normal((3000, 16))
    x = np.vstack([base, base + 0.27 * rng.standard_normal((3000, 16))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u @ u.T >= 0.95
    np.fill_diagonal(sim, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in RP.near_duplicates(df, forest=RP.Forest(leaf=60, sample=128, per_leaf=32)).collect()}
    size = {}
    for r in got.values():
        size[r.component_id] = size.get(r.component_id, 0) + 1
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= sim.sum(axis=1)).all()
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got.values())
