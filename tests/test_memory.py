import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import CONTENT_ID_NAMESPACE
from skein.functions.vectors import content_id, hash_embedding
from skein.operators import recall as R
from skein.session import unique_subdir
from skein.sources.memory import DimensionalityMismatch, VectorMemory

#: Two of them equal, two as far from the second query.
STORE = [("north", [0.0, 4.0]), ("east", [4.0, 0.0]), ("north again", [0.0, 4.0]), ("far", [-30.0, 1.0]), ("mid", [2.0, 2.0])]


def _store_df(spark):
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(STORE)], "pos long, text string, embedding array<float>")


def _queries(spark):
    return spark.createDataFrame([(1, [0.5, 4.0]), (2, [3.0, 3.0])], "qid long, embedding array<float>")


def _ranked(hits):
    rows = sorted(hits.collect(), key=lambda r: (r.qid, r.rank))
    return {q: [r.text for r in rows if r.qid == q] for q in {r.qid for r in rows}}


def test_nearest_rows_both_strategies(spark):
    for strategy in ("broadcast", "blocked"):
        hits = R.knn(_queries(spark), _store_df(spark), 3, tie_keys=["pos"], payload=["text"], dims=2, strategy=strategy, block_rows=2)
        assert _ranked(hits) == {1: ["north", "north again", "mid"], 2: ["mid", "north", "east"]}, strategy


def test_recall_from_the_stored_memory(spark):
    path = unique_subdir(spark, "t-recall")
    VectorMemory(spark, path, 2).store(_store_df(spark))
    hits = VectorMemory(spark, path, 2).recall(_queries(spark), 2, tie_keys=["pos"])
    assert _ranked(hits) == {1: ["north", "north again"], 2: ["mid", "north"]}
    plan = hits._jdf.queryExecution().toString()
    assert "t-recall" in plan
    wrong = spark.createDataFrame([(9, [1.0]), (8, None)], "qid long, embedding array<float>")
    mem = VectorMemory(spark, path, 2)
    assert mem.recall(wrong, 2, tie_keys=["pos"]).count() == 0 and wrong.filter(~mem.fits()).count() == 2
    with pytest.raises(DimensionalityMismatch):
        VectorMemory(spark, path, 3)
    with pytest.raises(ValueError):
        VectorMemory(spark, path, 2, metric="cosine")
    with pytest.raises(ValueError):
        VectorMemory(spark, path, mode="upsert")
    cosine = VectorMemory(spark, unique_subdir(spark, "t-recall-cosine"), 2, mode="upsert", metric="cosine")
    cosine.store(_store_df(spark))
    opened = VectorMemory(spark, cosine.path)
    assert (opened.dims, opened.mode, opened.metric) == (2, "upsert", "cosine") and opened.read().count() == 5
    cos = opened.recall(_queries(spark), 3, tie_keys=["pos"])
    assert _ranked(cos)[2] == ["mid", "north", "east"]


def test_equal_vectors_keep_tie_order(spark):
    """Many equal rows, in any order of arrival: the first by key come first, by both metrics."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 8))
    rows = [(int(i), base[i % 20].tolist()) for i in rng.permutation(4000)]
    mem = spark.createDataFrame(rows, "pos long, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(k, base[k].tolist()) for k in range(20)], "qid long, embedding array<double>")
    for metric in ("l2", "cosine"):
        for strategy in ("broadcast", "blocked"):
            hits = R.knn(q, mem, 3, tie_keys=["pos"], metric=metric, dims=8, strategy=strategy, block_rows=300)
            got = {(r.qid, r.rank): r.pos for r in hits.collect()}
            assert got == {(k, r): k + 20 * (r - 1) for k in range(20) for r in (1, 2, 3)}


def test_blocks_and_hits_carry_no_payload(spark):
    """Payloads are fetched for the hits alone: rows that share their tie keys keep their own,
    equal rows count each, and null keys and payloads are found."""
    rows = [(1, "a", [0.0, 1.0]), (1, "b", [0.0, 2.0]), (1, "b", [0.0, 2.0]), (None, None, [0.0, 3.0]), (2, "c", [9.0, 9.0])]
    mem = spark.createDataFrame(rows, "pos long, text string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [8.0, 8.0])], "qid long, embedding array<float>")
    for strategy, most in (("broadcast", 200_000), ("blocked", 200_000), ("blocked", 0)):
        R.BROADCAST_HITS = most
        try:
            hits = R.knn(q, mem, 4, tie_keys=["pos"], payload=["text"], strategy=strategy)
        finally:
            R.BROADCAST_HITS = 200_000
        got = {(r.qid, r["rank"]): (r.text, r.pos) for r in hits.collect()}
        assert len(got) == 12
        for k in (1, 2):
            assert [got[k, i] for i in (1, 2, 3, 4)] == [("a", 1), ("b", 1), ("b", 1), (None, None)]
        assert got[None, 1] == ("c", 2)


def test_blocks_are_few(spark):
    """20,000 queries against 20,000 rows: the exchanged copies stay few, the hits those of brute force."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (20_000, 4)).astype(float)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<float>")
    hits = R.knn(df.withColumnRenamed("pos", "qid"), df, 2, tie_keys=["pos"], dims=4, strategy="blocked")
    last = [int(x) for x in re.findall(r"explode\(sequence\(0, (\d+)", hits._jdf.queryExecution().analyzed().toString())]
    assert len(last) == 2 and min(last) == 0 and max(last) < 8, last  # 5 and 5 blocks before: four copies more of either side
    got = {(r.qid, r["rank"]): r.pos for r in hits.where("qid < 50").collect()}
    for k in range(50):
        d = ((v - v[k]) ** 2).sum(axis=1)
        assert [got[k, 1], got[k, 2]] == np.lexsort((np.arange(len(v)), d))[:2].tolist()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_blocks_copy_nothing(spark, metric):
    """40 blocks of queries in 14 parts: no row goes into an exchange once for each block of the
    other side, hits are those of brute force, repeated and null keys and a memory that is
    no plain scan included."""
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (2000, 4)).astype(float)
    v[0] = 0
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<float>").repartition(5)
    mem = df.unionByName(df.limit(0)).dropDuplicates(["pos"])
    asked = df.select(F.when(F.col("pos") != 7, F.col("pos") % 1999).alias("qid"), "embedding")
    hits = R.knn(asked, mem, 3, tie_keys=["pos"], dims=4, metric=metric, strategy="blocked", block_rows=50, broadcast_bytes=4 * 8 * 150)
    assert "sequence(" not in hits._jdf.queryExecution().analyzed().toString()
    got = {(r.qid, r["rank"]): r.pos for r in hits.collect()}
    assert len(got) == 1999 * 3
    for k in (0, 1, 7, *range(100, 1999, 100)):
        with np.errstate(invalid="ignore"):
            d = ((v - v[k]) ** 2).sum(axis=1) if metric == "l2" else -np.nan_to_num(v @ v[k] / np.sqrt((v * v).sum(1)) / np.sqrt(v[k] @ v[k]), nan=-9)
        want = np.lexsort((np.arange(len(v)), np.round(d, 9)))[:3].tolist()
        if k == 0:  # asked twice under one key: by the first vector and the last
            continue
        assert [got[None if k == 7 else k, r] for r in (1, 2, 3)] == want


def test_kernel_skips_norms_out_of_reach_only():
    """Norms that differ widely, and a limit from rows seen before: the hits of brute force."""
    rng = np.random.default_rng(8)
    Q, M = (rng.standard_normal((n, 5)) * np.exp(rng.normal(0, 3, (n, 1))) for n in (600, 9000))
    d = np.sqrt(((Q[:, None, :] - M[None, :, :]) ** 2).sum(axis=2))
    want = np.lexsort((np.broadcast_to(np.arange(len(M)), d.shape), d), axis=1)[:, :3]
    assert (R._top_n(Q, M, 3, "l2")[0] == want).all()
    limit = np.take_along_axis(d, want[:, 2:], 1)[:, 0]
    q, idx, _ = R._nearest(Q, M, 3, "l2", limit)
    assert (idx.reshape(-1, 3) == want).all() and (q == np.repeat(np.arange(600), 3)).all()
    assert len(R._nearest(Q, M, 3, "l2", limit / 2)[0]) < len(q)


def test_kernel_rounds_nothing_away():
    """Single-precision products only find candidates: close, huge, tiny and equal vectors rank as in double precision."""
    rng = np.random.default_rng(4)
    for make in (lambda n: 1e6 + rng.standard_normal((n, 5)), lambda n: rng.standard_normal((n, 5)) * 1e30,
                 lambda n: rng.standard_normal((n, 5)) * 1e-30, lambda n: rng.integers(0, 2, (n, 5)).astype(float)):
        Q, M = make(20), make(9000)
        d = ((Q[:, None, :] - M[None, :, :]) ** 2).sum(axis=2)
        want = np.lexsort((np.broadcast_to(np.arange(len(M)), d.shape), d), axis=1)[:, :3]
        assert (R._top_n(Q, M, 3, "l2")[0] == want).all()


def test_empty_memory_without_dims(spark):
    empty = spark.createDataFrame([], "pos long, text string, embedding array<float>")
    hits = R.knn(_queries(spark), empty, 3, tie_keys=["pos"], payload=["text"])
    assert [r.recall for r in R.recall_text(hits, "qid", "text", queries=_queries(spark)).collect()] == ["", ""]


def test_recall_text_empty_memory(spark):
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "qid long, embedding array<float>")
    empty = spark.createDataFrame([], "pos long, text string, embedding array<float>")
    hits = R.knn(q, empty, 3, tie_keys=["pos"], payload=["text"], dims=3)
    out = R.recall_text(hits, "qid", "text", queries=q).first()
    assert out.recall == ""


def test_content_id_matches_uuid5(spark):
    texts = ["héllo world", "", "a\nb", "日本語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.id for r in df.select(content_id("t").alias("id")).collect()]
    ns = uuid.UUID(CONTENT_ID_NAMESPACE)
    assert got == [str(uuid.uuid5(ns, t)) for t in texts]
    assert got[0] == "8bba7da9-5bce-5e67-ae53-28b03cfef6c6"


def test_hash_embedding_integer_and_dims(spark):
    df = spark.createDataFrame([("Hello hello, world",), ("",)], "t string")
    rows = df.select(hash_embedding("t").alias("v")).collect()
    assert len(rows[0].v) == 64 and all(float(x).is_integer() for x in rows[0].v)
    assert sum(abs(x) for x in rows[0].v) <= 3 and sum(abs(x) for x in rows[1].v) == 0


def test_memory_append_upsert_forget(spark):
    df = _store_df(spark)
    app = VectorMemory(spark, unique_subdir(spark, "t-app"), 2, mode="append")
    app.store(df)
    app.store(df)
    assert app.read().count() == 10 and {r.batch for r in app.read().collect()} == {0, 1}
    up = VectorMemory(spark, unique_subdir(spark, "t-up"), 2, mode="upsert")
    up.store(df)
    up.store(df.limit(2).withColumn("embedding", F.array(*[F.lit(9.0).cast("float")] * 2)).withColumn("pos", F.col("pos") + 10))
    got = {r.text: list(r.embedding) for r in up.read().collect()}
    assert len(got) == 5 and got["north"] == got["east"] == [9.0, 9.0] and got["mid"] == [2.0, 2.0]
    columns = set(up.read().columns)
    up.forget()
    assert up.read().count() == 0 and set(up.read().columns) == columns
    up.store(df)
    assert up.read().count() == 5


def test_last_row_of_one_write_wins(spark):
    rows = [(k, "same", [float(k), 0.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "pos long, text string, embedding array<float>").repartition(5)
    mem = VectorMemory(spark, unique_subdir(spark, "t-order"), 2, mode="upsert")
    mem.store(df, order_by=["pos"])
    assert [list(r.embedding) for r in mem.read().collect()] == [[49.0, 0.0]]


def test_writers_do_not_meet(spark):
    """A direct write, two streams and a replay: only the replay replaces, and only its own."""
    df = _store_df(spark)
    mem = VectorMemory(spark, unique_subdir(spark, "t-writers"), 2)
    mem.store(df)
    mem.store(df, batch_id=0, writer="a")
    mem.store(df, batch_id=0, writer="b")
    mem.store(df, batch_id=0, writer="a")
    mem.store(df, batch_id=0)
    assert mem.read().count() == 20


def test_dimension_mismatch_rejected(spark):
    bad = spark.createDataFrame([("x", [1.0, 2.0])], "text string, embedding array<float>")
    mem = VectorMemory(spark, unique_subdir(spark, "t-dim"), 3)
    rejected = mem.store(bad)
    assert rejected.count() == 1 and mem.read().count() == 0


def test_lsh_recall_against_exact(spark):
    """Recall of the three nearest others (a vector's hit on itself does not count)."""
    from skein.operators.lsh import lsh_knn

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    exact = R.knn(q, e, 4, query_key="qid", tie_keys=["vec_id"], dims=64).filter("qid <> vec_id")
    approx = lsh_knn(q, e, 4, query_key="qid", memory_key="vec_id", dims=64, bucket_rows=64)
    hit = exact.join(approx, ["qid", "vec_id"]).count()
    assert hit / exact.count() >= 0.8


def test_recall_lsh_asks_every_fiftieth_row(spark):
    """All rows are searched; the vectors go to their buckets without a shuffle before."""
    from skein.plans.q_memory import RECALL_N, recall_lsh

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    got = recall_lsh(spark, sf)
    assert "SortMergeJoin [__t" not in got._jdf.queryExecution().sparkPlan().toString()
    got = got.cache()
    assert {r.qid for r in got.select("qid").collect()} == {r.qid for r in q.collect()}
    assert got.where("vec_id % 50 <> 0").count() > 0
    exact = R.knn(q, e, RECALL_N, query_key="qid", tie_keys=["vec_id"], dims=64)
    assert exact.join(got, ["qid", "vec_id"]).count() / exact.count() >= 0.9


def test_lsh_answers_every_query(spark):
    from skein.operators.lsh import lsh_knn

    e = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [-1.0, -1.0, -1.0])], "qid long, embedding array<float>")
    got = {r.qid: (r.rank, r.vec_id, r.found) for r in lsh_knn(q, e, 2, query_key="qid", memory_key="vec_id", dims=3, bits=8, tables=2).collect()}
    assert got == {1: (1, 1, 1), 2: (None, None, 0)}


def test_lsh_hot_bucket_split_is_exact_within_candidates(spark):
    """Many identical vectors fall in one bucket; splitting it into sub-blocks
    must not change the result."""
    from skein.operators.lsh import lsh_knn

    rows = [(i, [1.0, 1.0, 1.0]) for i in range(300)] + [(1000 + i, [float(i), -1.0, 2.0]) for i in range(20)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [3.0, -1.0, 2.0])], "qid long, embedding array<float>")
    small = lsh_knn(q, e, 5, query_key="qid", memory_key="vec_id", dims=3, bits=2, tables=2, block_rows=16)
    big = lsh_knn(q, e, 5, query_key="qid", memory_key="vec_id", dims=3, bits=2, tables=2, block_rows=100000)
    key = lambda df: sorted((r.qid, r.rank, r.vec_id) for r in df.collect())
    assert key(small) == key(big)
    assert [r.vec_id for r in small.filter("qid = 1").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_blocked_knn_composite_keys_match_broadcast(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.select((F.col("vec_id") % 7).alias("a"), "vec_id", "embedding").withColumnRenamed("vec_id", "b")
    kw = dict(query_key=["a", "b"], tie_keys=["vec_id"], dims=64, metric="l2")
    b1 = R.knn(q, e, 4, strategy="broadcast", **kw)
    b2 = R.knn(q, e, 4, strategy="blocked", block_rows=50, **kw)
    key = lambda df: sorted((r.a, r.b, r.rank, r.vec_id, round(r.distance, 9)) for r in df.collect())
    assert key(b1) == key(b2)


def test_user_model_embedder_slot(spark):
    """A user model plugs in as a batch predictor (Arrow batches)."""
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf

    from skein.operators.embed import model_embed

    def make_predict():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.stack([[float(len(t)), float(t.count(" ")), 1.0] for t in texts]).astype(np.float32)
        return predict

    from pyspark.sql import types as T

    embedder = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=8)
    df = spark.createDataFrame([("a b",), ("hello",)], "text string")
    out = sorted(tuple(r.embedding) for r in model_embed(df, embedder).collect())
    assert out == [(3.0, 1.0, 1.0), (5.0, 0.0, 1.0)]


def test_embedder_hashes_a_word_once_per_piece(monkeypatch):
    """Whatever the piece that a row's words fall in, its vector is the sum over its words."""
    import hashlib

    import pyarrow as pa

    from skein.functions import vectors as V

    asked = []
    monkeypatch.setattr(V, "WORDS_AT_ONCE", 4)
    monkeypatch.setattr(V, "_codes", lambda w, dims, f=V._codes: asked.append(w) or f(w, dims))
    rows = [["a", "b", "a"], None, [], ["b", "b", "é", "a", "b", "b", "b"], ["日本"], []]
    got = V._make_bincount(16).func(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    for words, vector in zip(rows, got):
        want = [0.0] * 16
        for h in (hashlib.md5(w.encode()).hexdigest() for w in words or ()):
            want[int(h[:4], 16) % 16] += 1 if int(h[4], 16) < 8 else -1
        assert vector == want
    assert len(asked) == 2 + 3 + 2  # distinct words of three pieces, not all eleven
