"""Tokens of a vocabulary table: both ways against a model, and in chunks and gates."""

import random

import pytest
from pyspark.sql import functions as F

from chunk_model import hierarchical_chunks
from skein.config import ChunkConfig
from skein.operators import prompts as P
from skein.operators import segment as SEG
from skein.operators import text as ops


def model(text, ids):
    """Among all tokens that begin at a place the longest; a lone character where there is none."""
    if text is None:
        return None
    out = []
    while text:
        fits = [t for t in ids if t and text.startswith(t)]
        token = max(fits, key=len) if fits else text[0]
        out.append((token, ids.get(token)))
        text = text[len(token):]
    return out


def vocab(spark, ids):
    return spark.createDataFrame(list(ids.items()), "token string, token_id long")


def got(df):
    return {r.i: None if r.tokens is None else [tuple(t) for t in r.tokens] for r in df.select("i", "tokens").collect()}


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_segments_against_model(spark, broadcast_bytes):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    ids = {word(rnd.randint(1, 6)): k for k in range(60)}
    texts = [word(rnd.randint(0, 40)) for _ in range(150)] + [None, "", "zz\x00\n", "a" * 3_000]
    rows = [(i, t, "x", i, "y", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string, row string, __row int, __matches string, tokens int")
    out = SEG.segment(df, vocab(spark, ids), broadcast_bytes=broadcast_bytes)
    assert out.columns == ["i", "text", "row", "__row", "__matches", "tokens"]
    seen = got(out)
    assert seen == {i: model(t, ids) for i, t in enumerate(texts)}
    assert all("".join(x for x, _ in seen[i]) == t for i, t in enumerate(texts) if t is not None)


def test_large_vocabulary_meets_each_place_once(spark, monkeypatch):
    """A vocabulary that stays a table: rows exchanged follow the characters, not the lengths of
    its tokens, nothing of it is broadcast, and a bucket with many places is dealt out."""
    monkeypatch.setattr(SEG, "GROUP_PLACES", 50)
    rnd = random.Random(7)
    ids = {"".join(rnd.choice("ab") for _ in range(n)): 100 * n + k for n in range(1, 25) for k in range(4)}
    texts = ["".join(rnd.choice("aaabbb-.]^") for _ in range(60)) for _ in range(40)] + ["aaaa" * 30] * 10 + ["b", "c", "", "ab-"]
    ids["-"] = 9
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = SEG.segment(df, vocab(spark, ids), broadcast_bytes=0)
    assert got(out) == {i: model(t, ids) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "(piece" not in plan


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_segment_edges(spark, broadcast_bytes):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "ab"), (2, None)], "i int, text string")
    odd = spark.createDataFrame([("ab", 9), ("ab", 7), ("", 1), (None, 2), ("a", None)], "token string, token_id long")
    rows = SEG.segment(df, odd, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(str(r.tokens) for r in rows) == sorted(["[Row(token='ab', token_id=7)]"] * 3 + ["None"])
    none = SEG.segment(df, odd.limit(0), broadcast_bytes=broadcast_bytes).where("i = 1").first()
    assert [tuple(t) for t in none.tokens] == [("a", None), ("b", None)]
    assert SEG.segment(df.limit(0), odd, broadcast_bytes=broadcast_bytes).count() == 0


def test_chunks_of_vocabulary_tokens(spark):
    ids = {"ab": 1, "abc": 2, ". ": 3, "bc": 4}
    texts = ["abcab. bcx. abab. abcabcabc", "", ". . . ", "xyz. abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    cfg = ChunkConfig(separators=(". ",), max_tokens=3, pre_filters=(), post_filter=("x",))
    seen = {}
    for r in ops.chunk(df, ["i"], cfg, vocab=vocab(spark, ids)).orderBy("i", "chunk_no").collect():
        seen.setdefault(r.i, []).append((r.text, r.n_tokens))
    for i, t in enumerate(texts):
        parts = [[x for x in c if x != "x"] for c in hierarchical_chunks([x for x, _ in model(t, ids)], [". "], 3)]
        assert seen.get(i, []) == [("".join(c), len(c)) for c in parts if c]
    with pytest.raises(ops.InvalidChunkSeparator):
        ops.chunk(df, ["i"], ChunkConfig(separators=("bca",)), vocab=vocab(spark, ids))


def test_gate_on_vocabulary_tokens(spark):
    turns = spark.createDataFrame([(1, "x<end>"), (2, "x<en d>"), (3, None), (4, "<end>>")], "i int, text string")
    ids = {"<end>": 1, "<end>>": 2, "<": 3}
    r = P.private_gate(turns, ["<end>"], vocab=vocab(spark, ids))
    assert r.columns == ["i", "text", "status", "error"]
    assert [x.status for x in r.orderBy("i").collect()] == [400, 200, 200, 200]  # 4: the longer token is another
    assert r.where(F.col("error") == "IllegalToken").count() == 1


def test_tokens_that_begin_alike_are_parted(spark, monkeypatch):
    """Most of a vocabulary begins like "ab": no bucket holds much more of it than another, and
    tokens that are themselves beginnings of many are found."""
    monkeypatch.setattr(SEG, "GROUP_BYTES", 40 * SEG.ENTRY_BYTES)
    folders = {}
    monkeypatch.setattr(SEG, "unique_subdir", lambda s, name, f=SEG.unique_subdir: folders.setdefault(name, f(s, name)))
    rnd = random.Random(3)
    tail = lambda lo, hi: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(lo, hi)))
    ids = {t: k for k, t in enumerate(dict.fromkeys(["ab", "aba", "abab", "a", *("ab" + tail(1, 6) for _ in range(3000)), *(tail(2, 3) for _ in range(50))]))}
    texts = [tail(1, 40) for _ in range(60)] + ["ab", "ababx", "abab", "xab", "aab a", "", None, *list(ids)[:100]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert got(SEG.segment(df, vocab(spark, ids), broadcast_bytes=0)) == {i: model(t, ids) for i, t in enumerate(texts)}
    sizes = [r["count"] for r in spark.read.parquet(folders["segment-tokens"]).groupBy("bucket").count().collect()]
    assert max(sizes) <= 4 * 40 and sum(sizes) > 0.8 * len(ids)


def test_texts_become_objects_few_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(SEG, "TEXT_CHARS", 10)
    texts = ["abc", None, "defg", "é" * 30, "", "h", "ij" * 4, "k"]
    pieces = list(SEG._few(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]), 0))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts
    assert all(sum(len(t or "") for t in p.column(0).to_pylist()[1:]) <= 10 for p in pieces) and len(pieces) >= 3
