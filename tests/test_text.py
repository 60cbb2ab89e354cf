import random
import re

import pytest
from pyspark.sql import functions as F

from chunk_model import hierarchical_chunks
from skein.config import ChunkConfig
from skein.functions import text as T
from skein.operators import text as ops

# Golden vectors: one character = one token.
GOLDEN = [
    ("abcd", [" "], 4, ["abcd"]),
    ("a b c d", [" "], 4, ["a ", "b ", "c d"]),
    ("ab cd ef", [" "], 3, ["ab ", "cd ", "ef"]),
    ("a b c ", [" "], 2, ["a ", "b ", "c "]),
    ("abcdefg h", [" "], 3, ["abc", "def", "g ", "h"]),
    ("a.b c.d e f.g", [".", " "], 4, ["a.", "b c.", "d ", "e ", "f.", "g"]),
    ("aaaa.bb.c", ["."], 4, ["aaaa", ".", "bb.", "c"]),
    ("aaa bb", [" "], 4, ["aaa ", "bb"]),
    ("abcdefgh", [], 3, ["abc", "def", "gh"]),
    ("", [" "], 3, []),
]


@pytest.mark.parametrize("text,seps,mx,expected", GOLDEN)
def test_chunk_golden(spark, text, seps, mx, expected):
    df = spark.createDataFrame([(list(text),)], "tk array<string>")
    got = df.select(T.chunk_tokens("tk", seps, mx).alias("c")).first()["c"]
    assert ["".join(c) for c in got] == expected


def test_chunk_random_against_model(spark):
    rnd = random.Random(3)
    for seps in ([" "], ["\n", "."], ["\n", ".", " "], []):
        for mx in (1, 2, 5, 9):
            rows = ["".join(rnd.choice("ab. \n") for _ in range(rnd.randint(0, 50))) for _ in range(40)]
            df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(rows)], "i int, tk array<string>")
            got = {r.i: [list(c) for c in r.c] for r in df.select("i", T.chunk_tokens("tk", seps, mx).alias("c")).collect()}
            for i, s in enumerate(rows):
                assert got[i] == [c for c in hierarchical_chunks(list(s), seps, mx) if c], (s, seps, mx)


def test_chunks_concatenate_to_clean_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cfg = ChunkConfig(separators=("\n", ".", " "), max_tokens=32, post_filter=())
    chunks = ops.chunk(docs, ["doc_id"], cfg)
    joined = chunks.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]),
                     "").alias("joined"))
    clean = docs.select("doc_id", T.prefilter(F.col("text")).alias("clean"))
    bad = joined.join(clean, "doc_id").filter(F.col("joined") != F.col("clean")).count()
    assert bad == 0
    assert chunks.filter(F.col("n_tokens") > 32).count() == 0


def test_chunk_by_rows_equals_literal(spark):
    """Separators and maximum as columns, all golden and random cases in one table."""
    rnd = random.Random(4)
    cases = [(t, s, m) for t, s, m, _ in GOLDEN]
    cases += [("".join(rnd.choice("ab. \n") for _ in range(rnd.randint(0, 50))), s, m)
              for s in ([" "], ["\n", "."], ["\n", ".", " "], []) for m in (1, 2, 5, 9) for _ in range(25)]
    df = spark.createDataFrame([(i, list(t), s, m) for i, (t, s, m) in enumerate(cases)],
                               "i int, tk array<string>, s array<string>, m int")
    got = df.select("i", T.chunk_bounds_by("tk", "s", "m").alias("b")).collect()
    for r in got:
        t, s, m = cases[r.i]
        assert [list(t[b.s - 1:b.e]) for b in r.b if b.e >= b.s] == [c for c in hierarchical_chunks(list(t), s, m) if c], cases[r.i]


def test_chunk_by_memory(spark):
    configs = {"a": ChunkConfig(), "b": ChunkConfig(separators=(), max_tokens=2, pre_filters=(), post_filter=(".",)),
               "c": ChunkConfig(separators=(".", " "), max_tokens=3, pre_filters=(r"[\r\t]",))}
    texts = ["a\tb....c\n\nd", "", None, "  x. y. z w  v", "a    b"]
    rows = [(i, m, t, 0) for m in ("a", "b", "c") for i, t in enumerate(texts)] + [(9, None, "a", 0), (9, "none", "a", 0)]
    df = spark.createDataFrame(rows, "id int, memory string, text string, max_tokens int")
    got = sorted(map(tuple, ops.chunk_by_memory(df, ops.settings_table(spark, configs), ["id"]).collect()))
    want = [(r.id, m, r.chunk_no, r.text, r.n_tokens) for m, c in configs.items()
            for r in ops.chunk(df.where(F.col("memory") == m), ["id"], c).collect()]
    assert got == sorted(want) and len(got) > 12
    assert ops.chunk_by_memory(df.limit(0), ops.settings_table(spark, configs), ["id"]).count() == 0


def test_settings_that_are_refused(spark):
    ok = ChunkConfig()
    bad = {"s": ChunkConfig(separators=("ab cd",)), "p": ChunkConfig(post_filter=("",)), "m": ChunkConfig(max_tokens=0), "ok": ok}
    settings = ops.settings_table(spark, bad)
    null = settings.where("memory = 'ok'").selectExpr("'n' AS memory", "separators", "max_tokens", "cast(null AS array<string>) AS pre_filters", "post_filter")
    settings = settings.union(null).union(settings.where("memory = 'ok'"))
    assert {tuple(r) for r in ops.invalid_settings(settings).collect()} == {
        ("s", "separator"), ("p", "post-filter"), ("m", "maximum"), ("n", "null"), ("ok", "repeated")}
    with pytest.raises(ops.InvalidChunkSeparator):
        ops.chunk_by_memory(spark.createDataFrame([(1, "s", "x")], "id int, memory string, text string"), settings, ["id"])


CLEANING = [
    ("a\tb", True, "a b"),
    ("a....b", True, "a b"),
    ("--x", True, " x"),
    ("a\nb", True, "a\nb"),
    ("a\n\nb", True, "a b"),
    ("a    b", False, "a    b"),
]


@pytest.mark.parametrize("text,default,expected", CLEANING)
def test_prefilter_golden(spark, text, default, expected):
    df = spark.createDataFrame([(text,)], "t string")
    pats = ChunkConfig().pre_filters if default else ()
    assert df.select(T.prefilter("t", pats).alias("c")).first()["c"] == expected


def test_prefilter_single_pass_collapse(spark):
    df = spark.createDataFrame([("a    b",)], "t string")
    assert df.select(T.prefilter("t", (r"[\r\t]",)).alias("c")).first()["c"] == "a  b"


def test_tokenizer_lossless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.filter(T.detokenize(T.tokenize("text")) != F.col("text")).count() == 0


def test_separator_must_be_one_token():
    with pytest.raises(ops.InvalidChunkSeparator):
        ops.check_single_tokens(["ab cd"])
    ops.check_single_tokens(["\n", ".", " "])


def test_vocabulary_dense_ids(spark):
    toks = spark.createDataFrame([(t,) for t in "b a c a b z é".split()], "token string")
    rows = {r.token: r.token_id for r in ops.vocabulary(toks, partitions=3).collect()}
    assert rows == {"a": 1, "b": 2, "c": 3, "z": 4, "é": 5}


def test_token_ids_shuffle_rare_tokens_only(spark, monkeypatch):
    """The same ids whether all, some or none of the tokens are sent to the rows."""
    words = "a " * 40 + "b " * 9 + "c c d"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(re.findall(r"\w|\s", words))], "pos int, token string")
    vocab = ops.vocabulary(rows, counts=True).cache()
    assert {r.token: r.n for r in vocab.collect()} == {" ": 51, "a": 40, "b": 9, "c": 2, "d": 1}
    asked = rows.union(spark.createDataFrame([(900, "not there"), (901, None)], "pos int, token string"))
    want = sorted(map(str, ops.token_ids(asked, vocab.drop("n")).collect()))
    assert len(want) == rows.count() + 2 and "Row(pos=0, token='a', token_id=2)" in want
    for size, common in ((60, None), (3 * 65, 8), (1000, 1)):
        monkeypatch.setattr(ops, "BROADCAST_BYTES", size)
        assert ops._common(vocab) == (common, size == 1000)
        got = ops.token_ids(asked, vocab)
        assert sorted(map(str, got.collect())) == want
        assert ("LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()) == (common == 8)


def test_token_stats(spark):
    df = spark.createDataFrame([(1, " a  b ")], "doc_id long, text string")
    r = ops.token_stats(df, ["doc_id"]).first()
    assert (r.n_tokens, r.n_words) == (6, 4)
