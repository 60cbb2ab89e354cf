"""Word-table BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import word_bpe as WB

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", None, "It's the DOG's 3rd, don't WE'LL i'd", "Été naïve œuvre ÇA 12½ ²x", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
       "\x1c\x1d x\x1e\x85y\xa0z", "İstanbul ǅ K Å é Å", "日本語 テキスト 🙂🙂 ١٢٣", "''' '' 's'S", "x" * 5000, " a​b﻿ c",
       "ſtraße ﬁ ΑΣ ας", "\x00\x01 a\x00b \x00<|endoftext|>", "tab\tnl\n\n cr\r", "<|endoftext|>", "–dash— ‘q’ “Q”…"]


def expected(texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        yield ids, tok.decode(ids, skip_special_tokens=False)


def test_words_of_every_plain_character():
    """The own splitter equals the library on all characters that it takes, side by side."""
    w, tok = WB.Words(PATH), Tokenizer.from_file(PATH)
    assert w.known
    rnd = random.Random(3)
    other = [*range(0x180, 0xD800), *range(0xE000, 0x11000)]
    texts = [f"a{c}{d}B{c}1{c}" for c in WB.PLAIN for d in "'s 9é"]
    texts += ["".join(rnd.choices(WB.PLAIN + list("'stdrevml  "), k=40)) for _ in range(3000)]
    texts += ["".join(rnd.choice(WB.PLAIN) + chr(rnd.choice(other)) for _ in range(12)) for _ in range(3000)]
    for t in texts:
        assert [i for x in w.split(t) for i in w.ids(w.listed(x))] == tok.encode(t, add_special_tokens=False).ids, ascii(t)


@pytest.mark.parametrize("block", [1, 50, 8 << 20])
def test_encode_and_decode(spark, monkeypatch, block):
    monkeypatch.setattr(WB, "BLOCK_CHARS", block)
    rnd = random.Random(block)
    texts = ODD + ["".join(rnd.choice(["the ", "Dog", "é ", "'s ", "9", " ", "日", "\n", "<|endoftext|>"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (3, texts[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(5)
    got = WB.digests(df, PATH).collect()
    want = sorted((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                  for r, (ids, d) in zip(rows, expected([r[1] for r in rows])))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert WB.digests(df.limit(0), PATH).count() == 0


def test_query_on_a_whole_table(spark):
    from skein.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
            for r, (ids, d) in zip(docs, expected([r.text for r in docs]))}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op13_word_bpe(spark, sf).collect()}
    assert got == want


def test_decode_alone(spark):
    tok = Tokenizer.from_file(PATH)
    lists = [[], [49407, 1, 49406], [5, 4_000_000_000, 7], None]
    df = spark.createDataFrame([(i, None if x is None else bytearray(np.array(x, "<u4").tobytes()), "old") for i, x in enumerate(lists)],
                               "k int, ids binary, decoded string")
    got = {r.k: r.decoded for r in WB.decode(df, PATH).collect()}
    assert got == {0: "", 1: tok.decode(lists[1], skip_special_tokens=False), 2: tok.decode([5, 7], skip_special_tokens=False), 3: None}


def test_other_files_use_the_library(spark):
    """A file with another normaliser, splitting rule and decoder."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Hello  World\n\n it's", "é日 <|endoftext|> x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in WB.decode(WB.encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False))
