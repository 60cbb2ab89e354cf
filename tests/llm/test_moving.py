"""ARC to WARC, URL sweep, source mixing, packing, pipeline."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import arc_convert as AC
from skein.llm import mixing as MX
from skein.llm import packing as PK
from skein.llm import url_sweep as US
from skein.llm.queries import tokenizer_path
from skein.session import unique_subdir


def test_round_trip(spark):
    big, other = "é" * 600, "y" * 5000
    rows = [(1, "http://a/ b", big), (5, "http://a/x", big), (3, None, big), (7, "u", "short"), (2, "v", "short"), (4, "w", None),
            (6, "z", ""), (8, "q", other + "\r\n\r\n\n"), (9, "q", other), (None, "n", other), (11, "l", "<p>" * 300_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, path string").repartition(3)
    got = {r.page_id: r for r in AC.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i for i in got if got[i].record_type == "revisit"} == {1, 3}
    assert got[1].refers_to == got[3].refers_to == 5 and got[5].refers_to is None
    assert AC.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = AC.arc_version_block("f.arc", version) + b"\n"
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe raw \n\n", b"", b"no http"]
    for k, b in enumerate(blocks):
        body += AC.arc_record(f"http://x/{k} s", "19991231235959", "text/html", b, version, "f.arc") + b"\n\n"
    for content in (body, gzip.compress(body[:90]) + gzip.compress(body[90:])):
        got = list(AC.parse_arc(content))
        assert [r.block for r in got[1:]] == blocks and got[1].fields["URL"] == "http://x/0 s"
        assert [r.error for r in got] == [None] * 4
    assert list(AC.parse_arc(body[:-5]))[-1].error == "block shorter than declared"
    assert list(AC.parse_arc(body + b"what is this\n"))[-1].error
    assert list(AC.parse_arc(gzip.compress(body)[:-20]))[-1].error
    assert list(AC.parse_arc(b"")) == []
    warc = b"".join(AC.to_warc("f.arc", r) + b"\r\n\r\n" for r in AC.parse_arc(body))
    kinds = [(h["warc-type"], b) for h, b in AC.parse_warc(warc)]
    assert [k for k, _ in kinds] == ["warcinfo", "response", "resource", "resource"] and [b for _, b in kinds[1:]] == blocks
    assert next(iter(AC.parse_warc(warc[warc.index(b"WARC/1.0", 9):])))[0]["warc-date"] == "1999-12-31T23:59:59Z"


def test_foreign_archives(spark):
    """Any file names, nested folders, plain and gzip; equal names in two folders are two files."""
    import os

    def archive(k):
        block = AC.arc_version_block("x.arc", 1) + b"\n"
        return block + AC.arc_record(f"http://x/{k}", "2001", "text/html", f"HTTP/1.1 200 OK\r\nX-Page-Id: {k}\r\n\r\nbody {k}".encode(), 1, "x.arc") + b"\n\n"

    root = unique_subdir(spark, "arc-foreign")
    for name, data in (("IAH-20010101-00.arc", archive(1)), ("a/b/IAH-20010101-00.arc", archive(2)), ("a/other.arc.gz", gzip.compress(archive(3))),
                       ("_SUCCESS", b""), (".hidden", b"no archive"), ("a/empty.arc", b"")):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    out = AC.convert(spark, root, unique_subdir(spark, "warc-foreign"))
    assert sorted((r.page_id, r.payload_bytes) for r in AC.read_warc(spark, out).collect()) == [(1, 6), (2, 6), (3, 6)]
    ids = [r.id for r in AC.arc_index(AC._files(spark, root)).collect()]
    assert len(set(ids)) == 3


def test_archives_keep_bytes(spark):
    """Payloads that are no UTF-8 pass the text sink unchanged."""
    raw = bytes(range(256)) * 3
    head = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\n"
    block = AC.arc_version_block("a", 1) + b"\n" + AC.arc_record("u", "2001", "t/t", head + raw, 1, "a")
    arc = AC._write(spark.createDataFrame([(bytearray(block),)], "record binary"), unique_subdir(spark, "arc-bytes"), "\n")
    got = AC.read_warc(spark, AC.convert(spark, arc, unique_subdir(spark, "warc-bytes"))).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in got] == [(4, 768, hashlib.sha1(raw).hexdigest())]


def test_url_sweep_against_brute_force(spark):
    rnd = random.Random(6)
    label = lambda: rnd.choice(["a", "b", "org", "x-y", "ab"])
    host = lambda: ".".join(label() for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/a", "/b1", "1"]) for _ in range(rnd.randint(0, 3)))
    rules = sorted({(host(), path()): (rnd.choice(["allow", "block"])) for _ in range(80)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "x://", "http://ORG", "http://a.Org?q=/a", "://b#/a", "http://a..org/a", "h://É.org/a/"]
    urls += [f"http://{host()}{path()}{rnd.choice(['', '?z', '#/a'])}" for _ in range(3000)] + ["http://a.b.org/a"] * 1500

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        p = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fit, default=None)
        return h, p, best[2] if best else None, best[3] if best else "allow"

    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rdf = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in US.judge_urls(df, rdf).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert US.judge_urls(df.limit(0), rdf).count() == 0
    assert US.judge_urls(df.limit(5), rdf.limit(0)).where("rule IS NOT NULL").count() == 0


def mix_docs(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rnd.randint(0, 150)))) for i in range(400)]
    rows = [(i, t, "en", "hot" if i % 3 == 0 else rnd.choice(["b", "c", None]), 7) for i, t in rows]
    rows += [(None, "null id words", "en", "b", 0), (3, "same id", "en", "b", 0), (3, "same id", "en", "b", 0), (900, None, "en", "b", 0),
             (901, "tiny", "en", "z-empty", 0), (902, "", "en", "y-none", 0), (903, "long " * 30_000, "de", "c", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def water_fill(sizes):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    left, open_, target = sum(sizes.values()) * 1.5, set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in full)
    return target


def test_mixing(spark):
    df = mix_docs(spark).repartition(4)
    rows = MX.taken_words(df, MX.Mix(block=16)).collect()
    src = [(r.doc_id, r.source, len((r.text or "").split())) for r in df.collect()]
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, n) for i, _, n in src)
    sizes = {}
    for _, s, n in src:
        sizes[s] = sizes.get(s, 0) + n
    want = water_fill(sizes)
    by = {n: t for s, t in want.items() for n in [sizes[s]]}
    assert len(set(sizes.values())) == len(sizes)
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert abs(r.target - by[r.source_size]) < 1e-6 * max(1, r.target)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[n] - by[n]) <= 32 for n in taken)
    again = MX.taken_words(df.repartition(3), MX.Mix(block=16)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert MX.taken_words(df.limit(0)).count() == 0


def test_mixed_documents_are_the_taken_words(spark):
    df = mix_docs(spark)
    mix = MX.Mix(block=64)
    out = MX.mix_documents(df, mix)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in MX.taken_words(df, mix).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
    assert MX.mix_documents(df.limit(0)).count() == 0


#: Two words that polynomials modulo a power of two cannot tell apart.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_run_hash_tells_words_apart():
    from skein.llm.common import RunHash

    words = [THUE, MORSE, "", "a", "b", "ab", "ba", "a" * 70_000, "a" * 70_001, "b" + "a" * 70_000, *(f"w{i}" for i in range(500))]
    raw = " ".join(words).encode()
    a = np.frombuffer(raw + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for seed in (6, 20):
        h = RunHash(seed)(a, starts, ends)
        assert len(set(h.tolist())) == len(words)
        one = [int(RunHash(seed)(np.frombuffer(b" " + w.encode() + b" ", np.uint8), np.array([1]), np.array([1 + len(w)]))[0]) for w in words]
        assert one == h.tolist()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_cut_is_avoidable(seed):
    """Replayed: a cut piece found no sequence with room, and others went to the cheapest with room."""
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(6, 1 + seed / 5, 1500).astype(int).tolist()
    placed = PK.pack(lengths)
    n_seq = -(-sum(lengths) // PK.CAPACITY)
    full = sum(n // PK.CAPACITY for n in lengths)
    used, cost = dict.fromkeys(range(full, n_seq), 0), dict.fromkeys(range(full, n_seq), 0.0)
    order = sorted((i for i, n in enumerate(lengths) if n % PK.CAPACITY), key=lambda i: (-PK.cost(lengths[i] % PK.CAPACITY), i))
    cuts = 0
    for i in order:
        left = lengths[i] % PK.CAPACITY
        for _, m, s, off in placed[i][lengths[i] // PK.CAPACITY:]:
            room = [q for q in used if PK.CAPACITY - used[q] >= left] or [q for q in used if used[q] < PK.CAPACITY]
            cuts += PK.CAPACITY - used[s] < left
            assert (cost[s], s) == min((cost[q], q) for q in room) and off == used[s]
            used[s] += m
            cost[s] += PK.cost(m)
            left -= m
    assert cuts > 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 62, 66, 462, 2046, 5000])
def test_permutation(spark, n):
    """A bijection that leaves no run, another one per source and pass, for any number of blocks."""
    df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    for k in range(3):
        df = MX.permuted(df.withColumns({"src": F.lit(k % 2).cast("long"), "turn": F.lit(k // 2).cast("long")}), "id", "n", "src", "turn", 17, f"p{k}")
    rows = df.orderBy("id").collect()
    lists = [[r[f"p{k}"] for r in rows] for k in range(3)]
    assert all(sorted(x) == list(range(n)) for x in lists)
    if n >= 62:
        for x in lists:
            steps = np.diff(x) % n
            assert np.bincount(steps).max() < n / 8 and abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.35
        assert sum(a == b for a, b in zip(*lists[:2])) < n / 8 and sum(a == b for a, b in zip(lists[0], lists[2])) < n / 8


def test_shards_of_the_mix(spark):
    """Multinomial counts say which slots a shard holds; the shards' words are the taken words."""
    df = mix_docs(spark)
    mix = MX.Mix(block=16, slots_per_shard=50)
    rows, per = MX._sized(df.select("doc_id", "source", "text"), mix)
    slots = {r.src: r.slots for r in per.collect()}
    counts = MX.shard_counts(per, mix).collect()
    held = {}
    for r in sorted(counts, key=lambda r: (r.src, r.shard)):
        assert r.first == held.get(r.src, 0) and r.slots > 0
        held[r.src] = r.first + r.slots
    assert held == {s: n for s, n in slots.items() if n}
    shards = -(-sum(slots.values()) // 50)
    big = max(slots, key=slots.get)
    mean = slots[big] / shards
    got = [r.slots for r in counts if r.src == big]
    assert len(set(got)) > 1 and all(abs(x - mean) < 6 * mean ** 0.5 + 1 for x in got)
    words = {}
    for r in MX.mixed_blocks(df, mix).collect():
        assert 0 <= r.shard < shards and r.words > 0
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    want = {}
    for r in MX.taken_words(df, mix).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}


def test_outlying_and_null_ids_are_dealt_out(spark):
    rows = [(i, "s") for i in range(5000)] + [(10 ** 15, "s")] + [(None, "s")] * 5000 + [(7, "s")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit("a b c"))
    seen = MX._sized(df, MX.Mix())[0]
    ordered = sorted(r.off for r in seen.collect())
    assert ordered == list(range(0, 3 * len(rows), 3))
    slim = seen.select("src", "doc_id", "size", "key", "rid")
    ranged = slim.repartitionByRange(-(-len(rows) // MX.ROWS_PER_RANGE), "src", "doc_id", "size", "key", "rid")
    assert ranged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * MX.ROWS_PER_RANGE


def test_stages_take_any_column_names(spark):
    from skein.llm import ngram_rtree, quality_rules

    text = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    df = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 0), (2, text, "b", 5), (3, None, "c", 2)],
                               "doc_id long, text string, _stats string, _rows long")
    df = df.withColumn("_first", F.lit("f")).withColumn("_rest", F.lit(0)).withColumn("n_words", F.lit("x")).withColumn("_row", F.lit(1))
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r._stats for r in kept.collect()} <= {"a", "b"}
    one = ngram_rtree.keep_one(df)
    assert one.columns == df.columns and sorted((r.doc_id, r._rows) for r in one.collect()) == [(1, 0), (3, 2)]
    mixed = MX.mix_documents(df.withColumn("lang", F.lit("l")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1)).withColumn("key", F.lit(1)))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in mixed.collect()} == {1, 2}


def test_packing(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = [None, "", "<|endoftext|>", " a\u00a0b\x1cc ", "日本", "wörd " * 9000, "a <|endoftext|> b",
             "<|endoftext|><|endoftext|>x\u3000y<|endoftext", f"{THUE} {MORSE} {THUE}", "z" * 70_000 + " " + "z" * 70_001]
    texts += ["".join(rnd.choice(["ab ", "\n", " ", "é", "1'll", "  x", "\t"]) for _ in range(rnd.randint(0, 900))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, grp int, n int").repartition(3)
    rows = PK.pack_documents(df, tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    ids, seqs = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        part = np.frombuffer(bytes(r.ids), "<u4")
        assert len(part) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert r.start == len(ids.setdefault(r.doc_id, []))
        ids[r.doc_id] += part.tolist()
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        assert ids[i] == tok.encode(t or "", add_special_tokens=False).ids + [PK.END]
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(v) for i, v in ids.items()}
    for v in seqs.values():
        end = 0
        for off, n in sorted(v):
            assert off == end
            end += n
        assert end <= PK.CAPACITY
    assert len(seqs) == -(-sum(map(len, ids.values())) // PK.CAPACITY)
    slim = PK.pack_documents(df, tokenizer_path(), with_ids=False)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, slim.collect())) == sorted(map(key, rows))
    assert PK.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_packing_balances_cost():
    """Equal shares of long and short pieces come out with equal costs; nothing is lost
    and no sequence overflows whatever the lengths."""
    cost = lambda placed: sorted({s: sum(PK.cost(m) for c in placed for _, m, q, _ in c if q == s)
                                  for c in placed for _, _, s, _ in c}.values())
    four = PK.pack([1000, 1000, 1000, 1000, 900, 900, 900, 900])
    assert len(set(cost(four))) == 1 and len(cost(four)) == 4 and all(len(c) == 1 for c in four)
    rng = np.random.default_rng(1)
    lengths = rng.lognormal(6, 1.3, 2000).astype(int).tolist()
    full = {}
    for n, cuts in zip(lengths, PK.pack(lengths)):
        assert sum(m for _, m, _, _ in cuts) == n and [c[0] for c in cuts] == np.cumsum([0, *[c[1] for c in cuts]])[:-1].tolist()
        for _, m, s, _ in cuts:
            full[s] = full.get(s, 0) + m
    assert max(full.values()) <= PK.CAPACITY and len(full) == -(-sum(lengths) // PK.CAPACITY)


def test_pipeline_stages(spark):
    from skein.llm import ngram_rtree, quality_rank, quality_rules

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    good = {r.doc_id for r in quality_rank.rank_quality(docs, labels).where("predicted = 1").collect()}
    one = corpus_pipeline.classify(spark, docs, sf)
    assert one.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in one.collect()} == good
    kept = {r.doc_id for r in quality_rules.apply_rules(one).where("kept").collect()}
    two = corpus_pipeline.judge(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == kept
    first = {r.component_id for r in ngram_rtree.linked_documents(two).collect()}
    three = corpus_pipeline.deduplicate(spark, two, sf)
    assert {r.doc_id for r in three.collect()} == first and three.columns == docs.columns
    four = corpus_pipeline.mix(spark, three, sf).cache()
    assert four.columns == docs.columns and {r.doc_id for r in four.select("doc_id").collect()} <= first
    five = corpus_pipeline.pack(spark, four, sf)
    per = four.select("doc_id", F.length("text").alias("n")).count()
    assert five.where("start + length = doc_tokens").count() == per


def test_clean_documents_stay(spark):
    """Of labelled clean documents without copies the filters keep nearly all."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.judge(spark, corpus_pipeline.classify(spark, docs, sf), sf).select("doc_id")
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("size(split(text, ' ')) >= 40")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.97 * clean.count()
