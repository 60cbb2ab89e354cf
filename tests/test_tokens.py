import random

import pytest
from pyspark.sql import functions as F

from skein.operators import tokens as G

# (stops, tokens, 1-based position of the token that ends the response)
CASES = [
    (["END"], ["ENDING"], 1),                       # longer than the stop string
    (["END"], ["aEND", "b"], None),                 # no start inside a token
    (["xxy"], ["x", "x", "x", "y"], None),          # no fallback inside the stop string
    (["<stop>"], ["go", "<", "stop", ">", "on"], 4),
    (["no"], ["n", "no"], 2),                       # progress breaks, the same token starts afresh
    (["uvw"], ["uv", "q", "uvw"], 3),
    (["halt"], ["ha", "ha", "lt"], 3),
    (["ij", "jk"], ["i", "jk"], 2),                 # either of two
    (["é!"], ["é", "", "!"], 3),                    # an empty token changes nothing
    (["zz"], [], None),
]


@pytest.mark.parametrize("stops,tokens,want", CASES)
def test_stop_position(spark, stops, tokens, want):
    df = spark.createDataFrame([(tokens,)], "tk array<string>")
    assert df.select(G.stop_position("tk", stops).alias("p")).first()["p"] == want


def test_stops_by_task(spark):
    """The cases as tasks of one table, besides a hundred stops each that never occur."""
    stops = [(str(n), s) for n, c in enumerate(CASES) for s in [*c[0], *c[0], None, *(f"never{i}" for i in range(100))]]
    stops += [(None, "b"), ("empty", "")]
    replies = [(n, str(n), c[1], c[2]) for n, c in enumerate(CASES)]
    replies += [(100, None, ["a", "b"], 2), (101, "other", ["END"], None), (102, "empty", ["a"], 1), (103, "empty", [], None),
                (104, "0", None, None)]
    df = spark.createDataFrame(replies, "id long, task string, tokens array<string>, want int")
    got = G.stop_tokens_by_task(df, spark.createDataFrame(stops, "task string, stop string")).collect()
    assert len(got) == len(replies)
    source = {n: t for n, _, t, _ in replies}
    for r in got:
        assert r.stop_at == r.want, r
        assert r.tokens == (source[r.id] if r.want is None else source[r.id][:r.want - 1])
    by = {r.id: r.stopped_by for r in got}  # of 7 both complete, the first is named
    assert by[7] == "ij" and by[100] == "b" and by[101] is None


def test_stops_by_task_plan_does_not_grow(spark):
    """1,000 stops over three tasks give the plan of three; results equal the literal stops'."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, f"t{i % 3}", [rnd.choice(["a", "b", "ab", "ba", " "]) for _ in range(rnd.randint(0, 12))])
                                for i in range(150)], "id long, task string, tokens array<string>")

    def stops(n):
        return [(f"t{i % 3}", "".join(random.Random(i).choices("ab ", k=3 + i // 50))) for i in range(n)]

    few, many = (G.stop_tokens_by_task(df, spark.createDataFrame(stops(n), "task string, stop string")) for n in (3, 1000))
    plans = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (few, many)]
    assert abs(plans[0] - plans[1]) < 100
    got = {r.id: (r.stop_at, r.tokens) for r in many.collect()}
    for t in range(3):
        some = [s for k, s in stops(1000) if k == f"t{t}"][:40]
        want = G.stop_tokens(df.where(F.col("task") == f"t{t}"), some).collect()
        mine = G.stop_tokens_by_task(df, spark.createDataFrame([(f"t{t}", s) for s in some], "task string, stop string"))
        mine = {r.id: (r.stop_at, r.tokens) for r in mine.where(F.col("task") == f"t{t}").collect()}
        assert {r.id: (r.stop_at, r.tokens) for r in want} == mine
        assert all((got[i][0] or 99) <= (at or 99) for i, (at, _) in mine.items())


def test_stops_by_task_are_looked_up(spark):
    """Of 20,000 stops of a task a reply is matched with those that begin like its text at a
    token; odd tokens (empty, null, longer than the anchor) and stops change nothing."""
    rnd = random.Random(9)
    pool = ["a", "b", "", " ", None, "abababababab", "é😀"]
    df = spark.createDataFrame([(i, None if i % 2 else "t", [rnd.choice(pool) for _ in range(rnd.randint(0, 14))]) for i in range(120)]
                               + [(500, "t", None), (501, "t", [""])], "id long, task string, tokens array<string>")
    used = ["".join(rnd.choice(["a", "b", " ", "é", "😀"]) for _ in range(rnd.randint(1, 12))) for _ in range(30)] + ["ababababab", "abababababab a"]
    stops = [(k, s) for k in ("t", None) for s in used] + [("t", f"z{i}") for i in range(20_000)]
    table = spark.createDataFrame(stops, "task string, stop string")
    out = G.stop_tokens_by_task(df, table)
    want = {r.id: (r.stop_at, r.tokens) for r in G.stop_tokens(df, used).collect()}
    assert {r.id: (r.stop_at, r.tokens) for r in out.collect()} == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "__anchor" in plan and plan.index("collect_set(__stop") > plan.index("Project")


def live_position(stops, tokens):
    matched = [0] * len(stops)
    for i, t in enumerate(tokens):
        steps = [G.stop_advance(m, t.encode(), s.encode()) for m, s in zip(matched, stops)]
        matched = [m for _, m in steps]
        if any(done for done, _ in steps):
            return i + 1
    return None


@pytest.mark.parametrize("stops,tokens,want", CASES)
def test_live_stop_position(stops, tokens, want):
    assert live_position(stops, tokens) == want


def test_live_and_batch_stops_agree(spark):
    rnd = random.Random(3)
    rows = [(["".join(rnd.choice("pq") for _ in range(rnd.randint(0, 3))) for _ in range(8)],) for _ in range(300)]
    stops = ["ppq", "qqqp"]
    got = spark.createDataFrame(rows, "tk array<string>").select("tk", G.stop_position("tk", stops).alias("p")).collect()
    assert all(live_position(stops, r.tk) == r.p for r in got)
    assert len({r.p for r in got}) > 4


def test_postprocess_order(spark):
    df = spark.createDataFrame([(["a", ",", "b", "in", " ", "the", "c"],)], "tokens array<string>")
    r = G.postprocess(df, stops=["in the"], max_tokens=10, eot="c", private_tokens=[","]).first()
    assert r.tokens == ["a", "b", "in", " "]
    r = G.postprocess(df, max_tokens=2, private_tokens=[","]).first()
    assert r.tokens == ["a"]


def test_stop_text(spark):
    df = spark.createDataFrame([("one. two\nthree",)], "text string")
    assert G.stop_text(df, ["\n", ". "]).first()["text"] == "one"


def test_cycle_segments(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "b", "", "c", ""])]
    df = spark.createDataFrame(rows, "conv_id long, pos long, token string")
    got = [(r.pos, r.msg_no) for r in G.cycle_segments(df).orderBy("pos").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_stream_equals_batch(spark):
    from skein.plans import q_streaming, q_tokens
    from skein.sources.tables import table

    sf = "/root/testdata/sf0.001"
    streamed = {(r.conv_id, r.turn): r.text for r in q_streaming.stream_stop(spark, sf).collect()}
    resp = G.response_tokens(table(spark, sf, "conversations"))
    batch = G.postprocess(resp, q_tokens.STOPS, q_tokens.MAX_TOKENS, q_tokens.EOT, q_tokens.PRIVATE)
    expected = {(r.conv_id, r.turn): "".join(r.tokens or []) for r in batch.collect()}
    assert streamed == expected


def test_live_state_over_micro_batches(spark):
    """A response whose tokens arrive in several micro-batches: written one after the other."""
    import os
    import time

    from skein.session import unique_subdir
    from skein.streaming import live as L

    work = unique_subdir(spark, "t-bands")
    tokens = ["a", "b", "st", "op", "c"]
    for k, t in enumerate(tokens):
        rows = [(1, 0, k, t), (2, 0, k, "x"), (3, 0, k, "stop")]
        spark.createDataFrame(rows, "conv_id long, turn long, pos long, token string").coalesce(1).write.mode("append").parquet(work + "/in")
        time.sleep(1.1)  # the source orders files by time
    schema = spark.read.parquet(work + "/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(work + "/in")
    live = L.live_token_filter(stream, ["conv_id", "turn"], ["stop"], 4)
    L.run_available(live, os.path.join(work, "out"), os.path.join(work, "ck"))
    keys = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (None, 0)], "conv_id long, turn long")
    got = {r.conv_id: r.text for r in G.response_text(L.read_batches(spark, work + "/out"), all_responses=keys).collect()}
    assert got == {1: "abst", 2: "xxxx", 3: "", None: ""}


def test_response_text_keeps_empty_replies(spark):
    conv = spark.createDataFrame([(1, 0, "assistant", ""), (1, 1, "assistant", None), (None, 2, "assistant", "a b"), (1, 3, "user", "x")],
                                 "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.text for r in G.response_text(G.response_token_rows(conv), all_responses=G.responses(conv)).collect()}
    assert got == {(1, 0): "", (1, 1): "", (None, 2): "a b"}
