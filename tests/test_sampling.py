from pyspark.sql import functions as F

from skein.operators import sampling as SM


def _cands(spark):
    rows = [(1, 1, 2.0), (1, 2, 1.0), (1, 3, 0.5), (2, 1, -1.0), (2, 2, 3.0)]
    return spark.createDataFrame(rows, "group_id long, candidate long, score double")


def test_top_k_and_top_p(spark):
    c = _cands(spark)
    assert sorted((r.group_id, r.candidate) for r in SM.top_k(c, 1).collect()) == [(1, 1), (2, 2)]
    kept = SM.top_p(c, 0.6).filter(F.col("group_id") == 1).collect()
    assert [r.candidate for r in sorted(kept, key=lambda r: -r.score)] == [1]


def test_repetition_and_bias(spark):
    c = _cands(spark)
    recent = spark.createDataFrame([(1, 1), (2, 1)], "group_id long, candidate long")
    got = {(r.group_id, r.candidate): r.score for r in SM.repetition_penalty(c, recent, 2.0).collect()}
    assert got[(1, 1)] == 1.0 and got[(2, 1)] == -2.0 and got[(1, 2)] == 1.0
    bias = spark.createDataFrame([(3, 10000.0)], "candidate long, bias double")
    got = {(r.group_id, r.candidate): r.score for r in SM.flat_bias(c, bias).collect()}
    assert got[(1, 3)] == 10000.5


def test_draw_is_deterministic_and_valid(spark):
    c = SM.temperature(_cands(spark), 0.8)
    a = sorted(tuple(r) for r in SM.weighted_draw(c, 7).collect())
    b = sorted(tuple(r) for r in SM.weighted_draw(c, 7).collect())
    assert a == b and len(a) == 2


def test_single_candidate(spark):
    c = _cands(spark)
    run = lambda rows, **kw: {r.group_id: (r.forced, r.shortcut) for r in SM.single_candidate(
        c, spark.createDataFrame(rows, "candidate long, bias double"), **kw).collect()}
    assert run([(3, 9.0)]) == {1: (3, True), 2: (3, True)}
    assert run([(3, -9.0)]) == {1: (None, False), 2: (None, False)}
    assert run([(1, -9.0), (3, 9.0)])[1] == (None, False)  # a second entry, even a negative one
    assert run([(1, 9.0), (3, 9.0)], private=[1])[1] == (3, True)
    per = spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0), (2, 2, -5.0)], "group_id long, candidate long, bias double")
    assert {r.group_id: r.forced for r in SM.single_candidate(c, per).collect()} == {1: 2, 2: None}
    got = {(r.group_id, r.candidate): r.score for r in SM.flat_bias(c, per).collect()}
    assert got[(1, 2)] == 6.0 and got[(2, 2)] == -2.0 and got[(1, 1)] == 2.0
