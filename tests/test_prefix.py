import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators.prefix import running_sum


def test_running_sum_matches_window(spark):
    rnd = random.Random(5)
    rows = [(g, o, rnd.randint(-5, 9)) for g in range(4) for o in rnd.sample(range(200), 60 if g else 150)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = {(r.g, r.o): r.s for r in running_sum(df, ["g"], "o", "v", "s", block=7).collect()}
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = {(r.g, r.o): r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert got == exp


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, None, 5), (1, 4, 1), (1, 9000, 1)], "g long, o long, v long")
    got = sorted(((r.g, r.o, r.s) for r in running_sum(df, ["g"], "o", "v", "s").collect()), key=str)
    assert got == sorted([(None, 1, 2), (None, 2, 5), (1, None, 5), (1, 4, 6), (1, 9000, 7)], key=str)


def test_sessions_without_an_id(spark):
    from skein.config import TaskConfig
    from skein.operators import prompts as P

    conv = spark.createDataFrame([(None, 0, "a"), (None, 1, "b"), (1, 0, "c")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r.prelude, r.prompt) for r in P.assemble(conv, TaskConfig(prelude="P", prefix="> Le ")).collect()}
    assert got == {(None, 0): ("P", "> Le a"), (None, 1): ("", "> Le b"), (1, 0): ("P", "> Le c")}
    assert P.context_usage(conv).count() == 3
    gate = P.private_gate(conv, ["b"]).collect()  # the user's own text, not the task's prefix
    assert {(r.conv_id, r.turn): r.status for r in gate} == {(None, 0): 200, (None, 1): 400, (1, 0): 200}
