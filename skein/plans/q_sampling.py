"""Queries of the candidate-scoring family. Scored candidates come from
``lineitem``: group = order, candidate = line number, score = the line's
largest extended price / 10000 (the (order, line) pair is not unique, so it is
aggregated first)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BIAS_ALLOW, BIAS_FORBID
from ..operators import sampling as SM
from ..sources.tables import table
from .catalog import query

TOP_K = 3
TOP_P = 0.6
TEMPERATURE = 0.8
PENALTY = 1.3
LAST_N = 2
SEED = 42
CHAIN_K = 40
CHAIN_P = 0.95
# Bias list of the task: candidate → bias.
BIAS = ((1, BIAS_FORBID), (4, BIAS_ALLOW))
#: Private candidates leave a bias list before the single-candidate test.
PRIVATE_CANDIDATE = 7
# Bias lists keyed by group (request and step): what the group's order number says.
GROUP_BIAS_SQL = (
    f"gbias AS (SELECT group_id, 1::BIGINT AS candidate, {BIAS_FORBID}::DOUBLE AS bias FROM g WHERE group_id % 3 = 0 UNION ALL "
    f"SELECT group_id, 2::BIGINT, {BIAS_ALLOW}::DOUBLE FROM g WHERE group_id % 2 = 0 UNION ALL "
    f"SELECT group_id, {PRIVATE_CANDIDATE}::BIGINT, {BIAS_ALLOW}::DOUBLE FROM g WHERE group_id % 4 = 0)")

CANDS_SQL = ("cands AS (SELECT l_orderkey AS group_id, l_linenumber::BIGINT AS candidate, "
             "max(l_extendedprice) / 10000 AS score FROM lineitem GROUP BY ALL)")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("candidate")) \
        .agg((F.max("l_extendedprice") / 10000).alias("score"))


def _bias(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame([(int(c), float(b)) for c, b in pairs], "candidate long, bias double")


def group_bias(cands: DataFrame) -> DataFrame:
    g = cands.select("group_id").distinct()
    n = F.col("group_id")
    listed = F.array(
        F.when(n % 3 == 0, F.struct(F.lit(1).cast("long").alias("candidate"), F.lit(float(BIAS_FORBID)).alias("bias"))),
        F.when(n % 2 == 0, F.struct(F.lit(2).cast("long").alias("candidate"), F.lit(float(BIAS_ALLOW)).alias("bias"))),
        F.when(n % 4 == 0, F.struct(F.lit(PRIVATE_CANDIDATE).cast("long").alias("candidate"), F.lit(float(BIAS_ALLOW)).alias("bias"))))
    return g.select("group_id", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("group_id", "x.*")


def _bias_sql(pairs) -> str:
    return "bias(candidate, bias) AS (VALUES " + ", ".join(f"({c}::BIGINT, {b}::DOUBLE)" for c, b in pairs) + ")"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Generation history per group: the order's lines by ship time."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("candidate"),
                     F.col("l_shipdate").alias("step"))


_PENALTY_SQL = (
    f"hist AS (SELECT DISTINCT group_id, candidate FROM (SELECT l_orderkey AS group_id, "
    f"l_linenumber::BIGINT AS candidate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, "
    f"l_linenumber DESC) AS rn FROM lineitem) WHERE rn <= {LAST_N}),\n"
    f"pen AS (SELECT c.group_id, c.candidate, CASE WHEN h.candidate IS NULL THEN c.score "
    f"WHEN c.score > 0 THEN c.score / {PENALTY} ELSE c.score * {PENALTY} END AS score "
    f"FROM cands c LEFT JOIN hist h ON h.group_id = c.group_id AND h.candidate = c.candidate)"
)


@query("flat_bias",
       f"WITH {CANDS_SQL}, {_bias_sql(BIAS)}, g AS (SELECT DISTINCT group_id FROM cands), {GROUP_BIAS_SQL}\n"
       f"SELECT c.group_id, c.candidate, round(c.score + coalesce(b.bias, 0) + coalesce(gb.bias, 0), 6) AS score "
       f"FROM cands c LEFT JOIN bias b USING (candidate) "
       f"LEFT JOIN gbias gb ON gb.group_id = c.group_id AND gb.candidate = c.candidate")
def flat_bias(spark, sf):
    """A list for all groups, then one per group."""
    c = candidates(spark, sf)
    r = SM.flat_bias(SM.flat_bias(c, _bias(spark, BIAS)), group_bias(c))
    return r.select("group_id", "candidate", F.round("score", 6).alias("score"))


@query("repetition_penalty",
       f"WITH {CANDS_SQL}, {_PENALTY_SQL}\nSELECT group_id, candidate, round(score, 6) AS score FROM pen")
def repetition_penalty(spark, sf):
    recent = SM.last_n_history(history(spark, sf), LAST_N)
    r = SM.repetition_penalty(candidates(spark, sf), recent, PENALTY)
    return r.select("group_id", "candidate", F.round("score", 6).alias("score"))


@query("top_k",
       f"WITH {CANDS_SQL}\nSELECT group_id, candidate, rank, round(score, 6) AS score FROM ("
       f"SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, candidate)::BIGINT AS rank "
       f"FROM cands) WHERE rank <= {TOP_K}")
def top_k(spark, sf):
    r = SM.top_k(candidates(spark, sf), TOP_K)
    return r.select("group_id", "candidate", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


def _softmax_sql2(src: str, t: float = 1.0) -> str:
    inner = f"(SELECT *, exp(score / {t} - max(score / {t}) OVER (PARTITION BY group_id)) AS e FROM {src})"
    return f"SELECT * EXCLUDE (e), e / sum(e) OVER (PARTITION BY group_id) AS prob FROM {inner}"


def _top_p_sql(src: str, p: float) -> str:
    return (f"SELECT * FROM (SELECT *, coalesce(sum(prob) OVER (PARTITION BY group_id ORDER BY score DESC, candidate "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass_before FROM ({_softmax_sql2(src)})) "
            f"WHERE mass_before < {p}")


@query("top_p",
       f"WITH {CANDS_SQL}\nSELECT group_id, candidate, round(prob, 6) AS prob, round(mass_before, 6) AS mass_before "
       f"FROM ({_top_p_sql('cands', TOP_P)})")
def top_p(spark, sf):
    r = SM.top_p(candidates(spark, sf), TOP_P)
    return r.select("group_id", "candidate", F.round("prob", 6).alias("prob"),
                    F.round("mass_before", 6).alias("mass_before"))


@query("temperature_softmax",
       f"WITH {CANDS_SQL}\nSELECT group_id, candidate, round(prob, 6) AS prob FROM ({_softmax_sql2('cands', TEMPERATURE)})")
def temperature_softmax(spark, sf):
    r = SM.temperature(candidates(spark, sf), TEMPERATURE)
    return r.select("group_id", "candidate", F.round("prob", 6).alias("prob"))


def _uniform_sql(seed: int) -> str:
    key = f"'{seed}' || '|' || group_id::VARCHAR || '|' || candidate::VARCHAR"
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / {float(16 ** 13)})"


@query("weighted_draw",
       f"WITH {CANDS_SQL}, {_PENALTY_SQL},\n"
       f"k AS (SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY group_id "
       f"ORDER BY score DESC, candidate) AS rank FROM pen) WHERE rank <= {CHAIN_K}),\n"
       f"p AS (SELECT * EXCLUDE (prob, mass_before) FROM ({_top_p_sql('k', CHAIN_P)})),\n"
       f"t AS (SELECT group_id, candidate, score / {TEMPERATURE} AS score FROM p),\n"
       f"s AS ({_softmax_sql2('t')})\n"
       f"SELECT group_id, arg_max(candidate, ln(prob) - ln(-ln({_uniform_sql(SEED)}))) AS candidate "
       f"FROM s GROUP BY group_id")
def weighted_draw(spark, sf):
    recent = SM.last_n_history(history(spark, sf), LAST_N)
    c = SM.repetition_penalty(candidates(spark, sf), recent, PENALTY)
    c = SM.top_k(c, CHAIN_K).drop("rank")
    c = SM.top_p(c, CHAIN_P).drop("prob", "mass_before")
    c = SM.temperature(c, TEMPERATURE)
    return SM.weighted_draw(c, SEED)


@query("single_candidate",
       f"WITH {CANDS_SQL}, g AS (SELECT DISTINCT group_id FROM cands), {GROUP_BIAS_SQL}\n"
       f"SELECT g.group_id, CASE WHEN count(b.candidate) = 1 AND min(b.bias) > 0 THEN min(b.candidate) END AS forced, "
       f"count(b.candidate) = 1 AND coalesce(min(b.bias) > 0, false) AS shortcut "
       f"FROM g LEFT JOIN gbias b ON b.group_id = g.group_id AND b.candidate <> {PRIVATE_CANDIDATE} GROUP BY g.group_id")
def single_candidate(spark, sf):
    """One list per group: empty, one entry of either sign, several, or with a private one."""
    c = candidates(spark, sf)
    return SM.single_candidate(c, group_bias(c), [PRIVATE_CANDIDATE])
