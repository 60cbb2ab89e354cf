"""Statistics and access-audit queries. The completion log is derived from
``events`` (task = event_type, predict tokens = ``k`` of props, seconds =
value / 1000, 8 threads); a cycle is one user's hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prompts as P
from ..operators import stats as ST
from ..sources.tables import table
from . import sqlgen as S
from .catalog import query
from .q_prompts import TASK

THREADS = ST.DEFAULT_THREADS

LOG_SQL = (
    "log AS (SELECT event_id, ts, user_id, event_type AS task, "
    "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS predict_tokens, "
    "1::BIGINT AS prompt_tokens, value / 1000.0 AS predict_seconds, 0.0::DOUBLE AS prompt_seconds, "
    f"{THREADS}::BIGINT AS threads, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events)"
)


def completion_log(spark: SparkSession, sf: str) -> DataFrame:
    log = ST.completion_log(table(spark, sf, "events"), THREADS)
    return log.withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))


@query("cycle_stats",
       f"WITH {LOG_SQL}\nSELECT user_id, hour, sum(predict_tokens)::BIGINT AS predict_tokens, "
       f"sum(prompt_tokens)::BIGINT AS prompt_tokens, round(sum(predict_seconds), 6) AS predict_seconds, "
       f"round(sum(prompt_seconds), 6) AS prompt_seconds FROM log GROUP BY user_id, hour")
def cycle_stats(spark, sf):
    return ST.cycle_stats(completion_log(spark, sf), ["user_id", "hour"])


@query("task_stats",
       f"WITH {LOG_SQL},\n"
       f"c AS (SELECT task, user_id, hour, sum(predict_tokens) pt, sum(prompt_tokens) qt, sum(predict_seconds) ps, "
       f"sum(prompt_seconds) qs, sum(predict_seconds * threads) pth, sum(prompt_seconds * threads) qth "
       f"FROM log GROUP BY ALL)\n"
       f"SELECT task, count(*)::BIGINT AS cycles, sum(pt)::BIGINT AS predict_tokens, sum(qt)::BIGINT AS prompt_tokens, "
       f"round(sum(ps), 4) AS predict_seconds, round(sum(qs), 4) AS prompt_seconds, "
       f"round(sum(pth), 4) AS predict_thread_seconds, round(sum(qth), 4) AS prompt_thread_seconds "
       f"FROM c GROUP BY task")
def task_stats(spark, sf):
    return ST.task_stats(completion_log(spark, sf), ["user_id", "hour"])


@query("token_rates",
       f"WITH {LOG_SQL}\nSELECT task, round(sum(predict_tokens) / nullif(sum(predict_seconds), 0), 4) "
       f"AS predict_tokens_per_sec, round(sum(prompt_tokens) / nullif(sum(prompt_seconds), 0), 4) "
       f"AS prompt_tokens_per_sec FROM log GROUP BY task")
def token_rates(spark, sf):
    return ST.token_rates(completion_log(spark, sf))


@query("chat_throughput",
       "SELECT user_id, (count(*) - 1)::BIGINT AS n_tokens, "
       "round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS seconds, "
       "round((count(*) - 1) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 2) AS tokens_per_sec "
       "FROM events GROUP BY user_id")
def chat_throughput(spark, sf):
    return ST.chat_throughput(table(spark, sf, "events"))


# Grants of the order desk: caller (market segment) → allowed priorities;
# NULL = unrestricted; MACHINERY has no grant row (unknown caller).
GRANTS = (
    ("AUTOMOBILE", None),
    ("BUILDING", ["1-URGENT", "2-HIGH"]),
    ("FURNITURE", []),
    ("HOUSEHOLD", ["3-MEDIUM", "5-LOW"]),
)


def _grants_sql() -> str:
    rows = []
    for sub, names in GRANTS:
        lst = "NULL::VARCHAR[]" if names is None else ("[" + ", ".join(f"'{n}'" for n in names) + "]::VARCHAR[]")
        rows.append(f"('{sub}', {lst})")
    return "grants(sub, names) AS (VALUES " + ", ".join(rows) + ")"


@query("grant_audit",
       f"WITH {_grants_sql()}\n"
       f"SELECT o.o_orderkey, c.c_mktsegment AS caller, o.o_orderpriority AS name, "
       f"CASE WHEN g.sub IS NOT NULL AND (g.names IS NULL OR list_contains(g.names, o.o_orderpriority)) "
       f"THEN 200 ELSE 401 END::BIGINT AS status "
       f"FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN grants g ON g.sub = c.c_mktsegment")
def grant_audit(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                               F.col("c_mktsegment").alias("caller"))
    req = orders.join(cust, "o_custkey").drop("o_custkey")
    grants = spark.createDataFrame([(s, n) for s, n in GRANTS], "sub string, names array<string>")
    return ST.grant_audit(req, grants, "caller", "name").select("o_orderkey", "caller", "name", "status")


@query("status_counts",
       "WITH req AS (SELECT CASE WHEN 'src' || (conv_id % 25)::VARCHAR NOT IN (SELECT DISTINCT source FROM documents) "
       "THEN 404 WHEN len(list_intersect(" + S.tokens("text") + ", "
       "['Le', 'Die'])) > 0 THEN 400 ELSE 200 END AS status FROM conversations WHERE role = 'user' "
       "UNION ALL SELECT CASE WHEN event_type = 'error' THEN 500 ELSE 200 END FROM events)\n"
       "SELECT status::BIGINT AS status, count(*)::BIGINT AS n FROM req GROUP BY status")
def status_counts(spark, sf):
    from .q_memory import _requested_memory

    users = table(spark, sf, "conversations").filter(F.col("role") == "user") \
        .select("conv_id", "turn", "text", _requested_memory().alias("memory"))
    known = table(spark, sf, "documents").select(F.col("source").alias("memory")).distinct() \
        .withColumn("__known", F.lit(True))
    gated = P.private_gate(users, TASK.private_tokens, "text")
    req = gated.join(known, "memory", "left").select(
        F.when(F.col("__known").isNull(), F.lit("MemoryNotFound")).otherwise(F.col("error")).alias("error"))
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.lit("InferenceFailed")).alias("error"))
    allreq = req.unionByName(ev)
    return allreq.select(ST.status_code("error").alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
