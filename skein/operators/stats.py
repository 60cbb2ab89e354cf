"""Usage statistics and access audit: hash aggregates (partial + final) and
broadcast look-ups of bounded registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DEFAULT_THREADS = 8


def completion_log(events: DataFrame, threads: int = DEFAULT_THREADS) -> DataFrame:
    """A completion log derived from ``events``: task = event_type, one row per
    inference step with predict tokens (``k`` of ``props``), prompt tokens (1),
    duration seconds (``value / 1000``) and thread count."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("task"),
        F.coalesce(k, F.lit(0)).alias("predict_tokens"),
        F.lit(1).cast("long").alias("prompt_tokens"),
        (F.col("value") / 1000.0).alias("predict_seconds"),
        F.lit(0.0).alias("prompt_seconds"),
        F.lit(threads).cast("long").alias("threads"),
    )


def cycle_stats(log: DataFrame, cycle_keys: Sequence[str]) -> DataFrame:
    """Sum per-step stats into one row per cycle."""
    return log.groupBy(*cycle_keys).agg(
        F.sum("predict_tokens").alias("predict_tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.round(F.sum("predict_seconds"), 6).alias("predict_seconds"),
        F.round(F.sum("prompt_seconds"), 6).alias("prompt_seconds"),
    )


def task_stats(log: DataFrame, cycle_keys: Sequence[str], task_col: str = "task") -> DataFrame:
    """Per task: cycles, tokens, durations and thread-time (duration × threads)."""
    per_cycle = log.groupBy(task_col, *cycle_keys).agg(
        F.sum("predict_tokens").alias("pt"), F.sum("prompt_tokens").alias("qt"),
        F.sum("predict_seconds").alias("ps"), F.sum("prompt_seconds").alias("qs"),
        F.sum(F.col("predict_seconds") * F.col("threads")).alias("pth"),
        F.sum(F.col("prompt_seconds") * F.col("threads")).alias("qth"),
    )
    return per_cycle.groupBy(task_col).agg(
        F.count(F.lit(1)).alias("cycles"),
        F.sum("pt").alias("predict_tokens"), F.sum("qt").alias("prompt_tokens"),
        F.round(F.sum("ps"), 4).alias("predict_seconds"), F.round(F.sum("qs"), 4).alias("prompt_seconds"),
        F.round(F.sum("pth"), 4).alias("predict_thread_seconds"),
        F.round(F.sum("qth"), 4).alias("prompt_thread_seconds"),
    )


def token_rates(log: DataFrame, task_col: str = "task") -> DataFrame:
    """Prompt and predict tokens per second per task (NULL when no time)."""
    return log.groupBy(task_col).agg(
        F.round(F.try_divide(F.sum("predict_tokens").cast("double"), F.sum("predict_seconds")), 4)
        .alias("predict_tokens_per_sec"),
        F.round(F.try_divide(F.sum("prompt_tokens").cast("double"), F.sum("prompt_seconds")), 4)
        .alias("prompt_tokens_per_sec"),
    )


def chat_throughput(stream: DataFrame, session_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Tokens per second of a chat from its token arrival times: every token
    after the send adds the gap since the previous one, and the gaps telescope
    to ``last - first``. A plain aggregate, so a huge session is combined
    map-side instead of being sorted in one task."""
    secs = F.timestamp_diff("MICROSECOND", F.min(ts_col), F.max(ts_col)).cast("double")
    return stream.groupBy(session_col).agg(
        (F.count(F.lit(1)) - 1).cast("long").alias("n_tokens"),
        F.round(secs / 1e6, 6).alias("seconds"),
        F.round(F.try_divide((F.count(F.lit(1)) - 1).cast("double"), secs / 1e6), 2).alias("tokens_per_sec"),
    )


def grant_audit(requests: DataFrame, grants: DataFrame, caller_col: str, name_col: str) -> DataFrame:
    """Allowed if the caller's list is absent (NULL = unrestricted) or contains
    the requested name; else 401. Unknown callers are denied. ``grants`` is a
    registry (one row per caller); adaptive execution picks the join."""
    g = grants.select(F.col("sub").alias(caller_col), F.col("names").alias("__names"),
                      F.lit(True).alias("__known"))
    allowed = F.coalesce(F.col("__known"), F.lit(False)) & (
        F.col("__names").isNull() | F.coalesce(F.array_contains("__names", F.col(name_col)), F.lit(False)))
    return (requests.join(g, caller_col, "left")
            .withColumn("status", F.when(allowed, F.lit(200)).otherwise(F.lit(401)).cast("long"))
            .drop("__names", "__known"))


#: The status of each error.
ERROR_STATUS = {
    "ModelNotFound": 404, "TaskNotFound": 404, "MemoryNotFound": 404,
    "IllegalToken": 400, "InvalidDocument": 400, "Unauthorized": 401,
}


def status_code(error: str = "error"):
    """Outcome → HTTP status: NULL error → 200; known errors by table; else 500."""
    e = F.col(error)
    expr = F.when(e.isNull(), F.lit(200))
    for name, code in ERROR_STATUS.items():
        expr = expr.when(e == name, F.lit(code))
    return expr.otherwise(F.lit(500)).cast("long")


def unknown_names(requests: DataFrame, registry: DataFrame, name_col: str) -> DataFrame:
    """Requests naming something absent from the registry (404): a left-anti
    join against the registry, which is broadcast when small."""
    reg = registry.select(F.col("name").alias(name_col)).distinct()
    return requests.join(reg, name_col, "left_anti")
