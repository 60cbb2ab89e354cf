"""Queries of the generated-token post-processing family. Responses are the
assistant turns of ``conversations``; response id = (conv_id, turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import detokenize, tokenize
from ..operators import tokens as G
from ..sources.tables import table
from . import sqlgen as S
from .catalog import query

STOPS = ("in the", "Die ", "ent")
STOPS_TEXT = ("\n", ". ")
MAX_TOKENS = 16
EOT = "\n"
PRIVATE = (",",)

_RESP = f"(SELECT conv_id, turn, {S.tokens('text')} AS tk FROM conversations WHERE role = 'assistant')"


#: The first token that completes a stop string, by the rules: matching starts at a token
#: boundary, partial progress (k characters) carries over, and a token that breaks it is
#: tried again from the start.
_STOP_CTES = (
    f"WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, conv_id, turn, tk FROM {_RESP}),\n"
    "t AS (SELECT rid, unnest(range(1, len(tk) + 1)) AS i, unnest(tk) AS token FROM r),\n"
    "st(stop) AS (VALUES " + ", ".join(f"({S.lit(s)})" for s in STOPS) + "),\n"
    "m(rid, stop, i, k, hit) AS (SELECT rid, stop, 0::BIGINT, 0::BIGINT, false FROM r, st UNION ALL\n"
    "  SELECT m.rid, stop, m.i + 1, CASE WHEN starts_with(token, stop[k + 1:]) THEN 0 "
    "WHEN starts_with(stop[k + 1:], token) THEN k + len(token) WHEN starts_with(stop, token) THEN len(token) ELSE 0 END, "
    "starts_with(token, stop[k + 1:]) OR (NOT starts_with(stop[k + 1:], token) AND starts_with(token, stop))\n"
    "  FROM m JOIN t ON t.rid = m.rid AND t.i = m.i + 1 WHERE NOT hit),\n"
    "c AS (SELECT rid, min(i) AS stop_at FROM m WHERE hit GROUP BY rid)\n"
)
_CUT = "tk[1:coalesce(stop_at - 1, len(tk))]"


@query("stop_tokens",
       _STOP_CTES + f"SELECT conv_id, turn, stop_at::BIGINT AS stop_at, coalesce(array_to_string({_CUT}, ''), '') AS text "
                    "FROM r LEFT JOIN c USING (rid)")
def stop_tokens(spark, sf):
    r = G.stop_tokens(G.response_tokens(table(spark, sf, "conversations")), STOPS)
    return r.select("conv_id", "turn", F.col("stop_at").cast("long"), detokenize("tokens").alias("text"))


#: A task per session; the stops of three of the four are the word pairs of the benchmark items.
_BY_TASK_CTES = (
    "WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, conv_id, turn, 'task' || conv_id % 4 AS task, tk "
    f"FROM {_RESP}),\n"
    "t AS (SELECT rid, unnest(range(1, len(tk) + 1)) AS i, unnest(tk) AS token FROM r),\n"
    "b AS (SELECT 'task' || item_id % 3 AS task, tk, unnest(range(1, len(tk) - 1)) AS i "
    f"FROM (SELECT item_id, {S.tokens('text')} AS tk FROM benchmark)),\n"
    "st AS (SELECT DISTINCT task, array_to_string(tk[i:i + 2], '') AS stop FROM b WHERE tk[i + 1] = ' '),\n"
    "m(rid, stop, i, k, hit) AS (SELECT rid, stop, 0::BIGINT, 0::BIGINT, false FROM r JOIN st USING (task) UNION ALL\n"
    "  SELECT m.rid, stop, m.i + 1, CASE WHEN starts_with(token, stop[k + 1:]) THEN 0 "
    "WHEN starts_with(stop[k + 1:], token) THEN k + len(token) WHEN starts_with(stop, token) THEN len(token) ELSE 0 END, "
    "starts_with(token, stop[k + 1:]) OR (NOT starts_with(stop[k + 1:], token) AND starts_with(token, stop))\n"
    "  FROM m JOIN t ON t.rid = m.rid AND t.i = m.i + 1 WHERE NOT hit),\n"
    "c AS (SELECT rid, min(i) AS stop_at, arg_min(stop, (i, stop)) AS stopped_by FROM m WHERE hit GROUP BY rid)\n"
)


@query("stop_tokens_by_task",
       _BY_TASK_CTES + f"SELECT conv_id, turn, task, stop_at::BIGINT AS stop_at, stopped_by, "
                       f"coalesce(array_to_string({_CUT}, ''), '') AS text FROM r LEFT JOIN c USING (rid)")
def stop_tokens_by_task(spark, sf):
    """Stop sequences from a table, by task."""
    tk = F.col("tk")
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("task"), F.col("item_id") % 3).alias("task"),
                                                 tokenize("text").alias("tk"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(tk) - 2, F.lit(1))), lambda i: F.get(tk, i) == " "),
                        lambda i: F.array_join(F.slice(tk, i, 3), ""))
    stops = items.select("task", F.explode(pairs).alias("stop"))
    replies = G.response_tokens(table(spark, sf, "conversations")).withColumn(
        "task", F.concat(F.lit("task"), F.col("conv_id") % 4))
    r = G.stop_tokens_by_task(replies, stops)
    return r.select("conv_id", "turn", "task", F.col("stop_at").cast("long"), "stopped_by", detokenize("tokens").alias("text"))


#: Leading tokens that the stop rules leave of a reply.
KEPT_SQL = (f"least(len(tk), {MAX_TOKENS}, coalesce(stop_at - 1, len(tk)), "
            f"coalesce(nullif(list_position(tk, {S.lit(EOT)}), 0) - 1, len(tk)))")
POSTPROCESS_SQL = (
    _STOP_CTES + f"SELECT conv_id, turn, coalesce(array_to_string(list_filter("
    f"tk[1:{KEPT_SQL}], "
    "lambda t: " + " AND ".join(f"t <> {S.lit(p)}" for p in PRIVATE) + "), ''), '') AS text FROM r LEFT JOIN c USING (rid)"
)


@query("postprocess", POSTPROCESS_SQL)
def postprocess(spark, sf):
    """All generation stop rules together."""
    r = G.postprocess(G.response_tokens(table(spark, sf, "conversations")), STOPS, MAX_TOKENS, EOT, PRIVATE)
    return r.select("conv_id", "turn", detokenize("tokens").alias("text"))


@query("stop_text",
       "SELECT conv_id, turn, p::BIGINT AS stop_at, CASE WHEN p IS NULL THEN text ELSE substr(text, 1, p - 1) END "
       "AS text FROM (SELECT conv_id, turn, text, list_min(list_filter(["
       + ", ".join(f"strpos(text, {S.lit(s)})" for s in STOPS_TEXT)
       + "], lambda x: x > 0)) AS p FROM conversations WHERE role = 'assistant')")
def stop_text(spark, sf):
    a = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return G.stop_text(a, STOPS_TEXT)


@query("max_tokens",
       f"SELECT conv_id, turn, array_to_string(tk[1:{MAX_TOKENS}], '') AS text, "
       f"len(tk[1:{MAX_TOKENS}])::BIGINT AS n_tokens FROM {_RESP}")
def max_tokens(spark, sf):
    r = G.max_tokens(G.response_tokens(table(spark, sf, "conversations")), MAX_TOKENS)
    return r.select("conv_id", "turn", detokenize("tokens").alias("text"), F.size("tokens").cast("long").alias("n_tokens"))


@query("eot_cut",
       f"SELECT conv_id, turn, CASE WHEN list_position(tk, {S.lit(EOT)}) IS NULL THEN array_to_string(tk, '') "
       f"ELSE array_to_string(tk[1:list_position(tk, {S.lit(EOT)}) - 1], '') END AS text FROM {_RESP}")
def eot_cut(spark, sf):
    r = G.eot_cut(G.response_tokens(table(spark, sf, "conversations")), EOT)
    return r.select("conv_id", "turn", detokenize("tokens").alias("text"))


@query("swallow_private",
       "SELECT conv_id, turn, array_to_string(list_filter(tk, lambda t: "
       + " AND ".join(f"t <> {S.lit(p)}" for p in PRIVATE)
       + f"), '') AS text FROM {_RESP}")
def swallow_private(spark, sf):
    r = G.swallow_private(G.response_tokens(table(spark, sf, "conversations")), PRIVATE)
    return r.select("conv_id", "turn", detokenize("tokens").alias("text"))


@query("response_text",
       f"SELECT conv_id, turn, coalesce(array_to_string(tk, ''), '') AS text FROM {_RESP}")
def response_text(spark, sf):
    conv = table(spark, sf, "conversations")
    return G.response_text(G.response_token_rows(conv), all_responses=G.responses(conv))


@query("cycle_segments",
       "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS msg_no, text "
       "FROM conversations WHERE role = 'assistant'")
def cycle_segments(spark, sf):
    stream = G.reply_stream(table(spark, sf, "conversations")).select("conv_id", "pos", "token")
    seg = G.cycle_segments(stream)
    return (seg.groupBy("conv_id", "msg_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                          lambda s: s["token"]), "").alias("text")))


@query("utf8_reassembly",
       "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")
def utf8_reassembly(spark, sf):
    """Assistant replies as 3-byte pieces (characters split across pieces),
    reassembled in order and decoded."""
    a = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return G.reassemble_utf8(G.byte_pieces(a, ["conv_id", "turn"], 3))
