"""Queries of the JSON family over ``events.props`` (``{"k": n}``)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import jsonschema as J
from ..functions.text import tokenize
from ..operators import jsonmask as JM
from ..operators import schemas as SC
from ..operators import text as ops
from ..sources.tables import spread, table
from . import sqlgen as S
from .catalog import query

# Result schema of the event payloads.
PROPS_SCHEMA = {"type": "object", "required": ["k"],
                "properties": {"k": {"type": "number", "min": 0, "max": 50, "max_decimals": 0}}}
ENUM_MAX_LENGTH = 6


@query("json_is_valid",
       "SELECT event_id, coalesce(json_valid(props) AND json_type(props) = 'OBJECT' AND json_keys(props) = ['k'] "
       "AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
       "AND json_extract(props, '$.k')::DOUBLE BETWEEN 0 AND 50, false) AS valid FROM events")
def json_is_valid(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "props"))
    return e.select("event_id", J.is_valid("props", PROPS_SCHEMA).alias("valid"))


#: A registry of result schemas, one for each task.
SCHEMAS = {
    "task0": PROPS_SCHEMA,
    "task1": {"type": "object", "required": [], "properties": {
        "k": {"type": "number", "min": 20}, "tags": {"type": "array", "min_items": 2, "items": {"type": "number", "max": 300}}}},
    "task2": {"type": "object", "required": ["o"], "properties": {
        "o": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number", "max": 40}}}, "s": {"type": "string"}}},
}


@query("json_valid_by_schema",
       "WITH t AS (SELECT event_id, 'task' || (event_id % 3) AS task, props, regexp_extract(props, '([0-9]+)', 1) AS d FROM events),\n"
       "v AS (SELECT event_id, task, unnest([props, '{\"tags\":[' || d || ',7' || d || ']}', "
       "'{\"s\":\"' || d || '\",\"o\":{\"k\":' || d || '}}', '{\"o\":{},\"s\":' || d || '}', '{\"tags\":[' || d || '],\"k\":' || d || '}', d]) AS j, "
       "unnest([0, 1, 2, 3, 4, 5])::BIGINT AS variant FROM t),\n"
       "k AS (SELECT *, json_type(j) = 'OBJECT' AS obj, coalesce(json_keys(j), []) AS ks, json_keys(j, '$.o') AS ok, "
       "TRY_CAST(json_extract_string(j, '$.k') AS DOUBLE) AS k, TRY_CAST(json_extract_string(j, '$.o.k') AS DOUBLE) AS o, "
       "TRY_CAST(json_extract(j, '$.tags') AS DOUBLE[]) AS tags FROM v)\n"
       "SELECT event_id, variant, task, obj AND CASE task "
       "WHEN 'task0' THEN coalesce(ks = ['k'] AND k BETWEEN 0 AND 50, false) "
       "WHEN 'task1' THEN list_has_all(['k', 'tags'], ks) AND coalesce(k >= 20, true) "
       "AND coalesce(len(tags) >= 2 AND list_max(tags) <= 300, true) "
       "ELSE list_has_all(['o', 's'], ks) AND coalesce(ok = ['k'] AND o <= 40, false) "
       "AND coalesce(json_type(j, '$.s') = 'VARCHAR', true) END AS valid FROM k")
def json_valid_by_schema(spark, sf):
    """Results of three tasks, each held against its task's schema from a registry table: the
    payloads, and arrays, nested objects and a bare number made of their values."""
    e = spread(table(spark, sf, "events").select("event_id", "props"))
    d = F.regexp_extract("props", "([0-9]+)", 1)
    text = lambda *parts: F.concat(*[d if p is None else F.lit(p) for p in parts])
    texts = F.array(F.col("props"), text('{"tags":[', None, ",7", None, "]}"), text('{"s":"', None, '","o":{"k":', None, "}}"),
                    text('{"o":{},"s":', None, "}"), text('{"tags":[', None, '],"k":', None, "}"), d)
    rows = e.select("event_id", F.concat(F.lit("task"), F.col("event_id") % 3).alias("task"),
                    F.posexplode(texts).alias("variant", "text"))
    registry = spark.createDataFrame([(k, json.dumps(v)) for k, v in SCHEMAS.items()], "schema string, definition string")
    return SC.valid_by_schema(rows, registry, "task").select("event_id", F.col("variant").cast("long").alias("variant"), "task", "valid")


#: Number bounds (min, max) whose grammars the strict query runs.
BOUNDS = ((0, 50), (5, 50), (20, 50), (None, None), (0, None), (None, 3))


def _number_schema(lo, hi):
    return {"type": "object", "required": ["k"], "properties": {"k": {"type": "number", "min": lo, "max": hi}}}


def _grammar_sql(lo, hi) -> str:
    """A literal ``n`` (text) by the grammar's rules, prefix by prefix: every character
    after the first needs all shorter prefixes strictly inside the bounds."""
    def inside(v, strict):
        ops = (">", "<") if strict else (">=", "<=")
        return " AND ".join([f"{v} {op} {b}" for op, b in zip(ops, (lo, hi)) if b is not None] or ["true"])
    minus = "-?" if any(b is None or b < 0 for b in (lo, hi)) else ""
    head = "(CASE WHEN n LIKE '-%' THEN 2 ELSE 1 END)"
    step = f"len(list_filter(range({head}, len(n)), lambda i: NOT ({inside('TRY_CAST(n[1:i] AS DOUBLE)', True)} AND TRY_CAST(n[1:i] AS DOUBLE) < 4294967295 " \
           f"AND {inside('TRY_CAST(n[1:i+1] AS DOUBLE)', False)}))) = 0"
    return (f"CASE WHEN regexp_full_match(n, '{minus}[1-9][0-9]*') THEN (n LIKE '-%' OR {inside('TRY_CAST(n[1:1] AS DOUBLE)', False)}) AND {step} "
            f"ELSE false END")


@query("json_strict",
       "WITH t AS (SELECT event_id, props, regexp_extract(props, '(-?[0-9]+)', 1) AS d FROM events),\n"
       "v AS (SELECT event_id, props, unnest([d, '-' || d, d || '7', d || '000000000']) AS n, "
       "unnest([0, 1, 2, 3])::BIGINT AS variant FROM t)\n"
       "SELECT event_id, variant, regexp_full_match(props, '\\{\"k\":[1-9][0-9]*\\}') AS strict_raw, "
       + ", ".join(f"{_grammar_sql(*b)} AS strict_{i}" for i, b in enumerate(BOUNDS)) + " FROM v")
def json_strict(spark, sf):
    """The payloads as they are (they hold a space, so the grammar rejects them), and
    objects around numbers derived from them: as given, negated, and with digits added."""
    e = spread(table(spark, sf, "events").select("event_id", "props"))
    d = F.regexp_extract("props", "(-?[0-9]+)", 1)
    n = F.array(d, F.concat(F.lit("-"), d), F.concat(d, F.lit("7")), F.concat(d, F.lit("000000000")))
    v = e.select("event_id", "props", F.posexplode(n).alias("variant", "n"))
    text = F.concat(F.lit('{"k":'), F.col("n"), F.lit("}"))
    return v.select("event_id", F.col("variant").cast("long").alias("variant"),
                    J.is_strict("props", _number_schema(None, None)).alias("strict_raw"),
                    *[J.is_strict(text, _number_schema(*b)).alias(f"strict_{i}") for i, b in enumerate(BOUNDS)])


@query("json_lexeme",
       "SELECT CASE token WHEN 'true' THEN 'true' WHEN 'false' THEN 'false' WHEN 'null' THEN 'null' "
       "WHEN ':' THEN 'colon' WHEN '.' THEN 'decimal' WHEN '{' THEN 'curly_open' WHEN '}' THEN 'curly_close' "
       "WHEN '[' THEN 'bracket_open' WHEN ']' THEN 'bracket_close' WHEN ',' THEN 'comma' WHEN '-' THEN 'minus' "
       "WHEN '\"' THEN 'double_quote' ELSE CASE WHEN regexp_full_match(token, '\\+?[0-9]+') AND "
       "TRY_CAST(ltrim(token, '+') AS DECIMAL(38,0)) <= 18446744073709551615 THEN 'digit' "
       "WHEN token = '\\' THEN 'invalid' ELSE 'string' END END AS lexeme, count(*)::BIGINT AS n "
       f"FROM (SELECT unnest({S.tokens('props')}) AS token FROM events) GROUP BY ALL")
def json_lexeme(spark, sf):
    e = table(spark, sf, "events")
    toks = e.select(F.explode(tokenize(F.col("props"))).alias("token"))
    return toks.groupBy(J.lexeme("token").alias("lexeme")).agg(F.count(F.lit(1)).alias("n"))


_ENUM_SQL = (
    "vals AS (SELECT DISTINCT event_type AS v FROM events),\n"
    "states AS (SELECT DISTINCT v[1:i] AS state FROM vals, range(0, 64) r(i) WHERE i <= len(v)),\n"
    f"rem AS (SELECT state, v[len(state) + 1:] AS remainder, len(v) = len(state) AS may_end FROM states "
    f"JOIN vals ON starts_with(v, state) WHERE strlen(v) <= {ENUM_MAX_LENGTH})\n"
)


def _states_and_values(spark, sf):
    vals = table(spark, sf, "events").select(F.col("event_type").alias("value")).distinct()
    return JM.prefixes(vals), vals


@query("enum_remainders", "WITH " + _ENUM_SQL + "SELECT state, remainder, may_end FROM rem")
def enum_remainders(spark, sf):
    states, vals = _states_and_values(spark, sf)
    return JM.enum_remainders(states, vals, ENUM_MAX_LENGTH)


@query("vocab_mask",
       "WITH " + _ENUM_SQL
       + f", vocab AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents)\n"
         "SELECT DISTINCT r.state, t.token FROM rem r JOIN vocab t ON len(t.token) > 0 AND "
         "starts_with(r.remainder, t.token) AND NOT regexp_matches(t.token, '[\"\\n\\t\\r]')")
def vocab_mask(spark, sf):
    states, vals = _states_and_values(spark, sf)
    rem = JM.enum_remainders(states, vals, ENUM_MAX_LENGTH)
    vocab = ops.token_rows(table(spark, sf, "documents"), []).select("token")
    return JM.vocab_mask(rem, vocab)


STRING_REMAINING = 3


@query("any_string_mask",
       f"SELECT DISTINCT token FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents) "
       f"WHERE len(token) > 0 AND strlen(token) <= {STRING_REMAINING} "
       "AND NOT regexp_matches(token, '[\"\\n\\t\\r]') UNION SELECT '\"' AS token")
def any_string_mask(spark, sf):
    """Vocabulary tokens allowed inside a free JSON string with a few bytes left."""
    vocab = ops.token_rows(table(spark, sf, "documents"), []).select("token")
    quote = spark.range(1).select(F.lit('"').alias("token"))  # every vocabulary has it
    return JM.any_string_mask(vocab.unionByName(quote).distinct(), STRING_REMAINING)
