"""JSON texts against schemas that are rows of a table.

A registry (schema name, schema as JSON text) is flattened to rules by path, one map for
each schema. A text joins the rules of its schema; its nodes are unfolded level by level
as an array inside the row, and every node is held against the rule of its path. The plan
grows with the depth of the deepest schema, not with the number of schemas or properties,
and texts are not shuffled by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonschema import number_kind, too_many_decimals
from ..sources.tables import spread

RULE = ("struct<type:string,min:double,max:double,decimals:int,max_length:long,min_items:long,max_items:long,"
        "enum:array<string>,required:array<string>>")
_TEXTS = pa.list_(pa.string())
_RULE = pa.struct([("type", pa.string()), ("min", pa.float64()), ("max", pa.float64()), ("decimals", pa.int32()),
                   ("max_length", pa.int64()), ("min_items", pa.int64()), ("max_items", pa.int64()),
                   ("enum", _TEXTS), ("required", _TEXTS)])
TYPES = ("boolean", "null", "number", "string", "array", "object")


class InvalidSchema(ValueError):
    """A schema of the registry that cannot be used."""


def _step(key: str) -> str:
    """A property as a step of a path; array members are the step ``/[]``."""
    return "/." + key.replace("~", "~0").replace("/", "~1")


def flatten(schema: Mapping[str, Any], path: str = "") -> Iterator[tuple[str, dict[str, Any]]]:
    """(path, rule) of a schema and all that it contains."""
    if not isinstance(schema, Mapping) or schema.get("type") not in TYPES:
        raise InvalidSchema(f"{path or '/'}: unknown type")
    get = schema.get
    yield path, {
        "type": get("type"), "min": None if get("min") is None else float(get("min")),
        "max": None if get("max") is None else float(get("max")), "decimals": int(get("max_decimals") or 0),
        "max_length": get("max_length"), "min_items": get("min_items"), "max_items": get("max_items"),
        "enum": get("enum"), "required": list(get("required") or [])}
    if get("type") == "array":
        yield from flatten(get("items"), path + "/[]")
    if get("type") == "object":
        for key, sub in (get("properties") or {}).items():
            yield from flatten(sub, path + _step(key))


def schema_rules(registry: DataFrame, name: str = "schema", text: str = "definition") -> DataFrame:
    """``name, rules (map of path to rule), depth, reason`` of each row of the registry, a row
    a schema; ``reason`` says why a schema cannot be used (then there are no rules)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules, depth, reason = [], [], []
            for t in b.column(1).to_pylist():
                try:
                    got = list(flatten(json.loads(t)))
                    pa.array([r for _, r in got], _RULE)  # fields of the wrong kind are found here
                    rules.append(got), depth.append(max(p.count("/") for p, _ in got)), reason.append(None)
                except (ValueError, TypeError, AttributeError, OverflowError, RecursionError, pa.ArrowException) as e:
                    rules.append(None), depth.append(None), reason.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rules, pa.map_(pa.string(), _RULE)), pa.array(depth, pa.int32()), pa.array(reason, pa.string())],
                ["name", "rules", "depth", "reason"])

    got = registry.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string"))
    out = got.mapInArrow(run, f"name string, rules map<string,{RULE}>, depth int, reason string")
    return out.withColumn("reason", F.when(F.col("name").isNull(), "null name").otherwise(F.col("reason")))


def invalid_schemas(rules: DataFrame) -> DataFrame:
    """``name, reason`` of the schemas of :func:`schema_rules` that cannot be used, repeated names included."""
    twice = rules.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rules.where("reason IS NOT NULL").select("name", "reason").unionByName(twice.select("name", F.lit("repeated").alias("reason")))


def _children(node: Column) -> Column:
    """The members of a node, with their paths; none for a scalar."""
    path, v = node["path"], node["v"]
    kind = F.schema_of_variant(v)
    key = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    fields = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: F.struct(
        F.concat(path, F.lit("/."), key(e["key"])).alias("path"), e["value"].alias("v")))
    items = F.transform(v.try_cast("array<variant>"), lambda x: F.struct(F.concat(path, F.lit("/[]")).alias("path"), x.alias("v")))
    none = F.array().cast("array<struct<path:string,v:variant>>")
    return F.when(kind.startswith("OBJECT"), fields).when(kind.startswith("ARRAY"), items).otherwise(none)


def _fits(node: Column, rule: Column, check_all: bool) -> Column:
    """Whether a node satisfies its rule (the members have rules of their own)."""
    v = node["v"]
    kind = F.schema_of_variant(v)
    num, txt = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    number = number_kind(v) & F.coalesce(num >= rule["min"], F.lit(True)) & F.coalesce(num <= rule["max"], F.lit(True))
    string = kind == "STRING"
    if check_all:
        number = number & ~too_many_decimals(txt, num, rule["decimals"])
        string = (string & F.coalesce(F.array_contains(rule["enum"], txt), F.lit(True))
                  & F.coalesce(F.octet_length(txt) <= rule["max_length"], F.lit(True)))
    n = F.size(v.try_cast("array<variant>"))
    array = kind.startswith("ARRAY") & F.coalesce(n >= rule["min_items"], F.lit(True)) & F.coalesce(n <= rule["max_items"], F.lit(True))
    keys = F.map_keys(v.try_cast("map<string,variant>"))
    obj = kind.startswith("OBJECT") & F.forall(rule["required"], lambda k: F.array_contains(keys, k))
    t = rule["type"]
    ok = (F.when(t == "boolean", kind == "BOOLEAN").when(t == "null", kind == "VOID").when(t == "number", number)
          .when(t == "string", string).when(t == "array", array).when(t == "object", obj))
    return F.coalesce(ok, F.lit(False))


def valid_by_schema(df: DataFrame, registry: DataFrame, schema_col: str = "schema", text_col: str = "text",
                    out_col: str = "valid", check_all: bool = False, name: str = "schema",
                    definition: str = "definition", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with the boolean ``out_col``: the text of a row parses and satisfies the schema
    that the row names; null where the row's schema is null or unknown, false for a null text.
    A column named ``out_col`` is replaced; repeated rows stay.

    ``registry``: a row a schema (``name``, ``definition``). One that cannot be used raises
    :class:`InvalidSchema` before any text is read. Rules of at most ``broadcast_bytes``,
    measured as JSON, go to the texts; larger ones meet them in an ordinary join.
    """
    rules = schema_rules(registry, name, definition)
    bad = invalid_schemas(rules).first()
    if bad is not None:
        raise InvalidSchema(f"{bad.name}: {bad.reason}")
    seen = rules.agg(F.max("depth").alias("depth"), F.sum(F.octet_length(F.to_json("rules"))).alias("bytes")).first()
    depth = seen.depth or 0
    df = df.drop(out_col)
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = spread(df).select(packed.alias("__row"), F.col(schema_col).cast("string").alias("__name"),
                             F.try_parse_json(F.col(text_col)).alias("__v"))
    named = rules.select(F.col("name").alias("__name"), F.col("rules").alias("__rules"))
    rows = rows.join(F.broadcast(named) if (seen.bytes or 0) <= broadcast_bytes else named, "__name", "left")
    known = F.col("__rules")
    level = F.array(F.struct(F.lit("").alias("path"), F.col("__v").alias("v")))
    levels = ["__l0"]
    rows = rows.withColumn("__l0", level)
    for d in range(depth):  # members of nodes that have a rule; others fail already
        inner = F.filter(F.col(f"__l{d}"), lambda n: F.map_contains_key(known, n["path"]))
        rows = rows.withColumn(f"__l{d + 1}", F.flatten(F.transform(inner, _children)))
        levels.append(f"__l{d + 1}")
    ok = F.col("__v").isNotNull()
    for c in levels:
        ok = ok & F.forall(F.col(c), lambda n: _fits(n, F.try_element_at(known, n["path"]), check_all))
    result = F.when(known.isNotNull(), F.coalesce(ok, F.lit(False)))
    return rows.select("__row.*", result.alias(out_col))
