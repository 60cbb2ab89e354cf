"""JSON results against a schema, as native Spark expressions.

Schemas are dicts tagged by ``type``: ``boolean``, ``null``,
``object{required, properties}``, ``number{min, max, max_decimals}``,
``array{items, min_items, max_items}``, ``string{max_length, enum}``.
They are compiled once, on the driver, into a ``Column`` over a ``VARIANT``
(``try_parse_json``): no UDF, evaluated per row inside codegen'd stages.

* :func:`is_valid` - validity (default semantics: ``enum``, ``max_length`` and
  ``max_decimals`` are not checked unless ``check_all``).
* :func:`strict_regex` / :func:`is_strict` - would the schema grammar have
  produced this exact text (keys in required order, no optional keys, no
  whitespace, numbers start with 1-9 and grow by the rules of :func:`_grown`,
  arrays never empty and up to max+1 items)? Regular for a finite schema but for
  the numbers: one anchored regex plus value checks.
* :func:`lexeme` - JSON lexeme class of a token string.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Schema = Mapping[str, Any]
U64_MAX = 18446744073709551615
U32_MAX = 4294967295


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def number_kind(v: Column) -> Column:
    k = _kind(v)
    return k.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")


def too_many_decimals(txt: Column, num: Column, most: Column) -> Column:
    """Whether a number, as text and value, has more than ``most`` decimals (ending zeros do not count)."""
    frac = F.regexp_extract(txt, r"\.([0-9]*?)0*$", 1)
    scaled = num * F.pow(F.lit(10.0), most)
    return F.when(txt.rlike("[eE]"), F.floor(scaled) != scaled).otherwise(F.length(frac) > most)


def _grown(txt: Column, schema: Schema) -> Column:
    """Whether a number literal can be written character by character: a first digit
    is within [min, max] unless a minus precedes it; a literal grows on only while its
    value so far lies strictly between min and max and below 2^32 - 1, to one within
    [min, max]. Values move one way as digits follow, so the first digit, the literal
    without its last character, and the whole decide."""
    lo = None if schema.get("min") is None else F.lit(float(schema["min"]))
    hi = None if schema.get("max") is None else F.lit(float(schema["max"]))

    def inside(v: Column, strict: bool) -> Column:
        ok = F.lit(True)
        if lo is not None:
            ok = ok & ((v > lo) if strict else (v >= lo))
        if hi is not None:
            ok = ok & ((v < hi) if strict else (v <= hi))
        return ok

    value = txt.try_cast("double")
    before = F.substring(txt, F.lit(1), F.length(txt) - 1).try_cast("double")
    signed = F.startswith(txt, F.lit("-"))
    head = F.substring(txt, F.lit(1), F.when(signed, 2).otherwise(1))
    first = head.try_cast("double")
    whole = txt == head
    grows = inside(first, True) & inside(before, True) & (before < U32_MAX) & inside(value, False)
    ok = F.when(whole, signed | inside(value, False)).otherwise(grows & (signed | inside(first, False)))
    return txt.rlike(r"\A-?[1-9][0-9]*(\.[0-9]+)?\z") & ok


def _valid(schema: Schema, v: Column, check_all: bool, grammar: bool = False) -> Column:
    t = schema.get("type")
    k = _kind(v)
    if t == "number" and grammar:
        return F.coalesce(number_kind(v) & _grown(F.try_variant_get(v, "$", "string"), schema), F.lit(False))
    if t == "boolean":
        return k == "BOOLEAN"
    if t == "null":
        return k == "VOID"
    if t == "number":
        cond = number_kind(v)
        num = F.try_variant_get(v, "$", "double")
        if schema.get("min") is not None:
            cond = cond & (num >= F.lit(float(schema["min"])))
        if schema.get("max") is not None:
            cond = cond & (num <= F.lit(float(schema["max"])))
        if check_all:
            md = int(schema.get("max_decimals") or 0)
            txt = F.try_variant_get(v, "$", "string")
            cond = cond & ~too_many_decimals(txt, num, F.lit(md))
        return F.coalesce(cond, F.lit(False))
    if t == "string":
        cond = k == "STRING"
        if check_all:
            sval = F.try_variant_get(v, "$", "string")
            if schema.get("enum") is not None:
                cond = cond & sval.isin(*schema["enum"])
            if schema.get("max_length") is not None:
                cond = cond & (F.octet_length(sval) <= int(schema["max_length"]))
        return F.coalesce(cond, F.lit(False))
    if t == "array":
        items = v.try_cast("array<variant>")
        cond = k.startswith("ARRAY")
        n = F.size(items)
        if schema.get("min_items") is not None:
            cond = cond & (n >= int(schema["min_items"]))
        if schema.get("max_items") is not None:
            cond = cond & (n <= int(schema["max_items"]))
        cond = cond & F.forall(items, lambda x: _valid(schema["items"], x, check_all, grammar))
        return F.coalesce(cond, F.lit(False))
    if t == "object":
        m = v.try_cast("map<string,variant>")
        keys = F.map_keys(m)
        props: Mapping[str, Schema] = schema.get("properties") or {}
        cond = k.startswith("OBJECT")
        for req in schema.get("required") or []:
            cond = cond & F.array_contains(keys, F.lit(req))
        allowed = F.array(*[F.lit(p) for p in props]) if props else F.array().cast("array<string>")
        cond = cond & F.forall(keys, lambda key: F.array_contains(allowed, key))
        for p, sub in props.items():
            val = F.try_element_at(m, F.lit(p))
            cond = cond & (val.isNull() | _valid(sub, val, check_all, grammar))
        return F.coalesce(cond, F.lit(False))
    raise ValueError(f"unknown schema type {t!r}")


def is_valid(text: Column | str, schema: Schema, check_all: bool = False) -> Column:
    """Boolean: the JSON text parses (no duplicate keys) and satisfies ``schema``."""
    col = F.col(text) if isinstance(text, str) else text
    v = F.try_parse_json(col)
    return F.coalesce(v.isNotNull() & _valid(schema, v, check_all), F.lit(False))


def strict_regex(schema: Schema) -> str:
    """Anchored Java regex of the texts the schema grammar can produce."""
    return r"\A" + _rx(schema) + r"\z"  # "$" would also match before a last newline


def _rx(schema: Schema) -> str:
    t = schema.get("type")
    if t == "boolean":
        return "(?:true|false)"
    if t == "null":
        return "null"
    if t == "number":
        md = int(schema.get("max_decimals") or 0)
        neg = "-?" if any(schema.get(b) is None or float(schema[b]) < 0 for b in ("min", "max")) else ""
        frac = rf"(?:\.[0-9]{{1,{md}}})?" if md > 0 else ""
        return neg + "[1-9][0-9]*" + frac
    if t == "string":
        if schema.get("enum") is not None:
            return '"(?:' + "|".join(re.escape(e) for e in schema["enum"]) + ')"'
        return '"[^"\\n\\t\\r]*"'
    if t == "array":
        item = _rx(schema["items"])
        lo = max(int(schema.get("min_items") or 1), 1) - 1
        hi = schema.get("max_items")
        rep = f"{{{lo},{int(hi)}}}" if hi is not None else f"{{{lo},}}"
        return r"\[" + item + "(?:," + item + ")" + rep + r"\]"
    if t == "object":
        props = schema.get("properties") or {}
        parts = [f'"{re.escape(k)}":' + _rx(props[k]) for k in schema.get("required") or []]
        return r"\{" + ",".join(parts) + r"\}"
    raise ValueError(f"unknown schema type {t!r}")


def _grammar_schema(schema: Schema) -> Schema:
    """The value checks the grammar enforces besides the shape (arrays may
    hold one item more than max_items)."""
    out = dict(schema)
    if out.get("type") == "array":
        if out.get("max_items") is not None:
            out["max_items"] = int(out["max_items"]) + 1
        out["items"] = _grammar_schema(out["items"])
    if out.get("type") == "object":
        out["properties"] = {k: _grammar_schema(v) for k, v in (out.get("properties") or {}).items()}
    return out


def is_strict(text: Column | str, schema: Schema) -> Column:
    """Boolean: the schema grammar could have produced this JSON text. The grammar counts and
    compares strings as written: no string of it holds a quote, so with its backslashes
    doubled a text parses to the strings as written."""
    col = F.col(text) if isinstance(text, str) else text
    raw = F.try_parse_json(F.replace(col, F.lit("\\"), F.lit("\\\\")))
    return F.coalesce(col.rlike(strict_regex(schema)) & F.try_parse_json(col).isNotNull()
                      & _valid(_grammar_schema(schema), raw, True, grammar=True), F.lit(False))


#: The lexeme classes.
LEXEMES = {
    "true": "true", "false": "false", "null": "null", ":": "colon", ".": "decimal",
    "{": "curly_open", "}": "curly_close", "[": "bracket_open", "]": "bracket_close",
    ",": "comma", "-": "minus", '"': "double_quote",
}


def lexeme(token: Column | str) -> Column:
    """Lexeme class of a token: a literal class, ``digit`` (unsigned integer
    within u64, optional leading +), ``invalid`` (a lone backslash) or
    ``string`` (anything else)."""
    t = F.col(token) if isinstance(token, str) else token
    expr = None
    for lit_, name in LEXEMES.items():
        expr = F.when(t == lit_, F.lit(name)) if expr is None else expr.when(t == lit_, F.lit(name))
    digits = F.regexp_replace(t, r"^\+", "")
    is_digit = t.rlike(r"^\+?[0-9]+$") & (
        digits.try_cast("decimal(20,0)") <= F.lit(str(U64_MAX)).cast("decimal(20,0)"))
    return expr.when(F.coalesce(is_digit, F.lit(False)), F.lit("digit")).when(t == "\\", F.lit("invalid")) \
        .otherwise(F.lit("string"))
