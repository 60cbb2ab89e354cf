import json

import pytest

from skein.functions import jsonschema as J
from skein.operators import schemas as SC

NUM = {"type": "number", "min": 0, "max": 10, "max_decimals": 1}
ENUM = {"type": "string", "enum": ["g", "ml"], "max_length": 2}
ARR = {"type": "array", "items": {"type": "boolean"}, "min_items": 3, "max_items": 5}
OBJ = {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}, "b": {"type": "string"}}}

CASES = [
    ({"type": "boolean"}, "true", True, True),
    ({"type": "boolean"}, "1", False, False),
    ({"type": "boolean"}, "null", False, False),
    ({"type": "null"}, "null", True, True),
    (NUM, "10", True, True),
    (NUM, "10.5", False, False),
    (NUM, "-1", False, False),
    (NUM, "3.14159", True, False),
    (ENUM, '"g"', True, True),
    (ENUM, '"cups"', True, False),
    (ARR, "[false,true]", False, False),
    (ARR, "[false,false,true,true]", True, True),
    (ARR, "[true,false,true,false,true,true]", False, False),
    (OBJ, '{"a":1}', True, True),
    (OBJ, '{"b":"x"}', False, False),
    (OBJ, '{"a":1,"c":2}', False, False),
    (OBJ, '{"a":1,"b":2}', False, False),
    ({"type": "boolean"}, "not json", False, False),
]


def test_validity_golden(spark):
    rows = [(i, text) for i, (_, text, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string")
    for i, (schema, text, valid, valid_all) in enumerate(CASES):
        r = df.filter(df.i == i).select(J.is_valid("t", schema).alias("v"),
                                        J.is_valid("t", schema, check_all=True).alias("a")).first()
        assert (r.v, r.a) == (valid, valid_all), (schema, text)


def test_strict_grammar(spark):
    schema = {"type": "object", "required": ["n", "tags"],
              "properties": {"n": {"type": "number", "min": 0, "max": 100},
                             "tags": {"type": "array", "items": {"type": "string", "enum": ["x", "yy"]},
                                      "max_items": 2}}}
    texts = {
        '{"n":5,"tags":["x"]}': True,
        '{"n":5,"tags":["x","yy","x"]}': True,   # max+1 items is producible
        '{"n":5,"tags":["x","yy","x","x"]}': False,
        '{"n":0,"tags":["x"]}': False,           # a leading 0 is never produced
        '{"n": 5,"tags":["x"]}': False,          # no whitespace
        '{"tags":["x"],"n":5}': False,           # keys in required order
        '{"n":500,"tags":["x"]}': False,
        '{"n":5,"tags":[]}': False,
        '{"n":5,"tags":["x"]}\n': False,         # nothing after the end
    }
    df = spark.createDataFrame(list(texts.items()), "t string, e boolean")
    for r in df.select("t", "e", J.is_strict("t", schema).alias("s")).collect():
        assert r.s == r.e, r.t


@pytest.mark.parametrize("tok,cls", [("true", "true"), ("{", "curly_open"), ('"', "double_quote"), ("42", "digit"),
                                     ("+7", "digit"), ("18446744073709551616", "string"), ("\\", "invalid"),
                                     ("abc", "string"), ("", "string")])
def test_lexeme(spark, tok, cls):
    df = spark.createDataFrame([(tok,)], "t string")
    assert df.select(J.lexeme("t").alias("c")).first()["c"] == cls


def test_vocab_mask_and_remainders(spark):
    from skein.operators import jsonmask as JM

    vals = spark.createDataFrame([("g",), ("ml",), ("tbsp",)], "value string")
    states = spark.createDataFrame([("",), ("t",)], "state string")
    rem = JM.enum_remainders(states, vals, max_length=3)
    got = sorted((r.state, r.remainder, r.may_end) for r in rem.collect())
    assert got == [("", "g", False), ("", "ml", False)]
    vocab = spark.createDataFrame([("m",), ("ml",), ("g",), ("x",), ('"',), ("",)], "token string")
    mask = sorted((r.state, r.token) for r in JM.vocab_mask(rem, vocab).collect())
    assert mask == [("", "g"), ("", "m"), ("", "ml")]


@pytest.mark.parametrize("lo,hi,text,want", [
    (5, 50, "25", False),        # the first digit is below min
    (5, 50, "5", True),
    (5, 50, "55", False),
    (5, 90, "52", False),        # 5 is not above min: it does not grow
    (5, 90, "62", True),
    (20, 50, "25", False),
    (0, 50, "50", True),
    (0, 50, "500", False),
    (0, 4, "41", False),         # 4 has reached max
    (None, None, "123456789012345", False),
    (None, None, "42949672951", False),   # 4294967295 does not grow
    (None, None, "42949672941", True),
    (0, None, "-5", True),       # a minus without max, and its digit is not tested
    (0, None, "-55", False),
    (-90, -10, "-55", False),    # -5 is above max: it does not grow
    (-90, 0, "-55", True),
    (-90, 0, "-95", False),
    (0, 50, "-5", False),
    (None, None, "05", False),
])
def test_number_grammar(spark, lo, hi, text, want):
    schema = {"type": "number", "min": lo, "max": hi}
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.is_strict("t", schema).alias("s")).first().s is want


def test_free_string_mask(spark):
    from skein.operators import jsonmask as JM

    vocab = spark.createDataFrame([("ab",), ("é",), ("long",), ('"',), ('a"',), ("",), ("\n",)], "token string")
    run = lambda *a: {r.token for r in JM.any_string_mask(vocab, *a).collect()}
    assert run(2) == {"ab", "é", '"'} and run(0) == {'"'} and run() == {"ab", "é", "long", '"'}


@pytest.mark.parametrize("text,most,want", [
    (r'"\u0041\u0042"', 2, False),   # twelve bytes as written
    (r'"\u0041\u0042"', 12, True),
    (r'"\\"', 2, True),
    (r'"\\"', 1, False),
    (r'"\x"', 9, False),             # not JSON
    ('"é"', 1, False),
    ('"é"', 2, True),
    ('"ab"\n', 2, False),
])
def test_strict_strings_as_written(spark, text, most, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.is_strict("t", {"type": "string", "max_length": most}).alias("s")).first().s is want


NESTED = {"type": "object", "required": ["a/b", "c~"], "properties": {
    "a/b": {"type": "array", "items": OBJ, "max_items": 2}, "c~": {"type": "array", "items": {"type": "array", "items": NUM}},
    "[]": {"type": "null"}}}
NESTED_TEXTS = ['{"a/b":[],"c~":[]}', '{"a/b":[{"a":1}],"c~":[[1.5,2],[]],"[]":null}', '{"a/b":[{"a":1},{"b":"x"}],"c~":[]}',
                '{"a/b":[{"a":1,"z":2}],"c~":[]}', '{"a/b":[],"c~":[[11]]}', '{"a/b":[],"c~":[1]}', '{"a/b":[]}', '{"a/b":[],"c~":[[1.55]]}',
                '{"a/b":{},"c~":[]}', '{"a/b":[],"c~":[],"[]":0}', "[]", '{"a/b":[{"a":1},{"a":1},{"a":1}],"c~":[]}', "null", "", None]


@pytest.mark.parametrize("check_all,most", [(False, 8 << 20), (True, 0)])
def test_schemas_as_rows_equal_literal_schemas(spark, check_all, most):
    """Every text against every schema of a table, as by the schema compiled alone."""
    schemas = [NUM, ENUM, ARR, OBJ, NESTED, {"type": "boolean"}, {"type": "null"}, {"type": "number", "max_decimals": 2}]
    texts = sorted({t for _, t, _, _ in CASES} | {t for t in NESTED_TEXTS if t is not None}) + ["1e1", "1.250", "-0.5", '"ml"', None]
    registry = spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate(schemas)], "schema string, definition string")
    df = spark.createDataFrame([(str(i), t, "v") for i in range(len(schemas)) for t in texts], "schema string, text string, valid string")
    got = SC.valid_by_schema(df, registry, check_all=check_all, broadcast_bytes=most)
    assert got.columns == ["schema", "text", "valid"]
    for i, x in enumerate(schemas):
        part = got.where(got["schema"] == str(i)).select("text", "valid", J.is_valid("text", x, check_all).alias("want")).collect()
        assert len(part) == len(texts) and [(r.text, r.valid) for r in part] == [(r.text, r.want) for r in part], x


def test_schemas_as_rows_edges(spark):
    registry = spark.createDataFrame([("a", '{"type":"null"}')], "schema string, definition string")
    df = spark.createDataFrame([("a", "null"), ("a", "null"), ("b", "null"), (None, "null"), ("a", None)], "schema string, text string")
    got = SC.valid_by_schema(df, registry).collect()
    assert sorted(str(r.valid) for r in got) == ["False", "None", "None", "True", "True"]
    assert SC.valid_by_schema(df.limit(0), registry).count() == 0
    bad = [("a", "{"), ("b", '{"type":"date"}'), ("c", '{"type":"array"}'), ("d", None), ("e", '{"type":"string","max_length":"x"}'),
           ("f", '{"type":"null"}'), ("f", '{"type":"null"}'), (None, '{"type":"null"}'), ("g", "[]")]
    rules = SC.schema_rules(spark.createDataFrame(bad, registry.schema))
    assert {r.name for r in SC.invalid_schemas(rules).collect()} == {"a", "b", "c", "d", "e", "f", None, "g"}
    with pytest.raises(SC.InvalidSchema):
        SC.valid_by_schema(df, registry.union(registry))
