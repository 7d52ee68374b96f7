"""Responses read as VARIANT against Python's reader, and the scan for whole objects."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from termloom.operators import compare as A
from termloom.operators import responses as R

TEXTS = [
    '{"c":[1, 2.0, -0, 1e2, 12345678901234567890123, "x", null, true, [], ["a","b"], ["a",1], {"q":[1]}]}',
    '{"c":1,"c":[2]}', '{"c":[2],"c":1}', '{"a":1,"c":[["x","y","z"]],"b":{}}', "[1]", "[1] 2", "1], [2", '1,"x"]', "1", '"a"', "null", "true",
    "", " ", " {}\n", '{"c":[NaN]}', '{"c":[-Infinity]}', "{'c':[]}", "{c:[]}", '{"c":[01]}', '{"c":[1,]}', '{"c":[+1]}', '{"c":["\\x"]}',
    '{"c":["a\nb"]}', '{"c":["\\u00e9\\n\\"]"]}', "[" * 400 + "]" * 400, "[" * 50_000 + "]" * 50_000, '{"c":["' + "long " * 100_000 + '"]}',
    '{"c":[], "": 1, "a b": 2}', "﻿{}", '{"c":[1]}}', '{"c":[1]', '/* x */ {"c":[]}', '{"c":[.5]}', '{"c":[5.]}',
]


def refuse(name):
    raise ValueError(name)


def plain(raw, constant):
    try:
        value = json.loads(raw, parse_constant=constant)
    except (ValueError, RecursionError):
        return False, None
    return True, value


def kind_of(x):
    return {type(None): "null", bool: "bool", int: "int", float: "float", str: "text", list: "list", dict: "object"}[type(x)]


def test_shapes_against_plain_reader(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, raw string")
    shaped = df.select("i", R.response_shape(F.col("raw"), "c").alias("s")).withColumn("errors", R.extraction_errors(F.col("s"), F.array(F.lit("a"))))
    plan = shaped._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r.i: r.s for r in shaped.collect()}
    assert got[len(TEXTS)].json_valid is None and got[len(TEXTS)].json_error is None
    for i, text in enumerate(TEXTS):
        valid, value = plain(text, refuse)
        shape = got[i]
        assert shape.json_valid == valid and (shape.json_error is None) == valid, text[:40]
        if not valid:
            continue
        assert shape.is_object == isinstance(value, dict)
        listed = value.get("c") if isinstance(value, dict) else None
        assert sorted(shape["keys"] or []) == sorted(value if isinstance(value, dict) else [])
        assert shape.is_list == isinstance(listed, list)
        for item, want in zip(shape["items"] or [], listed if isinstance(listed, list) else [], strict=True):
            texts = want if isinstance(want, list) and all(isinstance(x, str) for x in want) else None
            number = float(want) if kind_of(want) in ("int", "float") else None
            assert (item.kind, item.size, item.texts, item.number) == (kind_of(want), len(want) if isinstance(want, list) else None, texts, number)


def test_audit_sizes_against_plain_reader(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, raw string")
    got = {r.i: r.s for r in df.select("i", R.plain_list_size(F.col("raw"), F.lit("c")).alias("s")).collect()}
    for i, text in enumerate(TEXTS):
        valid, value = plain(text, float)
        listed = value.get("c") if isinstance(value, dict) else None
        assert (got[i].json_valid, got[i].size) == (valid, len(listed) if isinstance(listed, list) else None), text[:40]


@pytest.mark.parametrize(
    "raw, want",
    [('{"a": 1}', '{"a": 1}'), ('```json\n[1, 2]\n```', "[1, 2]"), ("Well: {\"a\": {\"b\": 2}} so", '{"a": {"b": 2}}'), ("list [3] of", "[3]"),
     ("[1] and {\"a\": 2}", '{"a": 2}'), ("no json", None), ("} {", None), ("] [", None), ("{x} [4]", "[4]"), (None, None), ("", None)],
)
def test_json_in_prose(spark, raw, want):
    row = R.parse_responses(spark.createDataFrame([(raw,)], "raw_response string")).first()
    assert row.json == want and (row.error is None) == (want is not None)
    assert row.error in (None, "No response" if raw is None else R.NO_JSON)


def plain_objects(text):
    """Objects at the start of the list, read one after another by the JSON decoder."""
    count, at = 0, text.index("[") + 1
    while True:
        while text[at : at + 1] in (" ", "\n", "\r", "\t", ",") and at < len(text):
            at += 1
        if text[at : at + 1] != "{":
            return count
        try:
            at = json.JSONDecoder().raw_decode(text, at)[1]
        except ValueError:
            return count
        count += 1


@pytest.mark.parametrize(
    "inside",
    ['{"a": 1}, {"b": "]}"}, {"c', '{"a": "\\"{"},{"b":[{}]}]}', "", "1, {}", '{"a" 1}, {}', '{} {} x {}', '{"a": "un{closed', '{"a": {"b": [1, 2}', '{}]{}', '{"a": "x\\'],
)
def test_whole_objects_against_decoder(inside):
    text = '{"concepts": [' + inside
    assert A._complete_objects(text, "concepts") == plain_objects(text)


def test_scan_is_linear():
    started = time.perf_counter()
    assert A._complete_objects('{"concepts": [' + '{"a": [1, "}"]}, ' * 200_000, "concepts") == 200_000
    assert A._complete_objects('{"concepts": [{"a": "' + '\\"{' * 300_000, "concepts") == 0
    assert time.perf_counter() - started < 5
    assert A._complete_objects(None, "concepts") == A._complete_objects("[{}]", "concepts") == 0
