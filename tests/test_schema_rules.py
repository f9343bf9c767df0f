"""Compiled JSON schemas, keyword by keyword."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import contracts, schema_rules

CASES = [
    ({"type": ["string", "null"]}, [("x", []), (None, []), (1, ["$:type"])]),
    ({"type": "integer", "minimum": 2, "maximum": 4}, [(2, []), (4.0, []), (2.5, ["$:type"]), (1, ["$:minimum"]), (5, ["$:maximum"]), (True, ["$:type"])]),
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, [("ab", []), ("éa", ["$:pattern"]), ("a", ["$:minLength"]), ("abcd", ["$:maxLength"])]),
    ({"enum": [1, "a", None, False]}, [(1, []), ("a", []), (None, []), (False, []), (True, ["$:enum"]), ("1", ["$:enum"])]),
    ({"type": "object", "required": ["a"], "properties": {"a": {"const": True}}, "additionalProperties": False}, [({"a": True}, []), ({}, ["$:required.a"]), ({"a": 1, "b": 2}, ["$.a:const", "$:additionalProperties"]), ([], ["$:type"])]),
    ({"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["k"], "properties": {"k": {"items": {"type": "string"}}}}}, [
        ([{"k": ["x"]}], []), ([], ["$:minItems"]), ([{"k": []}, {"k": []}], ["$:uniqueItems"]), ([{}, {"k": [1]}], ["$[].k[]:type", "$[]:required.k"]), ([{"k": [1]}, {"k": 1}, {"k": 2}], ["$:maxItems", "$[].k[]:type"]),
    ]),
    ({"contains": {"const": "x"}}, [(["y", "x"], []), (["y"], ["$:contains"]), ("y", [])]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}], "not": {"const": "no"}}, [("yes", []), (4, []), (1, ["$:anyOf"]), ("no", ["$:not"])]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"properties": {"c": False}}}, [({"a": 1, "b": 2}, []), ({"a": 1}, ["$:required.b(then)"]), ({"c": 1}, ["$.c:false(else)"]), ({}, [])]),
    ({"allOf": [{"type": "string"}, {"format": "date"}]}, [("2024-02-29", []), ("2023-02-29", ["$:format"]), ("29.2.2024", ["$:format"]), (3, ["$:type"])]),
]


@pytest.mark.parametrize("schema, cases", CASES)
def test_keywords(spark, schema, cases):
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(-1, "{broken"), (-2, None)]
    found = spark.createDataFrame(rows, "i int, doc string").select("i", schema_rules.violations(schema, F.col("doc")).alias("codes"))
    got = {r.i: r.codes for r in found.collect()}
    assert got.pop(-1) == got.pop(-2) == ["$:json"]
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_unknown_keywords_are_refused():
    for schema in ({"minProperties": 1}, {"properties": {"a": {"oneOf": []}}}, {"additionalProperties": {"type": "string"}}, {"format": "email"}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            schema_rules.rules(schema, F.parse_json(F.lit("1")))


def test_contracts_name_each_field_that_is_missing(spark):
    for schema in (contracts.DATASET_MANIFEST, contracts.MODEL_CONTRACT):
        codes = spark.range(1).select(schema_rules.violations(schema, F.lit("{}")).alias("c")).first().c
        assert {f"$:required.{n}" for n in schema["required"]} <= set(codes)
