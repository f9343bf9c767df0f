"""What the third review found, each by a small case that failed before."""

import json
import random
import time

from pyspark.sql import functions as F

from quillstone.functions import scoring
from quillstone.operators import index, schema_rules, search
from quillstone.sources.mixed import MixedFiles


def test_numbers_within_words_count_for_the_rule_score(spark):
    rows = [(0, "a1b " * 25), (1, "a1b " * 24), (2, "a1b " * 25 + "dc")]
    got = spark.createDataFrame(rows, "i int, x string").select("i", scoring.rule_score(F.col("x")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [-0.5, 0.0, 1.0]


def test_a_value_is_typed_once_at_each_place_of_a_schema(spark):
    schema = {"type": ["object", "null"], "required": ["a"], "properties": {"a": {"type": ["string", "integer"], "enum": ["x", 1, None], "minLength": 1, "minimum": 0}}}
    plan = spark.range(1).select(schema_rules.violations(schema, F.col("id").cast("string")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant(") == 2


def test_lines_are_told_by_a_first_line_of_any_length(spark, tmp_path):
    texts = ["x" * 20000, "y", "z" * 9000]
    (tmp_path / "part-0.txt").write_text("".join(json.dumps({"text": x}) + "\n" for x in texts))
    (tmp_path / "one.json").write_text(json.dumps({"text": "w" * 9000}) + "\n\n")
    spark.dataSource.register(MixedFiles)
    for most in (1 << 20, 25000, 500):
        rows = spark.read.format("mixed_files").option("path", str(tmp_path)).option("bytes", str(most)).load().collect()
        assert sorted((r.kind, r.text) for r in rows) == [("json", "w" * 9000), *[("jsonl", x) for x in texts]]
        assert all(r.error is None for r in rows)


def test_repetition_takes_time_in_proportion_to_a_text(spark):
    text = "".join(random.Random(3).choices("abcé𝄞", k=400_000))
    rows = spark.createDataFrame([(0, text), (1, "aaaaaa"), (2, "abc"), (3, ""), (4, None)], "i int, x string").select("i", scoring.repetition(F.col("x")).alias("r"))
    began = time.monotonic()
    got = {r.i: r.r for r in rows.collect()}
    assert time.monotonic() - began < 20
    n = len(text) - 4
    assert got == {0: (n - len({text[i : i + 5] for i in range(n)})) / n, 1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_what_a_place_violates_has_a_type_that_needs_no_look_below(spark):
    schema = {"properties": {"a": {"items": {"anyOf": [{"const": "x"}, {"if": {"type": "integer"}, "then": {"minimum": 2}}]}}}}
    field = spark.range(1).select(schema_rules.rules(schema, F.parse_json(F.lit('{"a": ["x", 1]}'))).alias("c")).schema["c"]
    assert (field.dataType.simpleString(), field.nullable) == ("string", False)
    docs = spark.createDataFrame([(0, '{"a": ["x", 1]}'), (1, '{"a": [2, "x"]}'), (2, '{"a": [1, 1]}')], "i int, d string")
    got = docs.select("i", schema_rules.violations(schema, F.col("d")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {0: ["$.a[]:anyOf"], 1: [], 2: ["$.a[]:anyOf"]}


def test_no_row_is_made_for_each_query_and_document(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.choice([0, 2, 9, 40])))) for i in range(600)] + [(900, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a c"), (2, "b h"), (3, "zz"), (4, None)], "item_id long, text string")
    found = {}
    for most in (search.TERMS_MOST, 0):
        monkeypatch.setattr(search, "TERMS_MOST", most)
        frames = [search.bm25(docs, queries, "item_id", 4), search.cosine(docs, queries, "item_id", 4)]
        found[most] = [sorted(map(tuple, f.collect())) for f in frames]
        if most:
            assert all("Aggregate" not in f._jdf.queryExecution().optimizedPlan().toString() for f in frames)
    few, many = found.values()
    assert few == many and len(few[0]) == 8


def test_indexed_search_moves_blocks_not_scores(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcdefgh", k=i % 30))) for i in range(600)] + [(900, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a c"), (2, "b h"), (3, "zz")], "item_id long, text string")
    made = index.TermIndex.build(docs, str(tmp_path / "terms"))
    for found, want in ((made.bm25(queries, "item_id", 4), search.bm25(docs, queries, "item_id", 4)), (made.cosine(queries, "item_id", 4), search.cosine(docs, queries, "item_id", 4))):
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_one_id_add_up(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a d d")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a")], "item_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in search.bm25(docs, queries, "item_id", 4).orderBy("rank").collect()] == [(1, 1), (2, 2)]
