"""Queries that once read or kept a part of their rows only."""

from types import SimpleNamespace

from quillstone.plans import search_queries, state_queries


def test_names_resolve_to_customers_of_any_key(spark):
    nation = spark.createDataFrame([(1, "ALGERIA"), (2, "PERU"), (3, "CHINA")], "n_nationkey long, n_name string")
    customer = spark.createDataFrame([(7, "ALPINE"), (60, "ALGERIA"), (900, "PERU"), (901, "PERU")], "c_custkey long, c_mktsegment string")
    got = state_queries.name_resolution(SimpleNamespace(nation=nation, customer=customer)).collect()
    assert sorted(map(tuple, got)) == [(1, 60), (2, 900)]


def test_hits_down_to_four_times_the_cut_are_reranked(spark):
    docs = [(i, f"goblin cave {i}a {i}b") for i in range(1, 13) if i != 8] + [(8, "goblin the que der")] + [(i, f"else {i}c {i}d {i}e") for i in range(20, 60)]
    tables = SimpleNamespace(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame([(1, "goblin")], "item_id long, text string"))
    assert [r.doc_id for r in search_queries.entity_rerank(tables).orderBy("rank").collect()] == [8, 1]
