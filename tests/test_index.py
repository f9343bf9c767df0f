"""The stored index against ranking without one."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import index as ix
from quillstone.operators import search

WORDS = [f"w{i}" for i in range(60)]


def docs(spark, n, seed, start=0):
    rng = random.Random(seed)
    pick = lambda: WORDS[min(int(rng.expovariate(0.12)), 59)]
    rows = [(start + i, " ".join(pick() for _ in range(rng.choice([0, 3, 30, 120]))), 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int")


def queries(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[20:] if i % 2 else WORDS) for _ in range(rng.randint(1, 6)))) for i in range(30)]
    return spark.createDataFrame([*rows, (100, "w1 w1 w59"), (101, "nowhere"), (102, None), (103, "")], "item_id long, text string")


def rows(frame):
    return sorted(map(tuple, frame.select("query_id", "doc_id", "score", "rank").collect()))


def test_rows_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "SPAN_BITS", 3)
    monkeypatch.setattr(ix, "FIRST_SPANS", 1)
    both = docs(spark, 300, 1).unionByName(docs(spark, 200, 2, 1000)).unionByName(spark.createDataFrame([(5000, None, 1)], "doc_id long, text string, n int"))
    index = ix.TermIndex.build(both.filter("doc_id < 1000").repartition(3), str(tmp_path / "a"))
    assert rows(index.bm25(queries(spark), "item_id", 4)) == rows(search.bm25(both.filter("doc_id < 1000"), queries(spark), "item_id", 4))
    index.add(both.filter("doc_id >= 1000").repartition(2))
    again = ix.TermIndex(spark, str(tmp_path / "a"))
    assert rows(again.bm25(queries(spark), "item_id", 4)) == rows(search.bm25(both, queries(spark), "item_id", 4))
    assert rows(again.cosine(queries(spark), "item_id", 4)) == rows(search.cosine(both, queries(spark), "item_id", 4))
    plan = again.spans(queries(spark), "item_id", k=4)
    read, every = plan.agg(F.sum(F.when(F.col("needed"), F.col("n_blocks"))), F.sum("n_blocks")).first()
    assert 0 < read < every


def test_ids_that_are_there_are_refused_and_leave_the_index_as_it_was(spark, tmp_path):
    index = ix.TermIndex.build(docs(spark, 20, 3), str(tmp_path / "b"))
    before = rows(index.bm25(queries(spark), "item_id"))
    for bad in ([(5, "w1")], [(None, "w1")], [(900, "w1"), (900, "w2")]):
        with pytest.raises(ValueError):
            index.add(spark.createDataFrame(bad, "doc_id long, text string"))
    assert rows(index.bm25(queries(spark), "item_id")) == before and index.sizes()[0] == 20


def test_empty_index(spark, tmp_path):
    index = ix.TermIndex(spark, str(tmp_path / "c"))
    assert rows(index.bm25(queries(spark), "item_id")) == []
    index.add(docs(spark, 3, 1).limit(0))
    assert rows(index.bm25(queries(spark), "item_id")) == [] and index.sizes() == (0, 0.0)
