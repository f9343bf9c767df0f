"""Registries, cache, degraded search, the scheduler and the crawl loop."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import runtime as R
from quillstone.plans.extra_queries import semantic_links


def test_registry_and_cache():
    r = R.Registry("backend")
    r.add("a", 1)
    with pytest.raises(ValueError):
        r.add("a", 2)
    with pytest.raises(KeyError):
        r.get("b")
    now = [0.0]
    c = R.QueryCache(10, lambda: now[0])
    c.put("k", 1, "world")
    c.put("j", 2, "rules")
    assert c.get("k") == 1
    c.drop("world")
    assert c.get("k") is None and c.get("j") == 2
    now[0] = 11
    assert c.get("j") is None
    assert R.cache_key({"b": 1, "a": 2}) == R.cache_key({"a": 2, "b": 1})


def test_corpora_and_degraded_search(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    reg = R.CorpusRegistry()
    reg.register("world", "v1", docs)
    reg.register("closed", "v1", docs, allowed=False)
    assert reg.scope() == ["world"]
    for bad in ("closed", "none"):
        with pytest.raises(KeyError):
            reg.scope(bad)
    with pytest.raises(ValueError):
        reg.register("other", "v1", docs.withColumn("corpus", F.lit("x")))

    def down(*_):
        raise OSError("offline")

    found, said = R.search_all({"up": lambda d, q, k: d.limit(k), "down": down}, docs, docs, 1)
    assert list(found) == ["up"] and said["down"] == {"available": False, "message": "offline"}
    with pytest.raises(RuntimeError):
        R.search_all({"down": down}, docs, docs, 1)


def test_scheduler_waits_retries_and_reschedules():
    handlers, ran = R.Registry("job"), []
    handlers.add("ok", lambda j: ran.append(j.name))

    def fail(_):
        raise OSError("no")

    handlers.add("bad", fail)
    jobs = [R.Job("a", "ok", 0, 100), R.Job("b", "ok", 1, 100, ("a",)), R.Job("c", "ok", 1, 100, ("zz",)), R.Job("d", "bad", 2, 100, retries=1), R.Job("e", "ok", 50, 100)]
    assert R.run_due(jobs, handlers, set(), 10) == [("a", "completed"), ("b", "completed"), ("c", "waiting"), ("d", "failed: no")]
    assert ran == ["a", "b"] and [j.next_run for j in jobs] == [110, 110, 1, 70, 50]


def test_crawl_finds_each_page_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "url string, target string")
    got = R.crawl(edges, spark.createDataFrame([("a",), ("a",)], "url string"), lambda df, i: df.cache())
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 1)]


def test_semantic_links_by_blocks(spark):
    rows = [(i, [1.0, i / 10]) for i in range(6)] + [(9, [-1.0, 0.0]), (10, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, semantic_links(frame, 0.99).collect()))
    assert one == sorted(map(tuple, semantic_links(frame, 0.99, 3).collect())) and dict((a, b) for a, b, _ in one)[9] == 0
