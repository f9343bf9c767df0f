"""Findings of the third review on rows moved, memory and time, each by a small case that failed before."""

import numpy as np
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.llm import token_store
from quillstone.operators import grams, search, setjoin
from quillstone.shared import Workspace, hot_join
from quillstone.streaming import stateful


def test_hot_rows_of_a_written_table_pass_one_join_only(spark):
    for key in (F.col("k"), F.col("k").cast("string").cast("binary")):
        left = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40)).alias("k")).select("id", key.alias("k"))
        right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.struct(F.min("id").alias("id"), F.lit(None).cast("long").alias("x")).alias("first")).filter("n > 40")
        hot = F.col("n") > 500
        got = hot_join(left, right, "k", hot, ["first", "n"], written=True)
        want = hot_join(left, right, "k", hot, ["first", "n"]).filter("n is not null")
        assert got.schema.simpleString() == want.schema.simpleString() and got.count()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        assert (count(want), count(got)) == (2, 1)  # all rows, twice; rows of other keys, once
        none = hot_join(left, right, "k", F.lit(False), ["first", "n"], written=True)
        assert sorted(map(repr, none.collect())) == sorted(map(repr, want.collect()))


def test_dense_search_gives_the_best_of_each_task_only(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(400, 8)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400 + i, vectors[i].tolist()) for i in range(30)]
    rows += [(500, None), (501, [1.0] * 7), (502, [None] * 8), (503, [float("nan")] * 8), (None, [1.0] * 8), (7, [0.25] * 8)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for queries in (base.filter("vec_id % 10 = 0"), base.filter("vec_id % 10 = 0 and vec_id < 400"), base.filter("false")):
        want = search.top(search._pairs(base, queries), 4)
        for most in (20_000, 7):  # more queries than a task holds are no error any more
            got = search.inner_product_topk(base, queries, 4, most=most)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in search.inner_product_topk(base, base, 4)._jdf.queryExecution().executedPlan().toString()


def test_stream_totals_keep_null_kinds_and_add_up_in_the_engine(spark, tmp_path):
    rows = [(1, None, 1.5, 0), (1, None, None, 1), (1, "a", None, 2), (2, "a", 2.0, 3)]
    spark.createDataFrame(rows, "user_id long, kind string, value double, event_id long").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, kind string, value double, event_id long").parquet(str(tmp_path / "in"))
    out = stateful.totals(source, "user_id", "kind", "value", ["event_id"])
    with stateful.state_store(spark):
        out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "kind", "n", "total").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, None, 2, 1.5), (1, "a", 1, None), (2, "a", 1, 2.0)]))


def test_stream_changes_make_no_pandas_table_a_key(spark, tmp_path):
    source = spark.readStream.schema("user_id long, kind string, event_id long").parquet(str(tmp_path))
    plan = stateful.changes(source, "user_id", "kind", ["event_id"], "event_id")._jdf.queryExecution().logical().toString()
    assert "InPandas" not in plan and "TransformWithState" in plan


def test_near_copies_are_compared_in_few_of_the_groups_they_share(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 300)
    sets = [(i, np.unique(np.where(rng.random(300) < 0.02, rng.integers(0, 2**60, 300), base)).tolist()) for i in range(40)]
    rows = spark.createDataFrame([*sets, (90, []), (91, [1, 2])], "id long, shingles array<long>")
    work = Workspace(spark, "test")
    _, held = setjoin.prefixes(rows, 0.8, work)
    groups = {}
    for r in held.collect():
        groups.setdefault(r.s, []).append(r)
    seen = sum(len(setjoin._has_partner(g, g, True, s, 0.8)) for s, g in groups.items())
    assert len(groups) > 40 and 40 <= seen < len([r for g in groups.values() for r in g]) / 5
    assert {r.id: r.n_links for r in setjoin.link_counts(rows, 0.8, work).collect()} == {i: 39 for i in range(40)}


def test_no_task_maps_the_pairs_of_its_whole_split(spark, sf, monkeypatch):
    for name in ("bigram_counts", "noise_terms"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        *above, last = plan.split("MapInArrow")
        assert above and "Aggregate" not in last and all("Aggregate" not in x[x.rindex("Exchange") :] for x in above)
    rows = [(1, "a b a b", 0), (2, "b a b a b", 1), (3, "solo", 1), (4, "", 0), (5, None, 1), (6, "a b a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(2)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    for piece, part in ((400_000, 32 << 20), (3, 4)):
        monkeypatch.setattr(grams, "PIECE_WORDS", piece)
        monkeypatch.setattr(grams, "PART_BYTES", part)
        got = grams.pair_counts(docs, words)
        assert sorted(map(tuple, got.collect())) == [("a b", 6), ("b a", 4)]
        assert got.rdd.getNumPartitions() == -(-27 // part)  # of 27 bytes of text
        kinds = grams.term_classes(docs, words, F.col("label"), 2)
        assert sorted(map(tuple, kinds.collect())) == [("bigram", "a b", 1, 1), ("bigram", "b a", 1, 1), ("token", "a", 1, 1), ("token", "b", 1, 1), ("token", "solo", 0, 1)]
        assert grams.pair_counts(docs.filter("false"), words).count() == 0


def test_the_library_is_asked_for_many_cores_at_once():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    enc = token_store.ChunkEncoder(token_store.default_tokenizer())
    plain, enc.tokenizer = enc.tokenizer, Counting(enc.tokenizer)
    texts = [" ".join(f"wo{i}rd{k}" for i in range(500)) + "." for k in range(3)]
    odd = ["a|b | c||", "\uff5cwide \uff5c x\uff5cy", "\u0301mark e\u0301 \u00a0 gap", "<|endoftext|> Don't (x) \x00 \u200b -- ...", "", None, "|"]
    for part, most in ((texts, 40), (odd, 100), (odd + texts, 0)):
        before = enc.tokenizer.asked
        got = [*enc.encode_all([t if t is None else t.encode() for t in part])]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
        assert enc.tokenizer.asked - before <= most  # 1,500 cores
