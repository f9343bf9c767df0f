"""The pipeline's stages over documents with every kind of copy, and its guards."""

import random

import pytest

import __spark_entry__ as entry
from quillstone.llm.piece_codec import decode

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    prose = lambda n: " ".join((rng.choice(words) + ("." if rng.random() < 0.15 else "")) for _ in range(n)) + ".\n"
    texts = [prose(rng.randint(80, 200)) for _ in range(30)]
    passage, item = prose(70), prose(30)
    copy = texts[0].split()
    texts += [texts[0], " ".join(copy[:100] + copy[100:]), prose(90) + passage + prose(90), prose(90) + passage + prose(90), prose(60) + item + prose(60), prose(900) + item + prose(900), "too short", "", None, "spam " * 200]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r.n_chars == len(r.text) for r in seen[name].values())
    a, b, c, d, e = (seen[n] for n, _ in corpus_pipeline.STAGES)
    assert set(a) == set(range(36))
    assert set(b) == set(a) - {30, 31}
    assert passage.strip() in c[32].text and passage.strip() not in c[33].text
    assert 34 not in d and item.strip() not in d[35].text and texts[35][:3000] in d[35].text
    assert {i: d[i].text for i in range(30)} == dict(enumerate(texts[:30]))
    assert set(e) == set(d) and all(r.lossless for r in e.values())
    assert {r.doc_id: r.text for r in decode(docs).collect()} == {i: r.text for i, r in d.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.ids for i, r in e.items()}


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)
