"""Main text and toxicity: exact parts by brute force, learned parts by held-out accuracy."""

import html as html_lib
import random
import re
import zlib
from itertools import product

import numpy as np
import pandas as pd
import pytest

from quillstone.llm import html_main, toxicity


def test_blocks_of_broken_markup():
    found = html_main.blocks("<p>a<b>b</b> c<p>d &amp; &#x41;<br>e<script>x='</p>'</script><!-- n --><ul><li>f<li>g</ul>tail")
    assert [b.text for b in found] == ["ab c", "d & A e", "f", "g", "tail"]
    assert html_main.blocks(None) == html_main.blocks("") == []
    assert [b.text for b in html_main.blocks("plain <text")] == ["plain"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = html_main.Labeller(rng)
    for p in net.params():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    sizes = np.array([3, 5, 1])
    x, y = rng.normal(0, 1, (9, html_main.DIM)).astype(np.float32), (rng.random(9) < 0.5).astype(np.float32)
    _, grads = net.grads(x, sizes, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = net.grads(x, sizes, y)[0]
        p[at] = old - step
        down = net.grads(x, sizes, y)[0]
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_pages_do_not_change_each_other():
    rng = np.random.default_rng(1)
    net = html_main.Labeller(rng)
    x = [rng.normal(0, 1, (n, html_main.DIM)).astype(np.float32) for n in (4, 1, 7)]
    alone = np.concatenate([net.run(p @ net.w + net.b, np.array([len(p)])) for p in x])
    assert net.run(np.concatenate(x) @ net.w + net.b, np.array([4, 1, 7])) == pytest.approx(alone, abs=1e-4)


def test_held_out_pages(spark, sf):
    net = html_main.labeller()
    right = total = 0
    for x, y in html_main.training_set(80, 4242):
        right, total = right + int(((net.run(x @ net.w + net.b, np.array([len(x)])) > 0) == y).sum()), total + len(y)
    assert right / total > 0.98
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", h, re.S)[1]))).split()) for h in pages.html]
    frame = spark.createDataFrame([*zip(pages.page_id.tolist(), pages.url, pages.html, strict=True), (-1, None, None), (-2, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_main.extract(frame).collect()}
    same = sum(got[i].text == w for i, w in zip(pages.page_id, want, strict=True))
    assert same >= 0.98 * len(want)
    assert got[-1].text == got[-2].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_main.extract(frame.limit(0)).count() == 0


def plain_marginals(field, e):
    n = len(e)
    weight = np.zeros((n, 2))
    for path in product((0, 1), repeat=n):
        s = field.start * path[0] + sum(e[i] for i in range(n) if path[i]) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))
        for i, k in enumerate(path):
            weight[i, k] += np.exp(s)
    return weight[:, 1] / weight.sum(1)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    field = toxicity.Field({}, {}, np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1), rng.normal(0, 1, (2, 2)), 0.4, 0.0, np.zeros(4))
    chains = [rng.normal(0, 2, n) for n in (4, 1, 0, 9, 4)]
    for got, e in zip(toxicity.marginals(field, chains), chains, strict=True):
        assert got == pytest.approx(plain_marginals(field, e) if len(e) else [])


def made_up(n, seed):
    rng = random.Random(seed)
    words, bad = [f"v{i}" for i in range(3000)], ["vile", "nasty", "foul"]
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([30, 90]))]
        y = int(rng.random() < 0.3)
        for _ in range(2 * y):
            t[rng.randrange(len(t))] = rng.choice(bad)
        yield i, " ".join(t), y


def test_toxicity_learns_from_training_rows_alone(spark):
    rows = list(made_up(400, 1))
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(1000, None, "en"), (None, "so vile a thing", "en"), (0, rows[0][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels, with_spans=True).collect()
    by_id = {r.doc_id: r for r in got}
    assert {i for i in by_id if by_id[i].held_out} == held and len(got) == len(rows) + 3
    assert np.mean([by_id[i].predicted == y for i, _, y in rows if i in held]) > 0.95
    assert [[t[s.start : s.end] for s in by_id[i].spans] for i, t, _ in [(None, "so vile a thing", 1)]] == [["vile"]]
    assert by_id[1000].spans == [] and 0 <= by_id[1000].score < 0.3
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, flipped).collect()}
    assert again == {k: r.score for k, r in by_id.items()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(0 <= r.score < 0.3, r.predicted) for r in toxicity.score_documents(docs, labels).collect()] == [(True, 0)] * 2
    clean = spark.createDataFrame([(r.doc_id, 0) for r in docs.collect() if r.doc_id is not None], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, clean).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_toxicity_finds_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(docs, labels, with_spans=True).join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, other = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in other) <= 0.01 * len(other)
    assert sum(bool(r.spans) for r in toxic) >= 0.85 * len(toxic)


def test_near_copies_of_one_label_count_once():
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(900)]
    one = [rng.choice(words) for _ in range(200)]
    near, far = [*one[:199], b"other"], [*one[:5], *(rng.choice(words) for _ in range(195))]
    assert toxicity._distinct([one, near, far, one, [], []], [0, 0, 0, 1, 1, 1]) == [0, 2, 3, 4]


def test_the_sample_is_bounded_by_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x " * 50) for i in range(40)] + [(100, "y " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 100]], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    assert [len(t) for t, _ in toxicity.training_sample(docs, labels)] == [100] * 10
