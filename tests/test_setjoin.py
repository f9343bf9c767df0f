"""The similarity join of sets against all pairs, with small chunks and a large family of near copies."""

import random

import numpy as np

from quillstone.operators import dedup, setjoin
from quillstone.shared import Workspace


def plain(sets, t):
    out = {i: 0 for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) / len(a | b) >= t:
                out[i] += 1
                out[j] += 1
    return {i: n for i, n in out.items() if n}


def counts(spark, sets, t):
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>").repartition(3)
    return {r.id: r.n_links for r in setjoin.link_counts(rows, t, Workspace(spark, "test")).collect()}


def some_sets(rng, n):
    """Families of near copies, sets of common elements, and sets of one's own."""
    out, common = {}, list(range(1000, 1030))
    for i in range(n):
        kind = rng.randrange(4)
        if kind < 2:
            base = set(range(100 * (i % 4), 100 * (i % 4) + rng.choice([10, 40])))
            out[i] = {x if rng.random() > 0.06 else rng.randrange(10**6) for x in base}
        elif kind == 2:
            out[i] = set(rng.sample(common, rng.randint(1, 12)))
        else:
            out[i] = {rng.getrandbits(62) - 2**61 for _ in range(rng.choice([0, 1, 5, 300]))}
    return out


def test_counts_are_those_of_all_pairs(spark, monkeypatch):
    sets = some_sets(random.Random(4), 160)
    for t in (0.8, 0.5):
        want = plain(sets, t)
        assert counts(spark, sets, t) == want and len(want) > 20
    monkeypatch.setattr(setjoin, "SETS_MOST", 5)
    monkeypatch.setattr(setjoin, "ELEMENTS_MOST", 100)
    monkeypatch.setattr(setjoin, "WIDE", 7)
    assert counts(spark, sets, 0.8) == plain(sets, 0.8)


def test_one_family_of_five_thousand_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, *(f"x{int(k)}" for k in rng.integers(0, 10**9, 2))])) for i in range(5000)]
    docs = spark.createDataFrame([*rows, (9000, " ".join(words[:20])), (9001, None), (9002, "")], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in dedup.near_duplicates(docs).collect()}
    assert len(got) == 5003 and {got[i].n_links for i in range(5000)} == {4999} and [got[i].n_links for i in (9000, 9001, 9002)] == [0, 0, 0]
    assert got[9001].class_id == got[9002].class_id == 9001


def test_few_sets_and_none(spark):
    assert counts(spark, {1: {5}, 2: {5}, 3: set(), 4: {6}}, 0.8) == {1: 1, 2: 1}
    empty = spark.createDataFrame([], "id long, shingles array<long>")
    assert setjoin.link_counts(empty, 0.8, Workspace(spark, "test")).count() == 0
