import random
from collections import Counter

import numpy as np
import xxhash

from quillstone.llm import simhash
from quillstone.llm.common import Workspace
from quillstone.llm.components import components


def plain_print(text):
    w = (text or "").lower().encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, near):
    """items: {node: value}; near(a, b). Smallest node reachable."""
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprint_matches_plain():
    texts = ["", None, "One", "a b c", "A b C d", "x y z w v u " * 9, "é ü ñ \t q\x0b r s", "w " * 70000]
    for t in texts[:-1]:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_print(t)
    assert simhash.fingerprint(texts[-1].encode()) == plain_print("w w w w")


def test_trie_links_span_the_components():
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    a, b = simhash.trie_links(np.zeros(len(prints), np.int64), prints)
    want = plain_components({int(p): int(p) for p in prints}, lambda x, y: (x ^ y).bit_count() <= 4)
    got = {int(p): int(p) for p in prints} | {int(prints[i]): int(prints[j]) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_dense_cluster_is_linked_without_all_pairs():
    rng = np.random.default_rng(1)
    prints = np.unique(np.array([0x0123456789ABCDEF], np.uint64) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20000, 3)).astype(np.uint64), axis=1))
    a, b = simhash.trie_links(np.zeros(len(prints), np.int64), prints)
    assert len(a) == len(prints) - 1 and set(b) == {0}


def test_masks_lose_no_link():
    rng = random.Random(2)
    for n in (10, 10**6, 10**9):
        masks = simhash.block_masks(n)
        for _ in range(300):
            x, y = rng.getrandbits(64), 0
            for _ in range(4):
                y |= 1 << rng.randrange(64)
            assert any((x ^ (x ^ y)) & m == 0 for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def test_whole_operator_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(40):
        t = [rng.choice(words) for _ in range(rng.choice([0, 2, 300]))]
        for _ in range(rng.choice([1, 1, 4])):
            v = list(t)
            if v:
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(v), "x"))
    rows += [(1, None, "x"), (2, "", "x"), (4, rows[5][1], "x"), rows[5]]
    for most in (20_000, 6):
        monkeypatch.setattr(simhash, "GROUP_MOST", most)
        got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()
        want = plain_components({r[0]: plain_print(r[1]) for r in rows}, lambda x, y: (x ^ y).bit_count() <= 4)
        assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == Counter((r[0], plain_print(r[1]), want[r[0]]) for r in rows)


def test_near_dedup_keeps_one_of_each(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (9, "q r s t u v"), (None, "a b c d e"), (None, None)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == ["1", "9", "None", "None"]
    empty = simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and simhash.simhash_components(empty).count() == 0


def test_null_ids_take_the_group_id(spark):
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "z y x w v")], "doc_id long, text string")).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 5), (5, 5), (None, None)], key=str)


def test_near_dedup_tells_texts_of_one_doc_id_apart(spark):
    one, two, three = "a b c d e f g h", "q r s t u v w x", "m n o p l k j i"
    rows = [(1, one, 1), (2, one, 2), (2, two, 3), (3, two, 4), (5, three, 5), (5, three, 5), (5, one, 6)]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"))
    assert got.columns == ["doc_id", "text", "a.b"]
    assert sorted(map(tuple, got.collect())) == [(1, one, 1), (2, two, 3), (5, three, 5)]
