"""Spelling variants against all pairs of words, and against SQL on the given tables."""

import random
import re
import zlib
from collections import Counter

import duckdb

from quillstone.llm import spelling
from quillstone.llm.common import Workspace


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)


def got(spark, rows):
    return sorted(map(tuple, spelling.variants(frame(spark, rows)).collect()), key=repr)


def variants_of(rng, w):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéÿ") + w[k:], w[:k] + rng.choice("abcéÿ") + w[k + 1 :], w.upper(), w])


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 8, 9, 15]))) for _ in range(40)] + ["aaaaaaaa", "ababababa", "bananas"]
    rows = []
    for d in range(120):
        words = []
        for _ in range(200):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            words.append(variants_of(rng, variants_of(rng, w)) if rng.random() < 0.1 else variants_of(rng, w) if rng.random() < 0.3 else w)
        rows.append((d, rng.choice([" ", "-", "1", "\n", "×÷ "]).join(words)))
    rows += [(None, "Bananas bananas BANANAS"), (7, None), (8, ""), (9, "x" * 300_000), (9, "x" * 300_000), (3, rows[3][1]), (3, rows[3][1])]
    want = plain(rows)
    assert got(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 50 and max(r[4] for r in want) > 5


def test_chains_lead_to_the_last_form(spark):
    text = " ".join(" ".join([w] * n) for w, n in (("abcdefgh", 2), ("abcdefgx", 20), ("abcdefyx", 200), ("abcdezyx", 2000), ("abcduzyx", 20000)))
    rows = [(d, text) for d in (1, 2, 4)]
    want = plain(rows)
    assert got(spark, rows) == want and {"abcduzyx"} <= {r[2] for r in want}
    links = spark.createDataFrame([(f"{k:02}", f"{k + 1:02}") for k in range(13)], "id string, form string")
    roots = spelling.lead_to_roots(links, 2 * 10**13, Workspace(spark, "test")).collect()
    assert {r.root for r in roots} == {"13"} and len(roots) == 13


def test_keys_are_equal_where_words_are():
    words = ["aab", "abb", "aabb", "b", "abab", "ab*b", "ééz", "x" * 50]
    at, kinds, keys = spelling.word_keys(words, 0)
    named = {}
    for w, kind, key in zip(at, kinds, keys.T.tolist(), strict=True):
        named.setdefault((words[w], int(kind)), []).append(tuple(key))
    whole = {w: named[w, spelling.WORD][0] for w in words}
    assert len(set(whole.values())) == len(words)
    assert sorted(named["aabb", spelling.SHORTER]) == sorted([whole["abb"], whole["aab"]])
    assert set(named["aab", spelling.GAP]) & set(named["abb", spelling.GAP]) and whole["ab*b"] in named["abab", spelling.GAP]
    assert len(named["x" * 50, spelling.SHORTER]) == 1 and len(set(named["x" * 50, spelling.GAP])) == 50


def test_ties_go_by_code_points(spark):
    rows = [(None, " ".join(["aaaaaaa"] * 2 + ["aaaaaaz"] * 30 + ["aaaaaaé"] * 30 + ["aaaaaab"] * 30))]
    assert got(spark, rows) == plain(rows)
    assert {r[1] for r in got(spark, rows) if r[0] == "aaaaaaa"} == {"aaaaaab"}


def test_no_words(spark):
    assert got(spark, [(1, "short ones only"), (2, None)]) == [] and spelling.variants(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_small_tables_of_words_change_nothing(spark, monkeypatch):
    rows = [(i, f"variant{chr(97 + i % 5)} another spelling{i % 3} variants") for i in range(60)]
    want = plain(rows)
    monkeypatch.setattr(spelling, "KEEP_WORDS", 2)
    assert got(spark, rows) == want


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(spelling.ORACLE_SQL)
    names = [c[0] for c in want.description]
    found = spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
