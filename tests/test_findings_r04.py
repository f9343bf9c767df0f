"""What the fourth review found, each by a small case that failed before."""

import random

import duckdb

from quillstone import catalog
from quillstone.operators import dedup, setjoin


def differences(spark, folder, documents, pages):
    """Rows of mixed_files_read and of its SQL over these tables, as sorted strings."""
    spark.createDataFrame(documents, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, html string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    got = [tuple(r) for r in catalog.queries()["mixed_files_read"](spark, str(folder)).collect()]
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(map(repr, got)), sorted(map(repr, db.execute(catalog.oracle_sql()["mixed_files_read"]).fetchall()))


def test_a_part_file_without_lines_is_no_text(spark, tmp_path):
    got, want = differences(spark, tmp_path, [(3, "a"), (4, "b"), (6, "")], [(1, "<p>a</p>")])  # the first task that writes lines has none
    assert got == want and len(got) == 4


def test_mixed_files_give_every_row_whatever_its_id_and_text(spark, tmp_path):
    texts = ["a", "", " \n", None, "\u00a0b\u2003", '{"text": "c"}\n{"text": "d"}', '{"text": "e"}', "<p>f</p>", " <html>", "\ufeffg", "\x1ch\x1f", "\u00a0i\t", "{", '"j"', "\u2028k\r"]
    rows = [(i, x) for x in texts for i in (3, 3, 4, 4, 5, 5, -3, -2, -1, None)]
    pages = [(i, x) for x in ("<p>a</p>", "", None, "{") for i in (1, 1, -1, None)]
    got, want = differences(spark, tmp_path, rows, pages)
    assert got == want and len(got) == len(rows) + len(pages)


def some_texts(rng, n):
    """Families of near copies with texts of their own words, exact copies and texts shorter than a shingle."""
    families = [[f"f{k}w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 9, 30, 200]))] for k in range(n // 20)]
    out = []
    for i in range(n):
        words = list(rng.choice(families)) if i % 2 else [f"o{i}w{k}" for k in range(rng.choice([1, 7, 300]))]
        for _ in range(rng.randrange(3) if i % 2 else 0):
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        out.append((i, " ".join(words)))
    return [*out, (n, ""), (n + 1, None), (n + 2, "  ")]


def links(texts, t):
    """(doc_id, class_id, n_links) by all pairs."""
    sets = {}
    for i, x in texts:
        w = (x or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    n = {s: sum(len(s & o) / len(s | o) >= t for o in first if o != s and s & o) for s in first}
    return sorted((i, first[s], n[s]) for i, s in sets.items())


def test_only_sets_that_may_have_links_are_moved(spark, monkeypatch):
    texts, seen, join = some_texts(random.Random(2), 400), [], setjoin.link_counts
    monkeypatch.setattr(setjoin, "link_counts", lambda sets, *more: seen.append({r.id for r in sets.select("id").collect()}) or join(sets, *more))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for t, most in ((0.8, 10**6), (0.5, 0)):
        monkeypatch.setattr(dedup, "IDS_MOST", most, raising=False)  # 0: joined by a shuffle
        got = sorted(map(tuple, dedup.near_duplicates(docs, t).collect()))
        assert got == links(texts, t) and sum(n > 0 for _, _, n in got) > 50
        assert {c for _, c, n in got if n} <= seen[-1]
    lonely = {i for i, x in texts if i % 2 == 0 and len((x or "").split()) == 300}
    assert len(lonely) > 50 and not lonely & seen[0]


def test_few_elements_and_none_add_up(spark, monkeypatch):
    rows = [(1, []), (2, []), (3, [5, 6, 7]), (3, [5, 6, 7]), (4, [7, 8]), (5, []), (6, [9])]
    parts = spark.createDataFrame(rows, "i long, part array<long>")
    for most, n in ((10**6, 1), (1, 1), (2, 3)):
        monkeypatch.setattr(dedup, "ELEMENTS_MOST", most)
        assert {r.i: r.alone for r in dedup.alone_counts(parts.repartition(n, "i"), 9).collect()} == {3: 2, 4: 1, 6: 1}
    assert dedup.alone_counts(parts.filter("size(part) = 0"), 0).count() == 0
    assert [tuple(r) for r in dedup.near_duplicates(spark.createDataFrame([(5, ""), (6, None)], "doc_id long, text string")).collect()] == [(5, 5, 0), (6, 5, 0)]
