"""Fingerprints and the comparison of neighbours against plain versions."""

import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quillstone.llm import fingerprint as fp

WORDS = {k: [f"{k}{i * 7919 % 1000}" for i in range(300)] for k in ("al", "bé", "日")}


def plain_digest(raw):
    """The digest by counting one triplet after another."""
    h = lambda role, b: xxhash.xxh3_64_intdigest(bytes([role, b])) % fp.BUCKETS
    counts = Counter()
    for i in range(len(raw)):
        for j, k in fp.TRIPLETS:
            if i + k < len(raw):
                counts[h(0, raw[i]) ^ h(j, raw[i + j]) ^ h(8 + k, raw[i + k])] += 1
    ordered = sorted(counts[b] for b in range(fp.BUCKETS))
    q = [ordered[fp.BUCKETS * m // 4 - 1] for m in (1, 2, 3)]
    return [sum(counts[b] > x for x in q) for b in range(fp.BUCKETS)]


def texts(rng, n):
    out = []
    for _ in range(n):
        words = WORDS[rng.choice(list(WORDS))]
        out.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200]))))
    return out


def test_digest_against_plain(monkeypatch):
    rng = random.Random(1)
    samples = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", bytes(range(256)) * 3, b"\0" * 900, *(t.encode() for t in texts(rng, 20))]
    want = [plain_digest(s) for s in samples]
    assert [fp._codes(fp.fingerprint(s)).tolist() for s in samples] == want
    monkeypatch.setattr(fp, "SLICE", 7)  # windows over the borders of slices
    assert [fp._codes(fp.fingerprint(s)).tolist() for s in samples] == want


def test_differences_are_bounded_and_symmetric():
    rng = random.Random(2)
    some = [fp.fingerprint(t.encode()) for t in texts(rng, 40)] + [fp.fingerprint(b"x" * 10**6)]
    for a in some:
        assert fp.likeness_of(a, a) == 1
        for b in some:
            d, most = fp.difference(a, b)
            assert 0 <= d <= most and (d, most) == fp.difference(b, a) and 0 <= fp.likeness_of(a, b) <= 1


def plain_neighbours(rows):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        f, g, after = (fp.fingerprint(x.encode()) for x in (t, edited, u))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f.hex(), g.hex(), fp.likeness_of(f, g), fp.likeness_of(f, after)))
    return out


def frame(spark, rows, parts):
    return spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, n_chars int, fingerprint string").repartition(parts)


def test_neighbours_against_plain(spark):
    rng = random.Random(3)
    rows = [(i * 8 % 301 - 20, t) for i, t in enumerate(texts(rng, 90))] + [(None, "nobody"), (1000, None), (1001, ""), (1002, "é" * 7), (1003, "long " * 200_000), (1004, "abc")]
    for parts in (1, 5):
        got = sorted(map(tuple, fp.compare_neighbours(frame(spark, rows, parts)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == plain_neighbours(rows)
    assert fp.compare_neighbours(frame(spark, rows, 1).limit(0)).count() == 0
    (alone,) = fp.compare_neighbours(frame(spark, [(4, "abcdefgh")], 1)).collect()
    assert (alone.near_next, alone.edited_sha256) == (1, hashlib.sha256(b"abcdefab").hexdigest())
    twice = fp.compare_neighbours(frame(spark, [(4, "abcdefgh")] * 3 + [(4, "x")], 2)).collect()
    assert len(twice) == 4 and sum(r.near_next == 1 for r in twice) == 2


def test_edits_are_nearer_than_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fp.compare_neighbours(docs).collect()
    known = {r.doc_id: r.text for r in docs.collect()}
    assert len({r.fingerprint for r in got}) <= len(set(known.values()))
    long = [r for r in got if r.n_chars > 200 and r.near_next < 1]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.99 * len(long) > 50


def test_operators_on_columns(spark):
    rows = fp.fingerprints(frame(spark, [(1, "one text of some words"), (2, "one text of some words!"), (3, None), (None, "")], 2))
    pairs = rows.alias("a").join(rows.alias("b"), on=None, how="cross").select("a.doc_id", fp.likeness("a.fingerprint", "b.fingerprint").alias("like"))
    got = [r.like for r in pairs.collect()]
    assert len(got) == 16 and max(got) == 1 and min(got) >= 0
    assert rows.select(fp.likeness(rows.fingerprint, F.lit(None).cast("string")).alias("x")).filter("x is not null").count() == 0
