"""Substring dedup, decontamination and quality rules against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam, rules, substring

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(1, 14))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + rng.choice(".!?"))
        left -= k
    return "".join(s + rng.choice([" ", " ", "\n"]) for s in out)


def test_sentences_lose_nothing():
    rng = random.Random(0)
    for t in ["", "a", "a. b", "x" * 5000, "a " * 5000, " \n\n a.  b!\tc\n", "é. ü? ñ" * 40, *(prose(rng, 90) for _ in range(50))]:
        raw = t.encode()
        pieces = substring.pieces(raw)
        assert b"".join(pieces) == raw


def plain_sentences(text):
    """Ends of sentences in words, by splitting the text and counting."""
    ends, n = [], 0
    for part in re.split(r"(?<=[.!?])(?=[ \t])|(?<=[.!?][\"')\]])(?=[ \t])|[\n\r]", text):
        n += len(part.split())
        if n and (not ends or ends[-1] != n):
            ends.append(n)
    return ends


def plain_substring(rows, least):
    """doc_id -> (text, n_sentences, n_removed, n_words_removed), by spans of sentences and runs of words, one by one."""
    seen, pieces, ends = defaultdict(list), {}, {}
    for doc, text in rows:
        if doc is None or not text:
            continue
        p = pieces[doc] = substring.pieces(text.encode())
        words, ends[doc] = text.split(), plain_sentences(text)
        for a in range(len(words) - least + 1):
            seen["run", tuple(words[a : a + least])].append((doc, a, a + least))
        starts = [0, *ends[doc]]
        for i, a in enumerate(starts[:-1]):
            for j in range(i + substring.SPAN_SENTENCES, len(starts)):
                if starts[j] - a >= least:
                    seen["sentences", tuple(words[a : starts[j]])].append((doc, a, starts[j]))
                    break
        assert len(p) == len(words) or not words
    gone = defaultdict(set)
    for places in seen.values():
        first = min(places)[:2]
        for doc, a, b in places:
            if (doc, a) != first:
                gone[doc].update(range(a, b))
    out = {}
    for d, p in pieces.items():
        whole = sum(set(range(a, b)) <= gone[d] for a, b in zip([0, *ends[d]], ends[d]))
        out[d] = (b"".join(x for k, x in enumerate(p) if k not in gone[d]).rstrip().decode() if gone[d] else None, len(ends[d]), whole, len(gone[d]))
    return out


def test_sentences_end_where_they_should():
    for text, want in [
        ("", []), ("  ", []), ("One.", [1]), ("One two. Three!  Four?", [2, 3, 4]), ('He said "no." Then left.', [3, 5]), ("e.g. this, v1.2 and x", [1, 5]), ("a\n\nb c\r\n", [1, 3]), (" . a", [1, 2]), ("end.) Next", [1, 2]), ("é. ü", [1, 2]),
    ]:
        assert substring.sentence_ends(text.encode()).tolist() == want == plain_sentences(text), text
        assert substring.count_sentences(text.encode()) == len(want), text


def test_substring_dedup_against_plain(spark):
    rng = random.Random(7)
    passages = [prose(rng, rng.choice([20, 55, 80, 120])) for _ in range(6)]
    rows = []
    for i in range(60):
        t = prose(rng, rng.choice([0, 5, 60, 200]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            t += rng.choice(passages)
        rows.append((i * 2, t + prose(rng, rng.choice([0, 30]))))
    rows += [(1, None), (3, ""), (None, passages[1]), (None, passages[1]), (5, rows[9][1]), (7, "x. " * 300)]
    frame = spark.createDataFrame([(*r, 5, "k", -1) for r in rows], "doc_id long, text string, n_chars int, spans string, N_removed int").repartition(3)
    want = plain_substring(rows, substring.SPAN_WORDS)
    got = substring.dedup(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for doc, text in rows:
        if doc is None:
            continue
        new, sentences, whole, n = want.get(doc, (None, 0, 0, 0))
        r = by_id[doc]
        assert (r.text, r.n_sentences, r.n_removed, r.n_words_removed) == (text if new is None else new, sentences, whole, n), doc
        assert r.n_chars == (5 if not n else len(r.text)) and r.spans == "k"
    assert [r.text for r in got if r.doc_id is None] == [passages[1]] * 2
    assert sum(r.n_removed > 0 for r in got) > 10 and by_id[18].text == ""
    assert substring.dedup(frame.limit(0)).count() == 0


def test_planted_passage_is_gone_from_all_but_one(spark):
    rng = random.Random(3)
    passage = prose(rng, 60).strip()
    rows = [(i, f"{prose(rng, 40)}{passage}\n{prose(rng, 40)}") for i in range(9)] + [(50, prose(rng, 300))]
    got = {r.doc_id: r.text for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in got[i] for i in range(9)] == [True] + [False] * 8 and got[50] == rows[-1][1]


def test_repeated_rows_are_not_each_others_repeats(spark):
    t = prose(random.Random(1), 100)
    got = substring.dedup(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect()
    assert [r.text for r in got] == [t, t]


def plain_hits(text, items, window=13):
    words = decontam.words_of(text.encode() if text is not None else None)
    hit, names = set(), set()
    for name, item in items:
        w = decontam.words_of(item.encode() if item is not None else None)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[a : a + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_decontamination_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "PASS_BYTES", block)
    rng = random.Random(2)
    few = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(WORDS if i % 2 else few) for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(20)]
    items += [(100, items[5][1]), (101, items[5][1] + " tail"), (102, None), (103, "?!"), (104, "A-B c")]
    docs = []
    for i in range(60):
        t = [rng.choice(WORDS if i % 3 else few) for _ in range(rng.choice([0, 8, 30, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            w = rng.choice(items)[1] or ""
            w = w.split()[rng.randrange(3) :][: rng.choice([11, 12, 13, 14, 99])]
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() for x in w] if rng.random() < 0.3 else w
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t)))
    docs += [(None, items[5][1]), (0, None), (1, "é" + items[5][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame(items + [(None, docs[3][1])], "item_id long, text string")
    got = decontam.decontaminate(frame, bench).collect()
    want = Counter((d, *plain_hits(t, items)) for d, t in docs)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(r.contaminated for r in got) > 5
    kept = decontam.clean(frame, bench).collect()
    assert len(kept) == sum(not k[-1] * 1 for k in want.elements())
    empty = decontam.decontaminate(frame, bench.limit(0))
    assert empty.agg(F.sum("n_hit")).first()[0] == 0 and decontam.decontaminate(frame.limit(0), bench).count() == 0


def test_cut_removes_the_words_and_nothing_else():
    text = "Start here, (w1 W2; w3) and end."
    assert decontam.cut(text.encode(), [(2, 5)]).decode() == "Start here, () and end."


def test_clashing_and_odd_columns(spark):
    rng = random.Random(5)
    item, twice = prose(rng, 30), prose(rng, 60)
    rows = [(1, f"{prose(rng, 900)} {item}", 7, "x", 1, True), (2, twice + prose(rng, 50), 7, None, 2, None), (3, prose(rng, 60) + twice, 7, "y", 3, False), (4, None, None, "z", 4, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int, `a.b` string, `q``uote` int, row boolean")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    hits = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert hits[1].n_hit >= 30 and hits[4].n_hit == 0 and hits[1]["a.b"] == "x" and hits[1].row is True
    for kept in (decontam.clean(docs, bench), substring.dedup(docs).select(*[f"`{c.replace('`', '``')}`" for c in docs.columns]), rules.keep(docs)):
        assert kept.columns == docs.columns
        assert {r.doc_id: tuple(r)[2:] for r in kept.collect()}.items() <= {r[0]: r[2:] for r in rows}.items()
    assert {r.doc_id: r.text for r in decontam.clean(docs, bench).collect()}[2] == rows[1][1]


def test_two_texts_of_one_doc_id(spark):
    rng = random.Random(8)
    shared, short = prose(rng, 60).strip(), "only a few words here"
    rows = [(2, f"{prose(rng, 40)}{shared} {prose(rng, 40)}"), (2, short), (2, short), (1, f"{shared} {prose(rng, 9)}"), (3, prose(rng, 80)), (3, f"{shared}")]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and Counter(r.text for r in got)[short] == 2
    assert sum(shared in r.text for r in got) == 1 and any(r.doc_id == 1 and shared in r.text for r in got)
    assert any(r.doc_id == 3 and r.text == rows[4][1] for r in got) and any(r.doc_id == 3 and r.text == "" for r in got)


RULE_ROWS = [
    (1, None), (2, ""), (3, " \n\x0b "), (4, "a b c " * 30), (5, " ".join(WORDS[:60])), (6, "l one\nl one\n\nl one\n" + " ".join(WORDS[:80])),
    (7, "\n".join(["same line of text here"] * 30)), (8, " ".join(w + "###" for w in WORDS[:70])), (9, " ".join(WORDS).upper()), (None, "x y z"), (4, "a b c " * 30),
    (10, " ".join(["word"] * 5000)), (11, "é " * 60 + " nbsp x"), (12, "a b c a b c a b"), (13, "a b c"), (14, "a a a a"),
]


def test_rules_match_their_sql(spark):
    frame = spark.createDataFrame([(*r, True) for r in RULE_ROWS], "doc_id long, text string, kept boolean").repartition(2)
    got = rules.judge(frame)
    con = duckdb.connect()
    table = frame.toPandas().astype({"doc_id": "Int64"})
    con.register("documents", table)
    r = con.execute(rules.ORACLE_SQL)
    names = [d[0] for d in r.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(names, row, strict=True)) + ")" for row in r.fetchall())
    kept = {x.doc_id for x in got.filter("kept").collect()}
    assert kept == {5, 6}
    assert sorted(x.doc_id for x in rules.keep(frame).collect()) == [5, 6] and rules.keep(frame).columns == frame.columns
    assert rules.judge(frame.limit(0)).count() == 0


def test_ablation_counts_bits(spark):
    frame = spark.createDataFrame(RULE_ROWS, "doc_id long, text string")
    entries = rules.ledger(frame)
    bits = [r.fail_bits for r in entries.collect()]
    got = {r.rule: (r.n_failed, r.n_alone, r.n_rejected) for r in rules.ablate(entries, rules.STANDARD).collect()}
    held = [b & rules.STANDARD.mask for b in bits]
    want = {n: (sum(b & rules.BIT[n] > 0 for b in held), sum(b == rules.BIT[n] for b in held), sum(b > 0 for b in held)) for n in rules.STANDARD.rules}
    assert got == want
    judged = rules.judge(frame).collect()
    assert {r.sole_bit: r.sole_docs for r in judged if r.sole_bit} == {rules.BIT[n]: w[1] for n, w in want.items() if w[1]}
    assert all((r.sole_docs == 0) == (r.sole_bit == 0) and (not r.kept_strict or r.kept) for r in judged)
    both = {(r.kept_before, r.kept_after): r["count"] for r in rules.compare(entries, rules.BASE, rules.STANDARD).collect()}
    assert (False, True) not in both and sum(both.values()) == len(RULE_ROWS)


def test_rules_on_a_very_long_text(spark):
    rng = random.Random(6)
    words = [rng.choice(WORDS) for _ in range(150_000)]
    seen, windows = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if seen[w] > 1:
            windows.update((i, i + 1, i + 2))
    r = rules.judge(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(windows), sum(map(len, words)))


def test_an_automaton_steps_as_tables_do():
    rng = random.Random(9)
    items = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    auto = decontam.SuffixAutomaton()
    for x in items:
        auto.add(x)
    auto.mark([(str(k), x) for k, x in enumerate(items)])
    for _ in range(2000):
        probe = [rng.randrange(4) for _ in range(rng.randint(1, 8))]
        s = 0
        for w in probe:
            s = auto.go(s, w)
            if not s:
                break
        held = tuple(k for k, x in enumerate(items) if any(x[i : i + len(probe)] == probe for i in range(len(x))))
        assert (auto.items[s] if s else ()) == held
