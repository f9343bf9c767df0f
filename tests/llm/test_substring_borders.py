"""Repeats that begin and end inside sentences, and runs of one word, against a plain word-by-word version."""

import random
from collections import defaultdict

from quillstone.llm import substring


def plain(rows, least):
    """doc_id -> text without the words of later places of a run of ``least`` words."""
    seen = defaultdict(list)
    for doc, text in rows:
        words = text.split()
        for i in range(len(words) - least + 1):
            seen[tuple(words[i : i + least])].append((doc, i))
    gone = defaultdict(set)
    for places in seen.values():
        for doc, i in sorted(places)[1:]:
            gone[doc].update(range(i, i + least))
    return {d: " ".join(w for i, w in enumerate(t.split()) if i not in gone[d]) for d, t in rows}


def test_repeats_go_up_to_their_borders(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}" + rng.choice(["", "", "", "", "", "."])
    prose = lambda n: [word() for _ in range(n)]
    passages, rows = [prose(n) for n in (51, 55, 60, 80, 120)], []
    for i in range(80):
        text, p = prose(rng.randint(30, 200)), rng.choice(passages)
        a = rng.randrange(len(p) - 30)
        at = rng.randrange(len(text))
        rows.append((i, " ".join(text[:at] + rng.choice([p, p[a:], p[: a + 26]]) + text[at:])))
    rows += [(100 + i, " ".join(prose(9) + ["ha"] * rng.choice([24, 25, 26, 70]) + prose(9))) for i in range(12)]
    rows += [(200 + i, " ".join(rng.choice("ab") for _ in range(300))) for i in range(3)] + [(210, "x y z " * 60), (211, "y z x " * 60)]
    got = {r.doc_id: r.text for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {d: " ".join(t.split()) for d, t in got.items()} == plain(rows, substring.SPAN_WORDS)
