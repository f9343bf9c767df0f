"""Merge-dropout draws anew for each occurrence of a word, at the given rate."""

import re
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import piece_codec


def test_occurrences_of_a_word_are_segmented_anew(spark):
    words = " ".join(["international"] * 400)
    rows = [(i, words) for i in range(20)] + [(None, words), (None, words + " x")]
    got = piece_codec.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rate=0.1).collect()
    assert all(r.lossless for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id is not None}) == 20 and len({tuple(r.ids) for r in got}) == 22
    bytes_of, seen = piece_codec.codec(piece_codec.default_model()).bytes_of, Counter()
    for r in got:
        word = []
        for i in r.ids:
            if bytes_of[i].startswith(b" "):
                seen[tuple(word)] += 1
                word = []
            word.append(i)
    assert len(seen) > 20


def plain_encode(s, text, rate, key):
    """The rule word for word: of a part's candidates the best, leftmost of equals, is merged or skipped; a skipped pair comes back only when it has changed."""
    codec, gaps, taken, ids = s.codec, piece_codec.gaps_of(rate, key ^ s.key, 9), 0, []
    skip = next(gaps)
    for k, line in enumerate((" " + text).split("\n")):
        ids += [codec.byte_id[10]] * (k > 0)
        for part in (p for chunk in re.findall(r" *[^ ]+| +", line) for p in s._parts(chunk)):
            if not part:
                ids += [codec.byte_id[b] for b in piece_codec.SPACE.encode()]
            pieces, off = list(part), set()
            while found := [(codec.rank[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in codec.rank and i not in off]:  # noqa: B905
                _, i = min(found)
                if taken == skip:
                    off.add(i)
                    skip += 1 + next(gaps)
                else:
                    pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
                    off = {x - (x > i) for x in off if x not in (i - 1, i, i + 1)}
                taken += 1
            for p in pieces:
                ids += [codec.piece_id[p]] if p in codec.piece_id else [codec.byte_id[b] for b in p.encode()]
    return ids


TEXT = "A quick, quick test of internationalisation  and its  words — \n\nquick test\n of  international \u2581x \u00e9t\u00e9 " * 6 + "w" * 90 + " end "


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_segmentations_against_plain(rate):
    codec = piece_codec.codec(piece_codec.default_model())
    s = piece_codec.Segmenter(codec, rate, 12)
    for text in (TEXT, "a", " a", "\n", "a\n", "a b\nc", "internationalisation " * 50):
        for key in (3, 2**63 + 11):
            for _ in range(2):  # from empty and from filled tables
                got = np.frombuffer(s.encode(text, key), "<i4").tolist()
                assert got == plain_encode(s, text, rate, key)
                assert codec.decode(got) == text


def test_a_word_has_many_segmentations():
    codec = piece_codec.codec(piece_codec.default_model())
    words = ["international", "understanding", "quickly", "newspaper", "harbour", "engineers", "Thursday", "mountain"]
    s, seen = piece_codec.Segmenter(codec, 0.1, 1), {w: set() for w in words}
    for key in range(300):
        for w in words:
            seen[w].add(s.encode(w, key))
    assert all(len(v) > 2 for v in seen.values())


def test_skips_have_their_rate_and_kept_ids_change_nothing(monkeypatch):
    codec = piece_codec.codec(piece_codec.default_model())
    gaps = piece_codec.gaps_of(0.1, 5, 50_000)
    drawn = np.array([next(gaps) for _ in range(50_000)])
    assert abs(drawn.mean() - 9) < 0.2 and abs((drawn == 0).mean() - 0.1) < 0.01
    text = TEXT + "w" * 500
    want = piece_codec.Segmenter(codec, 0.3, 7).encode(text, 3)
    for name in ("CACHE_CHARS", "CACHE_MOST", "PARTS_MOST"):
        monkeypatch.setattr(piece_codec, name, 2)
    assert piece_codec.Segmenter(codec, 0.3, 7).encode(text, 3) == want
    assert codec.decode(np.frombuffer(want, "<i4").tolist()) == text
