import base64
import hashlib
import io
import random
import struct

import pytest
import zstandard

from quillstone.llm import warc


def packed(records, samples=()):
    sink = io.BytesIO()
    out = warc.ArchiveWriter(sink, list(samples))
    for r in records:
        out.add(r)
    return sink.getvalue()


def read(data):
    return [warc.read_record(p) for p in warc.frames(io.BytesIO(data))]


def test_round_trip_with_and_without_dictionary(monkeypatch):
    rng = random.Random(1)
    pages = [b"<p>" + b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta"]) + b"%d" % rng.randrange(9999) for _ in range(2500)) for _ in range(40)]
    pages += [b"", b"\r\n\r\n", "é\x00".encode()]
    records = [warc.record(i, f"http://x/{i}\n y" if i % 2 else None, p, "response", warc.digest(p), None) for i, p in enumerate(pages)]
    records.append(warc.record(99, "u", pages[3], "revisit", warc.digest(pages[3]), 3))
    for samples in ((), pages):
        for chunk in (1 << 20, 7):
            monkeypatch.setattr(warc, "CHUNK", chunk)
            data = packed(records, samples)
            magic, size = struct.unpack("<II", data[:8])
            assert magic == warc.DICT_MAGIC and bool(size) == bool(samples)
            got = read(data)
            assert [g["payload_bytes"] for g in got[:-1]] == list(map(len, pages))
            assert got[-1] == {"page_id": 99, "url": "u", "payload_bytes": len(pages[3]), "payload_digest": base64.b32encode(hashlib.sha1(pages[3]).digest()).decode(), "record_type": "revisit", "refers_to": 3}
    assert got[1]["url"] == "http://x/1 y" and got[0]["url"] is None


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/0.9"), (b"WARC-Date", b"WARC-Dote"), (b"hello", b"hallo"), (b"Content-Length: 8", b"Content-Length: 7"), (b"WARC-Type: response", b"WARC-Type: request!"), (b"\r\n\r\nhello", b"\r\n \r\nhell")],
)
def test_broken_records_are_refused(old, new):
    good = warc.record(1, "u", b"hello", "response", warc.digest(b"hello"), None)
    assert old in good or old.startswith(b"Content-Length")
    bad = good.replace(old, new)
    if bad == good:
        bad = good[:-1]
    with pytest.raises(warc.BadArchive):
        read(packed([bad]))


def test_broken_archives_are_refused():
    data = packed([warc.record(1, "u", b"hello", "response", warc.digest(b"hello"), None)])
    for bad in (data[:-3], data[8:], data[:-6] + b"\x00" + data[-5:], zstandard.compress(b"x")):
        with pytest.raises(warc.BadArchive):
            read(bad)
    assert read(packed([])) == []


def test_pages_against_plain(spark):
    rows = [(i, f"u{i}", f"<p>{i % 7}", "z") for i in range(60)] + [(100, None, None, "z"), (101, "u", "", "z"), (None, "u", "q", "z"), (7, "again", "<p>0", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    least = {}
    for p, _, h, _ in rows:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    for min_bytes in (0, 1):
        want = []
        for p, _, h, _ in rows:
            if p is not None:
                first = least[h or ""] if len(h or "") >= min_bytes else p
                want.append((p, len(h or ""), warc.digest((h or "").encode()), "response" if first == p else "revisit", None if first == p else first))
        got = [tuple(r) for r in warc.archive(frame, min_bytes).drop("url").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(frame.limit(0)).count() == 0


def test_rows_of_one_page_id_keep_their_own_type(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (2, "b")]
    got = warc.archive(spark.createDataFrame([(p, None, h) for p, h in rows], "page_id long, url string, html string")).collect()
    want = [(1, "a", None), (2, "a", 1), (2, "b", None), (3, "b", 2), (3, "b", 2), (2, "b", None)]
    assert sorted((r.page_id, r.payload_digest, str(r.refers_to)) for r in got) == sorted((p, warc.digest(h.encode()), str(f)) for p, h, f in want)
    assert all((r.record_type == "response") == (r.refers_to is None) for r in got)


def test_archives_have_a_size(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choice("abcdef <>") for _ in range(3_000_000))) for i in range(7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    listed = warc.write_archives(frame, f"file://{tmp_path}/a", archive_bytes=5_000_000)
    assert listed.agg({"n_records": "sum", "n_records": "max"}).first()[0] <= 3 and listed.count() >= 3
    assert sorted(r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}/a", listed).collect()) == list(range(7))
