"""Mixed files, nested masks and the versioned store."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.operators.masking import Mask, masked
from quillstone.sources.mixed import MixedFiles, plan, sniff
from quillstone.sources.versioned import SessionStore, VersionedTable, put_if_absent


def load(spark, root, **options):
    spark.dataSource.register(MixedFiles)
    read = spark.read.format("mixed_files").option("path", str(root))
    for k, v in options.items():
        read = read.option(k, v)
    return read.load()


def test_kinds_are_told_by_content():
    assert [sniff(*x) for x in [("a.html", b""), ("b", b"<!DOCTYPE html>"), ("c.txt", b'{"a": 1}\n{"a": 2}'), ("d.json", b'{"a": 1}'), ("e.json", b'{\n"a": 1}'), ("f.md", b"{ no json"), ("g.jsonl", b""), ("h.txt", b"x < y")]] == [
        "html", "html", "jsonl", "json", "json", "text", "jsonl", "text",
    ]


def test_mixed_files_with_broken_ones(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/page.html").write_text("<html><head><title>T</title></head><body><p>one</p></body></html>")
    (tmp_path / "note.md").write_text("# note\nß")
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "one.json").write_text(json.dumps({"name": "N", "content": " body "}))
    (tmp_path / "bad.json").write_text('{"name": ')
    (tmp_path / "deep.json").write_text(json.dumps({"a": {"b": [1, None, "x"]}}))
    (tmp_path / "rows.jsonl").write_text('{"text": "r1"}\n\nbroken\n{"text": "r2", "title": "t2"}\n')
    (tmp_path / "empty").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    for size in (1 << 20, 20):
        rows = {(r.path.rpartition("/")[2], r.at): r for r in load(spark, tmp_path, bytes=size).collect()}
        assert {k[0]: r.kind for k, r in rows.items()} == {"page.html": "html", "note.md": "text", "odd.txt": "text", "one.json": "json", "bad.json": "json", "deep.json": "json", "rows.jsonl": "jsonl", "empty": "text"}
        assert (rows["one.json", 0].title, rows["one.json", 0].text) == ("N", "body") and rows["deep.json", 0].text == "a: b: 1\nx"
        assert (rows["page.html", 0].title, rows["page.html", 0].text) == ("T", "one") and rows["note.md", 0].text == "# note\nß" and rows["empty", 0].text == ""
        assert {k for k, r in rows.items() if r.error} == {("odd.txt", 0), ("bad.json", 0), ("rows.jsonl", 16)}
        assert sorted(r.text for k, r in rows.items() if k[0] == "rows.jsonl" and not r.error) == ["r1", "r2"]


def test_lines_are_cut_anywhere_and_read_once(spark, tmp_path):
    rng = random.Random(1)
    lines = [json.dumps({"text": f"{i} " + "é" * rng.randrange(40)}, ensure_ascii=rng.random() < 0.5) for i in range(400)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    for size in (37, 100, 5000):
        got = load(spark, tmp_path, bytes=size)
        assert sorted(int(r.text.split()[0]) for r in got.collect()) == list(range(400)) and got.filter("error is not null").count() == 0
    assert load(spark, tmp_path, bytes=5000).rdd.getNumPartitions() > 2


def test_small_files_share_a_partition():
    parts = plan([(f"f{i}", 10) for i in range(100)] + [("z", 500)], 100, {"z"})
    assert len(parts) == 15 and sum(e - s for p in parts for _, _, s, e in p.pieces) == 1500 and plan([], 9, set()) == []


def test_masks_reach_any_depth(spark):
    rows = [("s1", {"name": "cave", "notes": "trap", "lead": "ann"}, [{"who": "ann", "said": "a", "tags": ["x", "y"]}, {"who": "bob", "said": "b", "tags": None}], {"k": "v"}, 1), ("s2", None, None, None, None)]
    schema = "id string, scene struct<name:string,notes:string,lead:string>, turns array<struct<who:string,said:string,tags:array<string>>>, facts map<string,string>, n int"
    df = spark.createDataFrame(rows, schema)
    masks = [Mask("scene.notes", ("dm",)), Mask("turns[].said", ("dm",), "who", "..."), Mask("turns[].tags[]", (), "who", "?"), Mask("facts{}", ("dm",), "/scene.lead"), Mask("n", ("dm",))]
    see = lambda role, who: masked(df, masks, F.lit(role), F.lit(who)).orderBy("id").first()
    dm, ann, nobody = see("dm", "zoe"), see("player", "ann"), see(None, None)
    assert masked(df, masks, F.lit("dm"), F.lit("x")).schema.simpleString() == df.schema.simpleString()
    assert dm.scene.notes == "trap" and [t.said for t in dm.turns] == ["a", "b"] and dm.turns[0].tags == ["?", "?"] and dm.facts == {"k": "v"} and dm.n == 1
    assert ann.scene.notes is None and [t.said for t in ann.turns] == ["a", "..."] and ann.turns[0].tags == ["x", "y"] and ann.facts == {"k": "v"} and ann.n is None
    assert nobody.scene.name == "cave" and [t.said for t in nobody.turns] == ["...", "..."] and nobody.facts == {"k": None}
    assert tuple(masked(df, masks, F.lit("dm"), F.lit("x")).filter("id = 's2'").first()) == ("s2", None, None, None, None)
    with pytest.raises(ValueError, match="turns\\[\\].nothing"):
        masked(df, [Mask("turns[].nothing")], F.lit("dm"), F.lit("x"))


def test_a_file_is_put_once(spark, tmp_path):
    assert put_if_absent(spark, f"file:{tmp_path}/x", b"one") and not put_if_absent(spark, f"file:{tmp_path}/x", b"two")
    assert (tmp_path / "x").read_text() == "one" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x"]


def test_two_writers_lose_no_save(spark, tmp_path):
    path, failed = f"file:{tmp_path}/store", []
    schema = "session_id long, expected long, payload string"

    def write(name):
        try:
            store = SessionStore(spark, path)
            for i in range(4):
                outcome = store.save(spark.createDataFrame([(1, None, name), (10 * name.count("b") + i + 2, 0, f"{name}{i}")], schema))
                assert {r.outcome for r in outcome.collect()} == {"saved"}
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed, failed
    rows = {r.session_id: r for r in SessionStore(spark, path).sessions().collect()}
    assert rows[1].revision == 8 and {rows[i].payload for i in range(2, 6)} == {f"a{i}" for i in range(4)} and {rows[i].payload for i in range(12, 16)} == {f"b{i}" for i in range(4)}
    assert SessionStore(spark, path).version() == 8


def test_a_stale_commit_fails_and_old_versions_stay(spark, tmp_path):
    table = VersionedTable(spark, f"file:{tmp_path}/t")
    assert table.read() is None and table.version() == 0
    write = lambda v: lambda now, to: spark.createDataFrame([(v,)], "v int").write.parquet(to)
    table.update(write(1))
    spark.createDataFrame([(9,)], "v int").write.parquet(f"file:{tmp_path}/t/data/late")
    assert not table.commit("data/late", 0)
    assert table.update(write(2))[0] == 2
    assert [table.read(v).first().v for v in (1, 2)] == [1, 2]
