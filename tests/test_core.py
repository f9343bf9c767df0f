"""Column functions, state, retrieval and governance on small fixtures."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import html as HT
from quillstone.functions import text as T
from quillstone.functions import urls as U
from quillstone.operators import dedup, search
from quillstone.operators import governance as G
from quillstone.operators import state as ST
from quillstone.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("C:\\data\\The_Old-Tower.report.md", "The Old Tower report"), ("manifest", None), ("  ", None), ("Goblin Cave", "Goblin Cave"), ("a/b/c.txt", "c")],
)
def test_titles(spark, value, want):
    assert one(spark, value, T.sanitize_title("x")) == want


def test_content_is_sanitized(spark):
    raw = "Read c:\\tmp\\run.log now!!  \r\nthe pipeline output is a::b::c here .\n\n\nnotes.txt"
    assert one(spark, raw, T.sanitize_content("x")) == "Read now!\nthe is here"


@pytest.mark.parametrize(("value", "want"), [("notes.txt", True), ("a/b", True), ("plain words", False), (".txt", False)])
def test_file_names(spark, value, want):
    assert one(spark, value, T.looks_like_filename("x")) is want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("HTTP://Ex.com:80//a//b/?b=2&a=1&utm_source=x&c=#f", "http://ex.com/a/b?a=1&b=2"), ("https://ex.com:443", "https://ex.com/"), ("https://ex.com/?ref=1", "https://ex.com/"), ("//ex.com/x/", "https://ex.com/x"),
    ],
)
def test_urls(spark, value, want):
    assert one(spark, value, U.normalize_url(F.col("x"))) == want


def test_html_text():
    title, full, main, kind = HT.parse("<title>T</title><nav>n</nav><article><p>" + "word " * 60 + "</p></article><script>x</script>")
    assert (title, kind) == ("T", "article") and main.split() == ["word"] * 60 and full.startswith("n\n")
    assert HT.parse(None) == ("", "", "", "body")


CORPUS = [(1, "goblin cave ambush at night"), (2, "armor class decides whether you hit"), (3, "the quiet village by the river"), (4, "goblin goblin goblin lever in the cave")]


def test_search_ranks_and_is_deterministic(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    ask = spark.createDataFrame([(10, "goblin cave ambush"), (11, "armor class hit"), (12, "nothing here matches zz")], "item_id long, text string")
    runs = [sorted(map(tuple, search.bm25(docs.repartition(n), ask, "item_id", 2).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and runs[0][0][:2] == (10, 1)
    best = {r.query_id: r.doc_id for r in runs and search.bm25(docs, ask, "item_id", 1).collect()}
    assert best[10] == 1 and best[11] == 2
    bm, co = search.bm25(docs, ask, "item_id", 2), search.cosine(docs, ask, "item_id", 2)
    fused = search.fuse([("bm25", bm, 1.0), ("vector", co, 0.85)])
    top = search.rerank(fused, docs, ask, "item_id", 1).filter("query_id = 10").first()
    assert top.doc_id == 1 and top.ranks == "bm25:1,vector:1"
    twice = spark.createDataFrame([(1, "goblin goblin")], "item_id long, text string")
    once = spark.createDataFrame([(1, "goblin")], "item_id long, text string")
    score = lambda q: search.bm25(docs, q, "item_id", 1).first().score
    assert score(twice) == pytest.approx(2 * score(once), abs=1e-5)


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:-1], "q"])), (4, " ".join(reversed(base))), (5, ""), (6, None), (7, "w1 w2"), (8, "W1  w2")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == (1, 1) and got[3] == (3, 1) and got[4] == (4, 0) and got[7] == got[8] == (7, 0) and got[5][1] == 0


def test_rules_split_without_loss(spark):
    frame = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, t string")
    good, bad = G.split(frame, [("empty", F.col("t") == ""), ("null", F.col("t").isNull())])
    assert [r.id for r in good.collect()] == [1] and {r.id: r.errors for r in bad.collect()} == {2: ["empty"], 3: ["null"]}


def test_revisions_conflict(spark):
    rows = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("t", 1, 1)], "k string, o long, e int")
    got = sorted((r.k, r.o, r.accepted, r.revision) for r in ST.revisions(rows, "k", "e", "o").collect())
    assert got == [("s", 1, True, 1), ("s", 2, False, 1), ("s", 3, True, 2), ("t", 1, False, 0)]


def test_upsert_keeps_what_was_first(spark):
    state = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, first int")
    delta = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id int, s string, first int")
    assert sorted(map(tuple, ST.upsert(state, delta, "id", ["first"]).collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", 9)]


def test_stage_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.read_stage(spark, root, "raw", "a int").count() == 0
    for n in (1, 2):
        files.write_stage(spark.createDataFrame([(n,)], "a int"), root, "raw")
    assert sorted(r.a for r in files.read_stage(spark, root, "raw", "a int").collect()) == [1, 2]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "n.md").write_bytes(b"# h\xff")
    (tmp_path / "x" / "n.bin").write_bytes(b"%PDF-1")
    assert files.text_files(spark, root + "/x").first().text.startswith("# h")
    raw = spark.read.format("binaryFile").load(root + "/x")
    assert {r.k for r in raw.select(files.file_kind().alias("k")).collect()} == {"md", "pdf"}
    assert files.blobs(raw.union(raw), "content").count() == 2


def test_broken_alias_rows_fail(spark):
    ok = spark.createDataFrame([('{"id": "1", "content": " t ", "source": "s"}',)], "value string")
    assert files.alias_rows(ok).drop("form").first() == ("1", "1", "t", "s")
    for line in ('{"id": "1", "content": "t"}', "{broken"):
        with pytest.raises(Exception, match="no source|[Mm]alformed"):
            files.alias_rows(spark.createDataFrame([(line,)], "value string")).collect()


def test_catalogue_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).count() == 200
