"""Queries over sections and chunks, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import streaming as SS
from ..catalog import Tables, query
from ..functions import chunking as C
from ..functions import text as T
from ..sources import files


def _structured(t: Tables) -> DataFrame:
    """Documents with a heading before every fifth line and a blank line before every third."""
    line = lambda s, i: F.when(i % 5 == 0, F.concat(F.lit("Chapter "), F.element_at(F.array(*map(F.lit, "ABCDE")), (i / 5 % 5).cast("int") + 1), F.lit("\n"), s)).when(i % 3 == 0, F.concat(F.lit("\n"), s)).otherwise(s)
    return t.documents.select("doc_id", F.array_join(F.transform(T.lines("text"), line), "\n").alias("text"))


@query()
def sections(t: Tables) -> DataFrame:
    return C.explode(_structured(t), C.segments)


@query()
def chunks_packed(t: Tables) -> DataFrame:
    return C.explode(_structured(t), C.rules_chunks(600, 120))


@query()
def chunk_records(t: Tables) -> DataFrame:
    """Chunk rows with ids, counts and hashes."""
    rows = C.explode(_structured(t), C.rules_chunks(900))
    ids = F.concat(F.lit("chunk:"), "doc_id", F.lit(":"), F.lpad(F.col("index").cast("string"), 4, "0"))
    return rows.withColumns({"chunk_id": ids, "char_count": F.char_length("text"), "content_hash": F.sha2("text", 256), "n_chunks": F.count("*").over(Window.partitionBy("doc_id"))})


@query()
def plain_chunks(t: Tables) -> DataFrame:
    return C.explode(_structured(t), lambda x: [("", c) for c in C.plain_chunks(x)])


@query()
def boundary_window(t: Tables) -> DataFrame:
    return C.explode(t.documents, lambda x: [("", c) for c in C.boundary_windows(x, 500, 50)])


@query()
def story_chunks(t: Tables) -> DataFrame:
    return C.explode(_structured(t), lambda x: [("", c) for c in C.story_chunks([b for _, b in C.segments(x)])])


@query()
def nfkc_text(t: Tables) -> DataFrame:
    return C.map_text(t.documents.withColumn("text", F.concat(F.lit("ﬁne “x” – "), "text")), C.nfkc, "doc_id")


@query()
def json_flatten(t: Tables) -> DataFrame:
    return C.map_text(t.events.withColumn("props", F.to_json(F.struct("event_type", F.struct("props", "value").alias("inner")))), C.json_text, "event_id", "props")


@query("WITH d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, greatest(1, CAST(ceil((length(t) - 120) / 1080.0) AS BIGINT)))) AS i FROM d) SELECT doc_id, i::INT AS i, substr(t, 1 + i * 1080, 1200) AS chunk FROM w")
def chunks_fixed_window(t: Tables) -> DataFrame:
    x = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    n = F.greatest(F.lit(1), F.ceil((F.char_length("x") - 120) / 1080.0))
    rows = t.documents.select("doc_id", x.alias("x")).select("doc_id", "x", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    return rows.select("doc_id", "i", F.expr("substring(x, 1 + i * 1080, 1200)").alias("chunk"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 200.0) AS BIGINT))) AS i FROM w) SELECT doc_id, i::INT AS i, array_to_string(w[i * 200 + 1:i * 200 + 200], ' ') AS chunk FROM i")
def chunks_by_words(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    parts = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), (F.ceil(F.size("w") / 200.0) - 1).cast("int"))).alias("i"))
    return parts.select("doc_id", "i", F.array_join(F.slice("w", F.col("i") * 200 + 1, F.lit(200)), " ").alias("chunk"))


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '== part ==' || chr(10)), chr(10) || '== part ==' || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS i, unnest(s) AS section FROM s")
def sections_split(t: Tables) -> DataFrame:
    marked = F.replace("text", F.lit("\n"), F.lit("\n== part ==\n"))
    parts = F.filter(F.transform(F.split(marked, "\n== part ==\n"), lambda x: F.trim(x)), lambda x: x != "")
    return t.documents.select("doc_id", F.posexplode(parts).alias("i", "section"))


_SNAP = "SELECT 'conv:' || conv_id AS doc_id, 'Talk ' || conv_id AS title, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id UNION ALL SELECT 'turn:' || conv_id || ':' || turn, initcap_(role), text FROM conversations WHERE role <> 'system'".replace("initcap_(role)", "upper(substr(role, 1, 1)) || substr(role, 2)")


def _snapshot(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # one conversation's turns
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("text"))
    talks = whole.select(F.concat(F.lit("conv:"), "conv_id").alias("doc_id"), F.concat(F.lit("Talk "), "conv_id").alias("title"), "text")
    single = t.conversations.filter("role <> 'system'").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("doc_id"), F.initcap("role").alias("title"), "text")
    return talks.unionByName(single)


@query(_SNAP)
def snapshot_docs(t: Tables) -> DataFrame:
    return _snapshot(t)


@query(f"WITH s AS ({_SNAP}) SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT AS hits FROM s WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 10")
def state_search(t: Tables) -> DataFrame:
    from ..operators.search import keyword_rank

    return keyword_rank(_snapshot(t), ["the"], 10)


@query("SELECT doc_id::VARCHAR AS doc_id, 'T' || doc_id AS title, text, source, doc_id % 3 AS form FROM documents WHERE doc_id % 3 < 2 OR text <> ''")
def corpus_alias_rows(t: Tables) -> DataFrame:
    """Rows written as JSON lines with varying key names, read through their aliases."""
    k = F.col("doc_id") % 3
    ident, title = F.col("doc_id").cast("string"), F.concat(F.lit("T"), "doc_id")
    line = (
        F.when(k == 0, F.to_json(F.struct(ident.alias("id"), title.alias("name"), F.col("text").alias("page_content"), F.col("source"), k.alias("form"))))
        .when(k == 1, F.to_json(F.struct(ident.alias("slug"), title.alias("title"), F.col("text").alias("desc"), F.col("source").alias("source_file"), k.alias("form"))))
        .otherwise(F.to_json(F.struct(ident.alias("doc_id"), title.alias("heading"), F.col("text"), F.col("source"), k.alias("form"))))
    )
    return files.alias_rows(t.documents.select(line.alias("value"))).select("doc_id", "title", "text", "source", "form")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_documents(t: Tables) -> DataFrame:
    lines = t.conversations.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    return lines.select(F.from_json("value", "conv_id long, turn long, role string, text string", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = SS.checkpoint_dir(t.spark, "jsonl")
    files.write_stage(t.documents.select("doc_id", "lang", "source", "n_chars"), path, "raw")
    return files.read_stage(t.spark, path, "raw", "doc_id long, lang string, source string, n_chars long")


def _stream(t: Tables, f: SS.Transform, mode: str, name: str) -> DataFrame:
    return SS.run_once(f(SS.event_stream(t.spark, t.folder)), mode, SS.checkpoint_dir(t.spark, name))


@query("WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL) SELECT epoch(s)::BIGINT AS start, event_type, n, round(total, 4) AS total FROM w, m WHERE s + INTERVAL 1 HOUR <= wm")
def events_tumbling(t: Tables) -> DataFrame:
    return _stream(t, SS.tumbling, "append", "tumbling").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum((gap IS NULL OR gap > INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, epoch_us(a) // 1000 AS start, n FROM g WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def events_session(t: Tables) -> DataFrame:
    return _stream(t, SS.sessions, "append", "sessions").select("user_id", F.unix_millis("start").alias("start"), "n")


@query("SELECT event_id, user_id FROM events")
def events_dedup(t: Tables) -> DataFrame:
    return _stream(t, lambda e: SS.dedup(e.union(e)).select("event_id", "user_id"), "append", "dedup")


@query("SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def events_state(t: Tables) -> DataFrame:
    rows = _stream(t, SS.running_state, "update", "state")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last_type", "n").alias("last_type"))
