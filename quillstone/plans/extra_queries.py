"""Queries over folds, generated records, semantic duplicates, file scans and the crawl loop."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import hashing as H
from ..functions import text as T
from ..operators import runtime
from ..operators import state as ST
from ..sources import files
from ..streaming import checkpoint_dir


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, r, CASE event_type WHEN 'click' THEN 17 ELSE 20 END AS hp, (event_type = 'purchase')::INT AS gold FROM a WHERE r = 1
UNION ALL SELECT a.user_id, a.r, CASE a.event_type WHEN 'click' THEN greatest(0, f.hp - 3) WHEN 'view' THEN least(20, f.hp + 1) ELSE f.hp END, f.gold + (a.event_type = 'purchase')::INT FROM f JOIN a ON a.user_id = f.user_id AND a.r = f.r + 1)
SELECT user_id, arg_max(hp, r) AS hp, max(gold) AS gold, max(r) AS revision FROM f GROUP BY user_id""")
def session_fold(t: Tables) -> DataFrame:
    """Deterministic fold of each session's actions over its state: damage down to 0, rest up to 20, gold."""

    def act(state: tuple, row: tuple) -> tuple:
        hp, gold, n = state
        kind = row[0]
        hp = max(0, hp - 3) if kind == "click" else min(20, hp + 1) if kind == "view" and n else hp
        return hp, gold + (kind == "purchase"), n + 1

    return ST.fold(t.events, "user_id", "event_id", ["event_type"], (20, 0, 0), act, "user_id long, hp int, gold int, revision long")


@query("SELECT event_id, abs(event_id % 9 - user_id % 9) AS distance, abs(event_id % 9 - user_id % 9) <= 4 AS legal, CASE WHEN abs(event_id % 9 - user_id % 9) <= 4 THEN event_id % 9 ELSE user_id % 9 END AS slot FROM events")
def movement(t: Tables) -> DataFrame:
    to, at = F.col("event_id") % 9, F.col("user_id") % 9
    d = F.abs(to - at)
    return t.events.select("event_id", d.alias("distance"), (d <= 4).alias("legal"), F.when(d <= 4, to).otherwise(at).alias("slot"))


@query("SELECT p_partkey AS id, p_type AS type, replace(p_name, '_', ' ') AS title FROM part WHERE NOT regexp_matches(p_name, '(?i)^(manifest|report)') AND NOT contains(p_type, 'STEEL')")
def meta_load(t: Tables) -> DataFrame:
    """Index metadata as JSON lines: required keys are there, artefact rows are left out, titles are made fit to show."""
    lines = t.part.select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("page_content"))).alias("value"))
    row = lines.select(F.from_json("value", "id long, type string, page_content string", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return row.filter(~F.col("page_content").rlike("(?i)^(manifest|report)") & ~F.contains("type", F.lit("STEEL"))).select("id", "type", F.translate("page_content", "_", " ").alias("title"))


@query("SELECT p_partkey, substr(sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}'), 1, 16) AS stable_id FROM part")
def stable_ids(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return t.part.select("p_partkey", F.substring(F.sha2(body, 256), 1, 16).alias("stable_id"))


@query("WITH s AS (SELECT doc_id, lang, substr(text, 1, 80) AS seed, (('0x' || substr(sha256('g' || doc_id), 1, 2))::INT % 3) AS k FROM documents) SELECT doc_id, 'Scene in ' || lang || ': ' || ['ambush', 'parley', 'chase'][k + 1] AS prompt, 10 + k * 5 AS dc, length(seed) >= 40 AS gate FROM s")
def synthetic_records(t: Tables) -> DataFrame:
    kind = H.stable_choice(F.array(*map(F.lit, ("ambush", "parley", "chase"))), F.concat(F.lit("g"), "doc_id"))
    dc = H.stable_choice(F.array(*map(F.lit, (10, 15, 20))), F.concat(F.lit("g"), "doc_id"))
    return t.documents.select("doc_id", F.concat(F.lit("Scene in "), "lang", F.lit(": "), kind).alias("prompt"), dc.alias("dc"), (F.char_length(F.substring("text", 1, 80)) >= 40).alias("gate"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'A calm scene.' ELSE text END AS answer, turn % 3 = 0 AS fell_back FROM conversations")
def generated_with_fallback(t: Tables) -> DataFrame:
    """A generated text is used if it is valid; else the checked fallback."""
    raw = F.concat("text", F.when(F.col("turn") % 3 == 0, " see http://x.y").otherwise(""))
    ok = ~raw.rlike(T.URL)
    return t.conversations.select("conv_id", "turn", F.when(ok, raw).otherwise("A calm scene.").alias("answer"), (~ok).alias("fell_back"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 <> 0 THEN 'live' END AS mode, CASE WHEN turn % 4 <> 0 THEN (turn % 10) / 10.0::DOUBLE END AS confidence FROM conversations")
def classified_json(t: Tables) -> DataFrame:
    """A classifier's JSON as a typed record; null where it is broken."""
    raw = F.when(F.col("turn") % 4 == 0, F.lit("{oops")).otherwise(F.concat(F.lit('{"mode": "live", "confidence": 0.'), F.col("turn") % 10, F.lit("}")))
    return t.conversations.select("conv_id", "turn", F.from_json(raw, "mode string, confidence double").alias("r")).select("conv_id", "turn", "r.mode", "r.confidence")


def semantic_links(vectors: DataFrame, at_least: float, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, first_link): for each vector, how many others have a cosine of ``at_least``, and the smallest such id.

    Exact: the vectors are cut into k blocks and each pair of blocks is one matrix product in one task, so a task holds
    two blocks whatever the size of the table, no pair leaves a task, and only counts are shuffled.
    """
    k = max(1, -(-vectors.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    mine = vectors.select("vec_id", "embedding", part.alias("p")).filter("vec_id is not null and embedding is not null")
    dealt = mine.select("vec_id", "embedding", "p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("q"))
    dealt = dealt.select("vec_id", "embedding", "p", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, side = table.column("vec_id").to_numpy(), table.column("p").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        left, right = np.flatnonzero(side == key[0].as_py()), np.flatnonzero(side == key[1].as_py())
        hit = x[left] @ x[right].T >= at_least
        same = key[0] == key[1]
        if same:
            np.fill_diagonal(hit, False)
        low = lambda h, other: np.where(h.any(1), np.where(h, ids[other][None, :], np.iinfo(np.int64).max).min(1), -1) if h.size else np.full(len(h), -1)
        out_ids, n, first = [ids[left]], [hit.sum(1)], [low(hit, right)]
        if not same:
            out_ids, n, first = [*out_ids, ids[right]], [*n, hit.sum(0)], [*first, low(hit.T, left)]
        f = np.concatenate(first)
        return pa.table({"vec_id": np.concatenate(out_ids), "n": np.concatenate(n).astype(np.int64), "f": pa.array(f, mask=f < 0)})

    counted = dealt.groupBy("a", "b").applyInArrow(run, "vec_id long, n long, f long")
    return counted.groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("f").alias("first_link"))


def semantic_pairs(vectors: DataFrame, at_least: float, block: int = 2048) -> DataFrame:
    """(x, y), x < y: the pairs of vectors (vec_id unique) with a cosine of ``at_least``; cut into blocks as semantic_links."""
    k = max(1, -(-vectors.count() // block))
    mine = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int").alias("p"))
    dealt = mine.select("vec_id", "embedding", "p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("q"))
    dealt = dealt.select("vec_id", "embedding", "p", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, side = table.column("vec_id").to_numpy(), table.column("p").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        left, right = np.flatnonzero(side == key[0].as_py()), np.flatnonzero(side == key[1].as_py())
        i, j = np.nonzero(x[left] @ x[right].T >= at_least) if len(left) and len(right) else (left[:0], right[:0])
        i, j = ids[left[i]], ids[right[j]]
        once = i < j if key[0] == key[1] else i != j
        return pa.table({"x": np.minimum(i, j)[once], "y": np.maximum(i, j)[once]})

    return dealt.groupBy("a", "b").applyInArrow(run, "x long, y long")


def semantic_greedy(vectors: DataFrame, at_least: float, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vec_id, class_id, kept, n_links): greedy suppression by vec_id, and how many others have a cosine of ``at_least``.

    A row that is kept suppresses the later ones near it; a suppressed row suppresses none. Equal vectors are a class,
    named by its smallest vec_id, and only those are compared: the others of a class are near it and never kept. The
    order is resolved in rounds, each written by ``table``: a row is suppressed by a kept neighbour before it, and kept
    once no neighbour before it is undecided.
    """
    zero = ~F.exists("embedding", lambda v: v != 0)  # near nothing, so each is a class of its own
    key = F.sha2(F.concat_ws(":", F.array_join(F.transform("embedding", lambda v: (v + 0.0).cast("string")), ","), F.when(zero, F.col("vec_id"))), 256)
    rows = table(vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding", key.alias("key")))
    classes = table(rows.groupBy("key").agg(F.min("vec_id").alias("class_id"), F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("n")))
    pairs = table(semantic_pairs(classes.select(F.col("class_id").alias("vec_id"), "embedding"), at_least))
    size = classes.select(F.col("class_id").alias("to"), "n")
    both = pairs.select(F.col("x").alias("class_id"), F.col("y").alias("to")).union(pairs.select("y", "x"))
    links = both.join(size, "to").groupBy("class_id").agg(F.sum("n").alias("near"))

    left, kept = pairs, None  # pairs of which neither row is decided; the kept ones among rows with pairs
    while not left.isEmpty():
        later = left.select(F.col("y").alias("v")).distinct()
        keep = table(left.select(F.col("x").alias("v")).distinct().join(later, "v", "left_anti"))
        kept = keep if kept is None else kept.union(keep)
        gone = left.join(keep, F.col("x") == F.col("v")).select(F.col("y").alias("v")).distinct()
        done = table(keep.union(gone))
        rest = left.join(done, F.col("x") == F.col("v"), "left_anti").join(done, F.col("y") == F.col("v"), "left_anti")
        # rows whose pairs are all gone and that nothing suppressed are kept
        open_ = left.select(F.explode(F.array("x", "y")).alias("v")).distinct().join(done, "v", "left_anti")
        rest = table(rest)
        kept = kept.union(table(open_.join(rest.select(F.explode(F.array("x", "y")).alias("v")).distinct(), "v", "left_anti")))
        left = rest
    paired = pairs.select(F.explode(F.array("x", "y")).alias("class_id")).distinct()
    never = paired if kept is None else paired.join(kept.select(F.col("v").alias("class_id")), "class_id", "left_anti")
    named = classes.join(links, "class_id", "left").join(never.withColumn("gone", F.lit(True)), "class_id", "left")
    others = F.coalesce("near", F.lit(0)) + F.col("n") - 1
    named = named.select("key", "class_id", F.col("gone").isNull().alias("first"), others.cast("long").alias("n_links"))
    return rows.select("vec_id", "key").join(named, "key").select("vec_id", "class_id", (F.col("first") & (F.col("vec_id") == F.col("class_id"))).alias("kept"), "n_links")


_UNIT = "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding)))::DOUBLE[] AS e FROM embeddings) "


@query(_UNIT + "SELECT a.vec_id, count(b.vec_id) AS n_links, min(b.vec_id) AS first_link FROM u a LEFT JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.92 GROUP BY a.vec_id")
def semantic_near_dups(t: Tables) -> DataFrame:
    return semantic_links(t.embeddings.select("vec_id", "embedding"), 0.92)


@query()
def semantic_dedup(t: Tables) -> DataFrame:
    """Vectors kept by greedy suppression at a cosine of 0.92; semantic_near_dups has the links alone."""
    root, steps = checkpoint_dir(t.spark, "semantic"), count()

    def table(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(steps)}"
        df.write.parquet(path)
        return t.spark.read.schema(df.schema).parquet(path)

    return semantic_greedy(t.embeddings.select("vec_id", "embedding"), 0.92, table)


@query()
def fuzzy_lexicon(t: Tables) -> DataFrame:
    """Part names canonicalised against a small word list by sequence similarity of 0.82 or more."""
    lexicon = ["blue bolt", "green anvil", "red gear", "small widget", "cold widget", "steel valve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [next(iter(difflib.get_close_matches(n or "", lexicon, n=1, cutoff=0.82)), None) for n in b.column("p_name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), b.column("p_name"), pa.array(best, pa.string())], ["p_partkey", "p_name", "canonical"])

    return t.part.select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, p_name string, canonical string")


@query("SELECT 'sha256:' || sha256(html) AS key, strlen(html) AS bytes FROM pages GROUP BY html")
def binary_scan(t: Tables) -> DataFrame:
    """Content-addressed page blobs, written and read back."""
    path = checkpoint_dir(t.spark, "blobs")
    files.blobs(t.pages, "html").write.parquet(path)
    return t.spark.read.schema("key string, content binary").parquet(path).select("key", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT doc_id, text FROM documents")
def text_file_scan(t: Tables) -> DataFrame:
    """Documents written as text with one line each (escaped), and scanned back."""
    path = checkpoint_dir(t.spark, "text")
    t.documents.select(F.concat_ws("\t", "doc_id", F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))).write.text(path)
    back = t.spark.read.text(path).select(F.split("value", "\t", 2).alias("v"))
    plain = F.replace(F.replace(F.replace(F.col("v")[1], F.lit("\\\\"), F.lit("\x01")), F.lit("\\n"), F.lit("\n")), F.lit("\x01"), F.lit("\\"))
    return back.select(F.col("v")[0].cast("long").alias("doc_id"), plain.alias("text"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS url, (o_orderkey * 7 + 3) % 1000 AS target FROM orders UNION SELECT o_orderkey, (o_orderkey * 5 + 1) % 1000 FROM orders),
b AS (SELECT 0::BIGINT AS url, 0 AS depth UNION SELECT e.target, b.depth + 1 FROM b JOIN e ON e.url = b.url WHERE b.depth < 4) SELECT url, min(depth)::INT AS depth FROM b GROUP BY url""")
def crawl_frontier(t: Tables) -> DataFrame:
    root = checkpoint_dir(t.spark, "crawl")

    def table(df: DataFrame, i: int) -> DataFrame:
        df.write.parquet(f"{root}/{i}")
        return t.spark.read.schema(df.schema).parquet(f"{root}/{i}")

    k = F.col("o_orderkey")
    edges = t.orders.select(k.alias("url"), F.explode(F.array((k * 7 + 3) % 1000, (k * 5 + 1) % 1000)).alias("target"))
    return runtime.crawl(edges, t.spark.range(1).select(F.col("id").alias("url")), table, 4)
