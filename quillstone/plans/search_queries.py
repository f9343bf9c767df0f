"""Queries over retrieval and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import text as T
from ..operators import dedup, grams, search

_TOK = T.TOKEN.replace("'", "''")
_BASE = f"""WITH d AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents),
q AS (SELECT item_id AS query_id, text, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM p GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0 QUALIFY rank <= 5),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(qtf * qtf) + count(*) - 1) AS qnorm FROM qt GROUP BY query_id),
cs AS (SELECT query_id, doc_id, round(sum(tf * qtf) / (any_value(norm) * any_value(qnorm)), 6) AS score FROM tf JOIN qt USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs WHERE score > 0 QUALIFY rank <= 5),
fu AS (SELECT query_id, doc_id, round(sum(s), 6) AS score, string_agg(r, ',' ORDER BY r) AS ranks FROM
 (SELECT query_id, doc_id, 1.0 / (60.0 + rank) AS s, 'bm25:' || rank AS r FROM bm UNION ALL SELECT query_id, doc_id, 0.85 / (60.0 + rank), 'vector:' || rank FROM co) GROUP BY ALL),
rr AS (SELECT fu.query_id, fu.doc_id, ranks, round(score + 0.15 * len(list_intersect(list_distinct(q.qt), list_distinct(d.t))) / len(list_distinct(q.qt)), 6) AS score
 FROM fu JOIN d USING (doc_id) JOIN (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{_TOK}') AS qt FROM benchmark) q USING (query_id))
"""


def _top(table: str, cols: str, k: int = 5) -> str:
    return f"SELECT query_id, doc_id, {cols}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {table} QUALIFY rank <= {k}"


@query(_BASE + "SELECT query_id, doc_id, score, rank::INT AS rank FROM bm")
def bm25_topk(t: Tables) -> DataFrame:
    return search.bm25(t.documents, t.benchmark, "item_id", 5)


@query(_BASE + "SELECT query_id, doc_id, score, rank::INT AS rank FROM co")
def cosine_topk(t: Tables) -> DataFrame:
    return search.cosine(t.documents, t.benchmark, "item_id", 5)


def _both(t: Tables) -> tuple[DataFrame, DataFrame]:
    posts = search.Postings(t.documents, t.benchmark, "item_id")
    return posts.bm25(5), posts.cosine(5)


@query(_BASE + ", h AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, score * 0.6 AS s FROM bm UNION ALL SELECT query_id, doc_id, score * 0.4 FROM co) GROUP BY ALL) " + _top("h", "score"))
def hybrid_sum(t: Tables) -> DataFrame:
    bm, co = _both(t)
    return search.hybrid_sum([(bm, 0.6), (co, 0.4)], 5)


def _fused(t: Tables, k: int | None = None) -> DataFrame:
    bm, co = _both(t)
    return search.fuse([("bm25", bm, 1.0), ("vector", co, 0.85)], k)


@query(_BASE + _top("fu", "score, ranks"))
def rrf_fused(t: Tables) -> DataFrame:
    return _fused(t, 5)


@query(_BASE + _top("rr", "score, ranks"))
def rrf_reranked(t: Tables) -> DataFrame:
    return search.rerank(_fused(t), t.documents, t.benchmark, "item_id", 5)


@query(_BASE + ", g AS (SELECT bm.*, source FROM bm JOIN d USING (doc_id)) SELECT query_id, doc_id, rank::INT AS rank, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source || '@v' || substr(source, 4) END AS provenance FROM g")
def search_with_provenance(t: Tables) -> DataFrame:
    registry = t.spark.createDataFrame([(f"src{i}", f"v{i}") for i in range(3)], "source string, version string")
    hits = search.bm25(t.documents, t.benchmark, "item_id", 5).join(t.documents.select("doc_id", "source"), "doc_id")
    return hits.join(F.broadcast(registry), "source", "left").select("query_id", "doc_id", "rank", F.when(F.col("version").isNotNull(), F.concat_ws("@", "source", "version")).alias("provenance"))


@query(_BASE.replace("FROM documents)", "FROM documents WHERE source IN ('src1', 'src3'))", 1) + "SELECT query_id, doc_id, score, rank::INT AS rank FROM bm")
def search_scoped(t: Tables) -> DataFrame:
    registry = t.spark.createDataFrame([("src1", True), ("src2", False), ("src3", True)], "source string, allowed boolean")
    allowed = F.broadcast(registry.filter("allowed").select("source"))
    return search.bm25(t.documents.join(allowed, "source", "left_semi"), t.benchmark, "item_id", 5)


@query(_BASE + ", r AS (SELECT item_id AS query_id, CASE item_id % 2 WHEN 0 THEN 'rules' ELSE 'world' END AS route, CASE item_id % 2 WHEN 0 THEN 2 ELSE 3 END AS k FROM benchmark) SELECT query_id, doc_id, route, rank::INT AS rank, substr(d.text, 1, 40) AS excerpt FROM bm JOIN r USING (query_id) JOIN d USING (doc_id) WHERE rank <= k")
def route_context(t: Tables) -> DataFrame:
    even = F.col("item_id") % 2 == 0
    routes = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(even, "rules").otherwise("world").alias("route"), F.when(even, 2).otherwise(3).alias("k"))
    hits = search.bm25(t.documents, t.benchmark, "item_id", 5).join(routes, "query_id").filter("rank <= k")
    return hits.join(t.documents.select("doc_id", F.substring("text", 1, 40).alias("excerpt")), "doc_id").select("query_id", "doc_id", "route", "rank", "excerpt")


@query(f"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def doc_freq(t: Tables) -> DataFrame:
    tf = t.documents.select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH d AS (SELECT len(regexp_extract_all(lower(text), '{_TOK}')) AS dl FROM documents) SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avgdl, max(dl)::BIGINT AS longest FROM d")
def term_stats(t: Tables) -> DataFrame:
    dl = F.size(T.tokens("text"))
    return t.documents.agg(F.count("*").alias("n_docs"), F.sum(dl).alias("n_tokens"), F.round(F.avg(dl), 6).alias("avgdl"), F.max(dl).cast("long").alias("longest"))


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT + ((length(lower(text)) - length(replace(lower(text), 'que', ''))) / 3)::BIGINT AS hits FROM documents WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20")
def keyword_fallback(t: Tables) -> DataFrame:
    return search.keyword_rank(t.documents, ["the", "que"], 20)


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5"""
)
def dense_topk(t: Tables) -> DataFrame:
    return search.inner_product_topk(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"), 5)


@query(
    _BASE + """, e AS (SELECT query_id, doc_id, round(ln(exp(bm.score) * (1 + 0.6 * len(list_intersect(['the', 'que', 'der'], list_distinct(d.t))))), 6) AS score FROM bm JOIN d USING (doc_id))
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM e QUALIFY rank <= 2"""
)
def entity_rerank(t: Tables) -> DataFrame:
    hits = search.bm25(t.documents, t.benchmark, "item_id", 4 * 2).drop("rank").join(t.documents.select("doc_id", "text"), "doc_id")
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, ("the", "que", "der"))), T.tokens("text")))
    return search.top(hits.select("query_id", "doc_id", F.round(F.log(F.exp("score") * (1 + 0.6 * overlap)), 6).alias("score")), 2)


@query("SELECT 'sha256:' || sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dups(t: Tables) -> DataFrame:
    return dedup.exact_duplicates(t.documents)


@query("SELECT sha1(substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 5000)) AS dup_key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def quick_dups(t: Tables) -> DataFrame:
    return dedup.quick_duplicates(t.documents)


@query("SELECT d.doc_id, min(o.doc_id) AS owner FROM documents d JOIN documents o ON o.source = d.source AND o.text = d.text AND o.doc_id < d.doc_id GROUP BY d.doc_id")
def dup_owner(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = h.groupBy("source", "h").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return h.join(first, ["source", "h"]).filter("doc_id <> owner").select("doc_id", "owner")


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
    c AS (SELECT s, min(doc_id) AS class_id FROM g GROUP BY s), e AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM c),
    p AS (SELECT a.class_id AS x, b.class_id AS y, any_value(a.n) AS xn, any_value(b.n) AS yn, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.class_id < b.class_id GROUP BY ALL),
    l AS (SELECT x, y FROM p WHERE k / (xn + yn - k) >= 0.8), k AS (SELECT class_id, count(*) AS n FROM (SELECT x AS class_id FROM l UNION ALL SELECT y FROM l) GROUP BY class_id)
    SELECT g.doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links FROM g JOIN c ON g.s = c.s LEFT JOIN k USING (class_id)"""
)
def near_dup_pairs(t: Tables) -> DataFrame:
    return dedup.near_duplicates(t.documents)


@query(
    """WITH f AS (SELECT doc_id AS id, 'd' AS k, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents
    UNION ALL SELECT item_id, 'i', list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') FROM benchmark),
    g AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM f)
    SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM g a JOIN g b ON a.g = b.g AND a.k = 'd' AND b.k = 'i' GROUP BY ALL"""
)
def benchmark_overlap(t: Tables) -> DataFrame:
    return dedup.overlap(t.documents, t.benchmark)


@query(
    f"""WITH b AS (SELECT quality, list_transform(regexp_extract_all(text, '{T.LETTER_WORD.replace("'", "''")}'), lambda x: lower(x)) AS w FROM documents JOIN labels USING (doc_id)),
    x AS (SELECT quality, 'token' AS kind, unnest(list_distinct(w)) AS term FROM b UNION ALL SELECT quality, 'bigram', unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM b),
    c AS (SELECT kind, term, count(*) FILTER (quality = 0) AS low_df, count(*) FILTER (quality = 1) AS high_df FROM x GROUP BY kind, term)
    SELECT kind, term, low_df, high_df, round(ln((low_df + 1) / (high_df + 1)), 4) AS log_odds_low FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (low_df + 1) / (high_df + 1) DESC, low_df DESC, term) <= 120"""
)
def noise_terms(t: Tables) -> DataFrame:
    counts = grams.term_classes(t.documents.join(t.labels, "doc_id"), T.letter_tokens("text"), F.col("quality"), grams.parts_of(t.documents))
    ratio = (F.col("low_df") + 1) / (F.col("high_df") + 1)
    # the best of each kind: two small sorts with a limit, not one window over all terms of a kind
    best = [counts.filter(F.col("kind") == k).orderBy(ratio.desc(), F.desc("low_df"), "term").limit(120) for k in ("token", "bigram")]
    return best[0].union(best[1]).withColumn("log_odds_low", F.round(F.log(ratio), 4))


@query(f"WITH d AS (SELECT source, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS t FROM documents), c AS (SELECT source, t, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT source, sum(n) AS total FROM c GROUP BY source) SELECT source, round(-sum(n / total * log2(n / total)), 6) AS entropy, count(*) AS vocabulary FROM c JOIN s USING (source) GROUP BY source")
def entropy_by_source(t: Tables) -> DataFrame:
    counts = t.documents.select("source", F.explode(T.tokens("text")).alias("t")).groupBy("source", "t").agg(F.count("*").alias("n"))
    # -sum p log p = log N - sum(n log n) / N: one aggregate, no join with the totals
    total = F.sum("n")
    return counts.groupBy("source").agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"), F.count("*").alias("vocabulary"))


@query(
    f"""WITH d AS (SELECT text, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents), w AS (SELECT unnest(t) AS t FROM d), c AS (SELECT t, count(*) AS n FROM w GROUP BY t),
    b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS b FROM d)
    SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM c) AS vocabulary, (SELECT sum(n) FROM c)::BIGINT AS n_tokens, (SELECT sum(length(text)) FROM d)::BIGINT AS n_chars,
    (SELECT count(*) - count(DISTINCT text) FROM d) AS n_duplicates, (SELECT round(count(DISTINCT b) / count(*), 6) FROM b) AS diversity"""
)
def corpus_stats(t: Tables) -> DataFrame:
    toks = t.documents.select(T.tokens("text").alias("t"))
    words = toks.select(F.explode("t").alias("t")).groupBy("t").count().agg(F.count("*").alias("vocabulary"), F.sum("count").alias("n_tokens"))
    pairs = grams.pair_counts(t.documents, T.tokens("text")).agg(F.round(F.count("*") / F.sum("n"), 6).alias("diversity"))
    texts = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c")).agg(F.sum("n").alias("n_docs"), F.sum("c").alias("n_chars"), (F.sum("n") - F.count("*")).alias("n_duplicates"))
    return texts.crossJoin(words).crossJoin(pairs)  # one row each


