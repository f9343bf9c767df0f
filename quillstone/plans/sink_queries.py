"""Queries that write what a run leaves behind and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query, sql_of
from ..operators import search
from ..sources import sinks
from ..streaming import checkpoint_dir
from . import governance_queries, search_queries



@query("SELECT 'run-1' AS run_id, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources FROM documents")
def run_manifest(t: Tables) -> DataFrame:
    root = checkpoint_dir(t.spark, "manifest")
    counted = t.documents.agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.countDistinct("source").alias("n_sources")).first()
    path = sinks.write_document(t.spark, root, "run-1", "run_manifest.json", counted.asDict())
    sinks.write_document(t.spark, root, "run-1", "run_manifest.json", counted.asDict())
    return t.spark.read.schema("run_id string, n_docs long, n_chars long, n_sources long").json(path)


@query("SELECT event_id, upper(event_type) AS level, 'event ' || event_type AS message, '{\"user_id\":' || user_id || '}' AS payload_json FROM events WHERE user_id % 3 = 1")
def event_log(t: Tables) -> DataFrame:
    """A log that two runs append to in turn; one run's events come back."""
    root = checkpoint_dir(t.spark, "events")
    rows = t.events.select("event_id", F.concat(F.lit("run-"), F.col("user_id") % 3).alias("run_id"), F.col("event_type").alias("level"), "event_type", F.concat(F.lit("event "), "event_type").alias("message"), F.struct("user_id").alias("payload"))
    for part in (0, 1):
        sinks.append_events(rows.filter(F.col("event_id") % 2 == part), root)
    return sinks.run_events(t.spark, root, "run-1").select("event_id", "level", "message", "payload_json")


@query(sql_of(search_queries.noise_terms))
def noise_csv(t: Tables) -> DataFrame:
    """The noise terms as their CSV files have them."""
    root = checkpoint_dir(t.spark, "rules")
    sinks.write_rules(t.documents.select("doc_id", F.lit(0.9).alias("quality_posterior")), search_queries.noise_terms(t), root, 0.55)
    schema = "term string, low_df long, high_df long, log_odds_low double, kind string"
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{root}/noise").select("kind", "term", "low_df", "high_df", "log_odds_low")


@query("SELECT doc_id, round(1.0 / (1 + doc_id % 4), 4) AS quality_posterior FROM documents WHERE 1.0 / (1 + doc_id % 4) >= 0.4")
def rules_jsonl(t: Tables) -> DataFrame:
    root = checkpoint_dir(t.spark, "rules")
    records = t.documents.select("doc_id", F.round(1.0 / (1 + F.col("doc_id") % 4), 4).alias("quality_posterior"))
    none = t.spark.createDataFrame([], "kind string, term string, low_df long, high_df long, log_odds_low double")
    sinks.write_rules(records, none, root, 0.4)
    return t.spark.read.schema("doc_id long, quality_posterior double").json(f"{root}/rules")


@query(
    """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.e, d.e), 5) AS score FROM u q, u d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5"""
)
def dense_index(t: Tables) -> DataFrame:
    """Search over the index as it is stored; the queries are the rows whose id is divisible by 100."""
    root = checkpoint_dir(t.spark, "index")
    sinks.write_index(t.embeddings, root)
    stored = sinks.read_index(t.spark, root)
    return search.inner_product_topk(stored, stored.filter("vec_id % 100 = 0"), 5)


@query(sql_of(governance_queries.watchdog_checks))
def watchdog_report(t: Tables) -> DataFrame:
    root = checkpoint_dir(t.spark, "watchdog")
    sinks.write_report(governance_queries.watchdog_checks(t), root, "run-1")
    return t.spark.read.schema("name string, bad long, level string").json(f"{root}/runs/run-1/watchdog.json")


@query("""WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 + 1 END AS held, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 9 ELSE c_custkey % 4 + 1 END AS expected FROM customer),
a AS (SELECT *, expected IS NULL OR expected = coalesce(held, 0) AS ok FROM s WHERE k % 7 > 0), b AS (SELECT k, CASE WHEN ok THEN coalesce(held, 0) + 1 ELSE held END AS held, expected, ok FROM a)
SELECT 1 AS round, k AS session_id, CASE WHEN ok THEN 'saved' ELSE 'conflict' END AS outcome, held AS revision FROM b
UNION ALL SELECT 2, k, CASE WHEN coalesce(held, 0) = 1 THEN 'saved' ELSE 'conflict' END, CASE WHEN coalesce(held, 0) = 1 THEN 2 ELSE held END FROM b""")
def session_saves(t: Tables) -> DataFrame:
    """Sessions saved against a stored table, then again by attempts that all expect revision 1."""
    root, k = checkpoint_dir(t.spark, "sessions"), F.col("c_custkey")
    payload = F.to_json(F.struct(k.alias("id"), "c_name"))
    stored = t.customer.filter(k % 3 > 0).select(k.alias("session_id"), (k % 4 + 1).alias("revision"), payload.alias("payload")).withColumn("payload_sha256", sinks.checksum(F.col("payload")))
    expected = F.when(k % 5 == 0, F.lit(0).cast("long")).when(k % 5 == 1, F.lit(None).cast("long")).when(k % 5 == 2, F.lit(9).cast("long")).otherwise(k % 4 + 1)
    attempts = t.customer.filter(k % 7 > 0).select(k.alias("session_id"), expected.alias("expected"), F.concat(payload, F.lit("+")).alias("payload"))
    first = sinks.save_sessions(stored, attempts, f"{root}/1")
    again = sinks.save_sessions(sinks.read_sessions(t.spark, f"{root}/1"), attempts.withColumn("expected", F.lit(1).cast("long")), f"{root}/2")
    return first.select(F.lit(1).alias("round"), "*").unionByName(again.select(F.lit(2).alias("round"), "*"))
