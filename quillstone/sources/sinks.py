"""What a run leaves behind: manifests and reports, an event log, rule chunks with their noise terms, a vector index, saved sessions.

Everything is written by Spark's committers, so a file is there whole or not at all, and a reader never sees a part.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, run_id string, level string, event_type string, message string, payload_json string"


def write_document(spark: SparkSession, root: str, run_id: str, name: str, payload: dict) -> str:
    """Write one JSON document of a run (its manifest, a report), in place of an earlier one of that name; returns its folder."""
    path = f"{root}/runs/{run_id}/{name}"
    spark.createDataFrame([(json.dumps({"run_id": run_id, **payload}, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def append_events(events: DataFrame, root: str) -> None:
    """Append (event_id, run_id, level, event_type, message, payload struct or map) to the log, in a folder a run; levels in upper case."""
    rows = events.select("event_id", "run_id", F.upper("level").alias("level"), "event_type", "message", F.coalesce(F.to_json("payload"), F.lit("{}")).alias("payload_json"))
    rows.write.mode("append").partitionBy("run_id").json(f"{root}/run_events")


def run_events(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Events of one run; only its folder is read."""
    return spark.read.schema(EVENTS).json(f"{root}/run_events").filter(F.col("run_id") == run_id)


def write_rules(records: DataFrame, noise: DataFrame, root: str, least: float) -> None:
    """Records with a quality_posterior of ``least`` or more as JSON lines, and the noise terms (kind, term, ...) of all as CSV, a folder a kind."""
    records.filter(F.coalesce("quality_posterior", F.lit(0.0)) >= least).write.json(f"{root}/rules")
    noise.write.partitionBy("kind").option("header", True).option("escape", '"').csv(f"{root}/noise")


def write_index(vectors: DataFrame, root: str) -> None:
    """A flat inner-product index: vectors of length one, as a table with their ids."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))
    vectors.select("vec_id", F.coalesce(unit, F.transform("embedding", lambda x: x.cast("double"))).alias("embedding")).write.parquet(f"{root}/index")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/index")


def write_report(checks: DataFrame, root: str, run_id: str) -> None:
    """Checks (name, level, bad), a handful of rows, as JSON lines and as a page."""
    checks.coalesce(1).write.mode("overwrite").json(f"{root}/runs/{run_id}/watchdog.json")
    rows = "".join(f"<tr><td>{escape(str(r.name_))}</td><td>{escape(str(r.level))}</td><td>{r.bad}</td></tr>" for r in checks.select(F.col("name").alias("name_"), "level", "bad").orderBy("name_").collect())
    page = f"<!DOCTYPE html><html><body><h1>{escape(run_id)}</h1><table><tr><th>check</th><th>level</th><th>rows</th></tr>{rows}</table></body></html>"
    checks.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/runs/{run_id}/watchdog.html")


def checksum(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def save_sessions(stored: DataFrame, attempts: DataFrame, to: str) -> DataFrame:
    """Compare and set: write the sessions with the attempts that fit, and return what became of each attempt.

    ``stored`` is (session_id, revision, payload, payload_sha256); ``attempts`` (session_id, expected, payload), one a
    session. An attempt is saved if it expects the stored revision, or any (null); of a session that is not stored it may
    expect none or 0. A stored payload that no longer has its checksum fails the job. Gives (session_id, outcome,
    revision): saved or conflict, and the revision that is stored afterwards (null: none).
    """
    spark = stored.sparkSession
    sound = F.when(F.col("payload_sha256") == checksum(F.col("payload")), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("checksum of session "), F.col("session_id").cast("string"))))
    old = stored.select("session_id", F.col("revision").alias("old_revision"), sound.alias("old_payload"))
    new = attempts.select("session_id", "expected", F.col("payload").alias("new_payload"), F.lit(True).alias("tried"))
    both = old.join(new, "session_id", "full_outer")
    held = F.coalesce("old_revision", F.lit(0))
    fits = F.coalesce(F.col("tried") & (F.col("expected").isNull() | (F.col("expected") == held)), F.lit(False))
    done = both.select("session_id", "tried", fits.alias("saved"), F.when(fits, held + 1).otherwise(F.col("old_revision")).alias("revision"), F.when(fits, F.col("new_payload")).otherwise(F.col("old_payload")).alias("payload"))
    done.withColumn("payload_sha256", checksum(F.col("payload"))).write.parquet(to)
    table = spark.read.parquet(to)
    return table.filter("tried").select("session_id", F.when(F.col("saved"), "saved").otherwise("conflict").alias("outcome"), "revision")


def read_sessions(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(at).filter("revision is not null").select("session_id", "revision", "payload", "payload_sha256")
