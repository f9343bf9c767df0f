"""Queries over streams with keyed state: the events in batches, against what SQL says of all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query, sql_of
from ..streaming import checkpoint_dir, stateful
from . import state_queries

#: Slices that the events come in, in their order. The stream is started anew for each and goes on from its checkpoint.
BATCHES = 4


def _fed(t: Tables, name: str, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The operator's rows over all batches, with the batch; a batch that runs again replaces itself."""
    root = checkpoint_dir(t.spark, name)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.col("ts").cast("double")
    cuts = [float("-inf"), *events.select(at.alias("at")).approxQuantile("at", [i / BATCHES for i in range(1, BATCHES)], 0.001), float("inf")]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        events.filter((at > low) & (at <= high)).write.mode("append").parquet(f"{root}/in")
        rows = operator(t.spark.readStream.schema(events.schema).parquet(f"{root}/in"))
        with stateful.state_store(t.spark):
            writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
            writer.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/batch={i}")).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@query(sql_of(state_queries.change_detection))
def change_stream(t: Tables) -> DataFrame:
    return _fed(t, "changes", lambda rows: stateful.changes(rows, "user_id", "event_type", ["ts", "event_id"], "event_id"), "append").select("event_id", "outcome")


@query("SELECT user_id, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def totals_stream(t: Tables) -> DataFrame:
    rows = _fed(t, "totals", lambda events: stateful.totals(events, "user_id", "event_type", "value", ["event_id"]), "update")
    return rows.groupBy("user_id", "kind").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))
