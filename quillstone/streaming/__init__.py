"""Structured Streaming over the event table: windows with watermarks, sessions, deduplication and keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_dir

DELAY = "10 minutes"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Events as a stream of the folder's Parquet file(s), with ts as a timestamp and a watermark."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob takes a single file and a folder of part files alike
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def run_once(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is and return its result, written as a table below ``checkpoint``.

    Append results are written by the file sink; complete and update ones by a batch writer that names each batch, so a
    batch that runs again replaces itself.
    """
    spark, out = stream.sparkSession, f"{checkpoint}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def running_state(events: DataFrame) -> DataFrame:
    """Keyed state of each user: events so far and the type of the last, one row a user and batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, at = state.get if state.exists else (0, "", -1)
        for p in parts:
            n += len(p)
            top = p.loc[p["event_id"].idxmax()]
            if top["event_id"] > at:
                last, at = str(top["event_type"]), int(top["event_id"])
        state.update((n, last, at))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, last_type string", "n long, last_type string, at long", "update", GroupStateTimeout.NoTimeout)


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


Transform = Callable[[DataFrame], DataFrame]
