"""Stateful streams over several batches and a restart, against the batch operators."""

from pyspark.sql import functions as F

from quillstone.operators import state
from quillstone.streaming import stateful


def feed(spark, sf, root, parts, of=6):
    """Append some sixths of the events, each a file of its own, in their order."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = events.approxQuantile("event_id", [i / of for i in range(1, of)], 0)
    for i in parts:
        low, high = cut[i - 1] if i else -1, cut[i] if i < of - 1 else 1e18
        events.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(str(root))
    return events


def stream(spark, sf, root):
    schema = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root))


def run(df, out, check, mode="append"):
    with stateful.state_store(df.sparkSession):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", str(check)).trigger(availableNow=True)
        q = q.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"))
        q.start().awaitTermination()


def test_changes_over_batches_and_a_restart(spark, sf, tmp_path):
    events = feed(spark, sf, tmp_path / "in", range(3))
    make = lambda: stateful.changes(stream(spark, sf, tmp_path / "in"), "user_id", "event_type", ["event_id"], "event_id")
    run(make(), tmp_path / "out", tmp_path / "check")
    feed(spark, sf, tmp_path / "in", range(3, 6))
    run(make(), tmp_path / "out", tmp_path / "check")  # goes on from the checkpoint
    want = state.changes(events, "user_id", "event_type", ["event_id"]).select("event_id", "outcome")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("event_id", "outcome").collect())) == sorted(map(tuple, want.collect()))
    assert got.select("batch").distinct().count() == 6


def test_totals_are_those_of_all_rows(spark, sf, tmp_path):
    events = feed(spark, sf, tmp_path / "in", range(6))
    run(stateful.totals(stream(spark, sf, tmp_path / "in"), "user_id", "event_type", "value", ["event_id"]), tmp_path / "out", tmp_path / "check", "update")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id", "kind").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))
    want = events.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_timers_let_rows_go_one_by_one(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 1000 + t) for i, t in enumerate([0, 0, 1, 1, 2, 30, 31, 31, 200, 200])]
    for k, part in enumerate((rows[:6], rows[6:], [(99, "end", 10_000)])):  # the last moves the watermark past all
        spark.createDataFrame(part, "id long, host string, t long").select("id", "host", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, host string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    run(stateful.rate_limited(source, "host", 2000, "id", "ts"), tmp_path / "out", tmp_path / "check")
    got = {r.id: r.at // 1000 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, free = {}, {}
    for i, host, t in rows:
        want[i] = max(t, free.get(host, 0))
        free[host] = want[i] + 2
    got.pop(99, None)
    assert got == want
