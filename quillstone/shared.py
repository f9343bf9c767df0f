"""What operators share: the folder that driver and executors see, tables written there, joins on hot keys, batches by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A key counts as hot when it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256

#: Spark's setting to delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir`` where it is set.

    Where it is unset and all runs in this one process (master ``local[...]``, as in tests) a folder of our own is made;
    on a cluster executors could not see such a folder, so there it is an error.
    """
    context = spark.sparkContext
    if set_to := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return set_to.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return _OWN[context.applicationId]


class Workspace:
    """A fresh folder below the shared one; cuts lineage by writing tables and reading them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, clean: bool = False) -> DataFrame:
        """Write ``df`` and return the written table: survives lost executors, recomputes nothing.

        With ``clean`` the shuffle files of this write are deleted when it ends, not when the driver happens to collect garbage.
        """
        path = self.path(name)
        if clean:
            before = self.spark.conf.get(CLEANUP, None)
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if clean:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table made by :meth:`table` that nothing reads any more."""
        jvm = self.spark._jvm
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of ``column`` (one row at least): bounds a worker's memory."""
    for batch in batches:
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _literal(value: Any, kind: DataType) -> Column:
    """A value of a row as a literal of its type, structs by their fields."""
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(kind)


def hot_join(left: DataFrame, right: DataFrame, key: str, share: Column, keep: list[str], salt: list[str] | None = None, written: bool = False) -> DataFrame:
    """Left join on ``key`` where a few keys may hold a third of the left rows.

    ``right`` has one row a key; ``share`` is true for its hot keys, of which there can be at most HOT_SHARE (each
    holds 1/HOT_SHARE of the left rows or more), so they are broadcast. Rows of hot keys get a salt that matches
    nothing and so spread evenly over the shuffle of the rest; it is a hash of the row's columns ``salt`` (all, unless
    given), so a task that runs again deals its rows as before. Adds the columns ``keep`` of ``right``.

    Where both sides are ``written`` (tables, or filters over them), so that reading them twice costs little, rows of hot
    keys take their values from literals and are in no join or shuffle; rows of ``left`` without a match are left out.
    """
    slim = right.select(F.col(key).alias("_hk"), F.struct(*keep).alias("_hv"), F.coalesce(share, F.lit(False)).alias("_hot"))
    cold = slim.filter("not _hot").select(F.col("_hk").alias("_ck"), F.lit(0).alias("_cs"), F.col("_hv").alias("_cold_v"))
    if written:
        rows = slim.filter("_hot").select("_hk", "_hv").collect()
        joined = left.join(cold, F.col(key) == F.col("_ck")).select(*left.columns, F.col("_cold_v").alias("_v"))
        if rows:
            key_kind, kind = slim.schema["_hk"].dataType, slim.schema["_hv"].dataType
            keys, values = [_literal(r["_hk"], key_kind) for r in rows], [_literal(r["_hv"], kind) for r in rows]
            found = F.create_map(*[x for pair in zip(keys, values, strict=True) for x in pair])[F.col(key)]
            joined = left.filter(~F.col(key).isin(keys)).join(cold, F.col(key) == F.col("_ck")).select(*left.columns, F.col("_cold_v").alias("_v"))
            joined = joined.union(left.filter(F.col(key).isin(keys)).select(*left.columns, found.alias("_v")))
        return joined.select(*left.columns, *[F.col("_v")[c].alias(c) for c in keep])
    hot = F.broadcast(slim.filter("_hot").select("_hk", F.col("_hv").alias("_hot_v")))
    marked = left.join(hot, left[key] == F.col("_hk"), "left").drop("_hk")
    spread = F.pmod(F.xxhash64(*(salt or left.columns)), F.lit(4093)).cast("int") + 1
    marked = marked.withColumn("_s", F.when(F.col("_hot_v").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(spread))
    joined = marked.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    value = F.coalesce(F.col("_hot_v"), F.col("_cold_v"))
    return joined.select(*[F.col(c) for c in left.columns], *[value[c].alias(c) for c in keep])
