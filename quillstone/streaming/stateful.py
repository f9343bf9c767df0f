"""Keyed stream operators with state of their own: change detection, rate limits and running folds, over any number of batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: These operators keep lists, maps and timers, which only this store has.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that these operators need, for the streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch, in their order; a batch's size is bounded by what a trigger takes."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _Changes(StatefulProcessor):
    """The last value of each key; rows come and go as they are, since a table of pandas for each key takes longer than its rows."""

    def __init__(self, key: str, value: str, order: list[str], id_: str, ttl: int | None):
        self.key, self.value, self.order, self.id, self.ttl = key, value, order, id_, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string", ttlDurationMs=self.ttl) if self.ttl else handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        before = self.last.get()
        known, last = before is not None, before[0] if before else None
        made = Row(self.id, "outcome")
        # a key's rows of one batch; nulls come last
        for row in sorted(rows, key=lambda r: [(True,) if r[c] is None else (False, r[c]) for c in self.order]):
            value = None if row[self.value] is None else str(row[self.value])
            yield made(row[self.id], "new" if not known else "unchanged" if value == last else "changed")
            known, last = True, value
        self.last.update((last,))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, value: str, order: list[str], id_: str, ttl_ms: int | None = None) -> DataFrame:
    """(id, outcome) of each row: new, changed or unchanged against the key's row before, in whichever batch that was.

    Batches come in the order of ``order``; a key that has been silent for ``ttl_ms`` is forgotten and new again.
    """
    rows = stream.select(*dict.fromkeys([key, value, *order, id_]))
    kind = rows.schema[id_].dataType.simpleString()
    return rows.groupBy(key).transformWithState(_Changes(key, value, order, id_, ttl_ms), f"{id_} {kind}, outcome string", "Append", "ProcessingTime" if ttl_ms else "None")


class _Limiter(StatefulProcessor):
    """When a key is free again, and what still waits: a list of rows, let go by timers."""

    def __init__(self, gap: int, id_: str, at: str):
        self.gap, self.id, self.at = gap, id_, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.free = handle, handle.getValueState("free", "at long")
        self.waiting = handle.getListState("waiting", "id long, start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        free = self.free.get()[0] if self.free.exists() else None
        batch = _in_order(rows, [self.at, self.id])
        for id_, at in zip(batch[self.id], batch[self.at], strict=True):
            start = int(at) if free is None else max(int(at), free)
            self.waiting.appendValue((int(id_), start))
            self.handle.registerTimer(start)
            free = start + self.gap
        self.free.update((free,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        due, later = [], []
        for row in self.waiting.get():
            (due if row[1] <= now else later).append((row[0], row[1]))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if due:
            yield pd.DataFrame({"id": [d[0] for d in due], "at": [d[1] for d in due]})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, gap_ms: int, id_: str, time: str) -> DataFrame:
    """(id, at): when each row (a long ``id_``, an event-time column ``time`` with a watermark) may start, in milliseconds.

    Rows of a key start at their time or ``gap_ms`` after the one before, whatever comes later. They wait in the key's
    state until a timer lets them go, which is when the watermark passes their start.
    """
    at = (stream[time].cast("double") * 1000).cast("long").alias("at_ms")
    rows = stream.select(stream[key].alias("key"), stream[id_].cast("long").alias("id"), at, stream[time])
    return rows.groupBy("key").transformWithStateInPandas(_Limiter(gap_ms, "id", "at_ms"), "id long, at long", "Append", "EventTime")


def totals(stream: DataFrame, key: str, kind: str, value: str, order: list[str]) -> DataFrame:
    """(key, kind, n, total) of each key and kind as of each batch that has rows of it (output mode update).

    A streaming aggregate: rows of a batch add up before they are moved, and the state is one row a key and kind. Sums
    need no ``order``. As in SQL, null values don't add and null kinds are a kind.
    """
    return stream.groupBy(F.col(key), F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
