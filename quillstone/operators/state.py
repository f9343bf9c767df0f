"""Keyed state: upserts, merges, change detection, revisions, and orders that are decided by rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def upsert(state: DataFrame, delta: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of ``delta`` replace those of ``state``; columns ``keep`` stay as they were first."""
    s, d = state.alias("s"), delta.alias("d")
    joined = s.join(d, F.col(f"s.{key}") == F.col(f"d.{key}"), "full_outer")
    new = F.col(f"d.{key}").isNotNull()
    cols = []
    for c in state.columns:
        fresh = F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}")) if c in (key, *keep) else F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"s.{c}"))
        cols.append(fresh.alias(c))
    return joined.select(*cols)


def insert_or_ignore(state: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``state`` with the first row of each new key."""
    others = [c for c in delta.columns if c not in keys]
    first = delta.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")
    return state.unionByName(first.join(state, keys, "left_anti").select(*state.columns))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row a key: an aggregate, no sort of a key's rows."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def changes(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Adds outcome: new, changed or unchanged against the key's row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("outcome", F.when(first, "new").when(before.eqNullSafe(F.col(value)), "unchanged").otherwise("changed"))


def fold(rows: DataFrame, key: str, order: str, columns: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], schema: str, every: bool = False) -> DataFrame:
    """Sequential fold of each key's rows in their order, as a stream: a task holds one state, whatever a key's size.

    ``step`` takes the state and a row's ``columns``. Gives (key, state) a key, or with ``every`` (key, order, state) a
    row; ``schema`` names and types them. Rows of a key are brought together and sorted by the shuffle, which spills.
    """
    names = [key, order, *columns]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_ = None, start, False
        for batch in batches:
            out = []
            for k, at, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not open_ or k != now:
                    if open_ and not every:
                        out.append((now, *state))
                    now, state, open_ = k, start, True
                state = step(state, tuple(row))
                if every:
                    out.append((k, at, *state))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)
        if open_ and not every:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, *state), arrow, strict=True)], schema=arrow)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def revisions(attempts: DataFrame, key: str, expected: str, order: str) -> DataFrame:
    """(key, order, accepted, revision): a save counts only if it expects the number of saves that counted before."""

    def step(state: tuple, row: tuple) -> tuple:
        ok = row[0] == state[1]
        return ok, state[1] + ok

    kinds = dict(attempts.dtypes)
    return fold(attempts, key, order, [expected], (False, 0), step, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, revision int", every=True)
