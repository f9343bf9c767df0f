"""Document fingerprints: a digest of the quartiles of hashed byte triplets, compared by a bounded difference.

Six triplets of each window of five bytes are hashed to BUCKETS buckets and counted. The digest is the length on a
logarithmic scale (two bytes) and, for each bucket, which quarter of all buckets its count falls into (two bits).
Digests differ by the weights of the steps between their quarters and, up to a bound, of their lengths. The difference
is bounded by what digests of unrelated texts come to (or the most that two nearly empty digests can differ by), and a
likeness is one less the difference over that bound: 1 for equal texts, about 0 for unrelated ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, small_batches

BUCKETS = 1024
#: Places in a window of five bytes that make up a triplet, each with the first byte.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What one, two and three steps between quarters weigh; unrelated full digests come to 2 a bucket.
STEPS = np.array([0, 2, 3, 4])
UNRELATED = 2 * BUCKETS
#: Steps of the length a doubling, what a step weighs, and beyond how many steps lengths differ no further.
LENGTH_SCALE, LENGTH_WEIGHT, LENGTH_MOST = 12, 8, 32
#: Bytes counted at once, which bounds memory for texts of any length.
SLICE = 1 << 18
_DIFFER = STEPS[np.abs(np.arange(4)[:, None] - np.arange(4))]


def _table(role: int) -> np.ndarray:
    """A hash below BUCKETS of each byte in one place of a window."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([role, b])) % BUCKETS for b in range(256)], np.uint16)


_FIRST = _table(0)
_SECOND = {j: _table(j) for j in (1, 2, 3)}
_THIRD = {k: _table(8 + k) for k in (2, 3, 4)}


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many triplets of the text fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    every = np.frombuffer(raw, np.uint8)
    for start in range(0, max(len(every) - 2, 0), SLICE):
        part = every[start : start + SLICE + 4]
        firsts = min(SLICE, len(part))
        first = _FIRST[part]
        second, third = {j: t[part] for j, t in _SECOND.items()}, {k: t[part] for k, t in _THIRD.items()}
        for j, k in TRIPLETS:
            n = min(firsts, len(part) - k)
            if n > 0:
                counts += np.bincount(first[:n] ^ second[j][j : j + n] ^ third[k][k : k + n], minlength=BUCKETS)
    return counts


def digest(counts: np.ndarray, n_bytes: int) -> bytes:
    """Two bytes of length, then two bits a bucket: the quarter of the buckets that its count falls into."""
    quarters = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(quarters, counts, "left").astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return round(LENGTH_SCALE * math.log2(n_bytes + 1)).to_bytes(2, "big") + packed.tobytes()


def fingerprint(raw: bytes) -> bytes:
    return digest(bucket_counts(raw), len(raw))


def _codes(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8, offset=2)
    return (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def difference(a: bytes, b: bytes) -> tuple[int, int]:
    """How much two digests differ, and the bound of that, which the difference never exceeds."""
    x, y = _codes(a), _codes(b)
    length = LENGTH_WEIGHT * min(abs(int.from_bytes(a[:2], "big") - int.from_bytes(b[:2], "big")), LENGTH_MOST)
    bound = min(UNRELATED, int(STEPS[x].sum() + STEPS[y].sum()) + LENGTH_WEIGHT * LENGTH_MOST)
    return min(int(_DIFFER[x, y].sum()) + length, bound), bound


def likeness_of(a: bytes, b: bytes) -> float:
    found, bound = difference(a, b)
    return 1.0 - found / bound


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints as hex strings; null where one of them is."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness_of(bytes.fromhex(p), bytes.fromhex(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return alike(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, fingerprint) of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is an empty one, whose digest is all zeros; texts below three bytes have a length only. Rows are neither
    moved nor joined: repeated rows and null ids stay, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t).hex() for t in texts], pa.string())],
                ["doc_id", "n_bytes", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, fingerprint string")


@dataclass
class _Row:
    """A document whose successor is awaited."""

    doc_id: int | None
    raw: bytes
    text: bytes | str  # the bytes themselves where each is a code point
    counts: np.ndarray
    digest: bytes

    @classmethod
    def of(cls, doc_id: int | None, raw: bytes) -> _Row:
        counts = bucket_counts(raw)
        return cls(doc_id, raw, raw if raw.isascii() else raw.decode(), counts, digest(counts, len(raw)))

    def head(self, n: int) -> bytes:
        """UTF-8 of the first n code points, or of all."""
        return self.raw[:n] if isinstance(self.text, bytes) else self.text[:n].encode()

    def against(self, after: _Row) -> tuple:
        """The row's result: what becomes of its digest when its last quarter makes way for the head of ``after``."""
        k = len(self.text) // 4
        kept = self.raw[: len(self.raw) - k] if isinstance(self.text, bytes) else self.text[: len(self.text) - k].encode()
        edited = kept + after.head(k)
        seam = max(len(kept) - 4, 0)  # windows that begin before it are the same in both
        changed = digest(self.counts - bucket_counts(self.raw[seam:]) + bucket_counts(edited[seam:]), len(edited))
        return (self.doc_id, len(self.text), hashlib.sha256(edited).hexdigest(), self.digest, changed, likeness_of(self.digest, changed), likeness_of(self.digest, after.digest))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_CHAIN = pa.schema([*_RESULT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.binary())])
_BATCH_ROWS = 2000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each with its successor, and the texts of the first and the last row, which meet other parts."""
    part, before, rows = TaskContext.get().partitionId(), None, []
    for batch in small_batches(batches, "text"):
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            now = _Row.of(doc_id, raw or b"")
            rows.append((doc_id, *[None] * 6, part, "first", now.raw) if before is None else (*before.against(now), part, None, None))
            before = now
            if len(rows) >= _BATCH_ROWS:
                yield _batch(rows, _CHAIN)
                rows = []
    if before is not None:
        rows.append((before.doc_id, *[None] * 6, part, "last", before.raw))
    if rows:
        yield _batch(rows, _CHAIN)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield _batch([_Row.of(r["doc_id"], r["text"]).against(_Row.of(r["next_id"], r["next_text"]))], _RESULT)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, in the order of doc_id.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next. The edited
    text ends with the head of the next document's text in place of its own last floor(n_chars / 4) code points; the
    last document's next is the first, a lone document's next is itself. Null texts are empty. Null ids come first;
    rows of one doc_id follow each other by a hash of the text, equal rows in any order. Other columns are ignored and
    an empty table gives an empty one.

    Texts move once, to parts by ranges of doc_id, and stream through them one after another; where parts meet, the
    last text of one and the first of the next are joined, a pair a part.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chain = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chain, f"{_RESULT_SQL}, part int, edge string, text binary")
    chain = work.table(chain, "chain")
    result = [c.split()[0] for c in _RESULT_SQL.split(", ")]
    firsts = chain.filter("edge = 'first'").select("part", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    parts = firsts.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part")))  # a number a part
    parts = parts.select("part", following.alias("next_part"))
    met = chain.filter("edge = 'last'").select("part", "doc_id", "text").join(parts, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    ends = met.select("doc_id", "text", "next_id", "next_text").mapInArrow(_edges, _RESULT_SQL)
    every = chain.filter("edge is null").select(*result).unionByName(ends)
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
