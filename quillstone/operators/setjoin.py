"""Similarity join of sets: how many others are similar to each, exactly, without rows for pairs.

Elements are ordered from the rarest on, the same for all. Two sets with a Jaccard similarity of t share one of the
first n - ceil(t n) + 1 of their n elements (the prefix), so only elements of prefixes that several sets have, the
groups, are looked at. A group is cut into chunks by a hash of the set, and pairs of chunks are what tasks are made of:
no group, however many sets it holds, comes into one task.

First what is known of the sets at a group (size, place of the element, a sketch of what stands behind it) meets. A pair
is ruled out there by sizes, by places (what is left behind both places has to be enough) and by the sketches: with w
sketch bits that differ, the rests differ in w elements at least, and so little may be left. A pair counts in the group
of its first common element alone, so one that shares one of the few elements just before the group's is ruled out too:
near copies meet in the groups of all their prefix, but are looked at in one or two. Only sets that have a partner left
go on, with their elements, and what leaves a pair of chunks is a count for each set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace

#: Sets of a chunk of the first step, and elements of a chunk of the second, about.
SETS_MOST, ELEMENTS_MOST = 2048, 400_000
#: Bits of a sketch: 64 a word.
SKETCH_WORDS = 8
#: Elements before a place that go with a set.
BEFORE = 6
#: Elements that are multiplied out at once.
WIDE = 4096
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def prefixes(sets: DataFrame, at_least: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, n, o array<long>) with those of the n elements that several sets hold, the rarest first, and (id, n, s, i, sketch, before) of prefix elements that several sets hold.

    The order is by how many sets hold an element and then by the element; elements of one set alone stand first, at places
    that ``o`` leaves out, and no set has only such ones here.
    ``before`` are the BEFORE elements in front of the place that several sets hold, nearest first; where there are fewer, ``s`` fills up.
    """
    counted = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = counted.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = counted.join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))  # one set's elements
    ordered = ordered.select("id", "n", F.transform("o", lambda x: x["s"]).alias("o"))
    ordered = work.table(ordered, "ordered", clean=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                ids, s, i, sketches, sizes, fronts = [], [], [], [], [], []
                part = batch.slice(start, 200)
                for id_, n, o in zip(part.column("id").to_pylist(), part.column("n").to_pylist(), part.column("o"), strict=True):
                    o = o.values.to_numpy()
                    alone = n - len(o)
                    keep = n - int(np.ceil(n * at_least - 1e-9)) + 1
                    if keep <= alone:
                        continue
                    at = np.arange(keep - alone)
                    bits = (o.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)
                    rest = np.zeros((len(o) + 1, SKETCH_WORDS), np.uint64)
                    rest[np.arange(len(o)), (bits >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bits & np.uint64(63))
                    rest = np.bitwise_xor.accumulate(rest[::-1], axis=0)[::-1]  # parity of what stands from a place on
                    ids += [id_] * len(at)
                    sizes += [n] * len(at)
                    s.append(o[at])
                    i.append(alone + at)
                    sketches.append(rest[at + 1])
                    front = at[:, None] - np.arange(1, BEFORE + 1)
                    fronts.append(np.where(front >= 0, o[np.maximum(front, 0)], o[at][:, None]))
                if ids:
                    packed = [pa.Array.from_buffers(pa.binary(8 * raw.shape[1]), len(ids), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary()) for raw in map(np.concatenate, (sketches, fronts))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(s)), pa.array(np.concatenate(i).astype(np.int32)), *packed], ["id", "n", "s", "i", "sketch", "before"])

    held = ordered.mapInArrow(run, "id long, n int, s long, i int, sketch binary, before binary")
    return ordered, held


def chunk_pairs(rows: DataFrame, weights: DataFrame, of: list[str]) -> DataFrame:
    """(s, x, y, left, right): the rows of each pair of chunks (x <= y) of each group; ``weights`` is (s, k), k the group's chunks."""
    chunk = F.pmod(F.xxhash64("id", "s"), F.col("k")).cast("int")
    dealt = rows.join(weights, "s").withColumn("c", chunk)
    pairs = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d")
    dealt = dealt.select("s", "c", F.struct(*of).alias("r"), pairs)
    dealt = dealt.select("s", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), (F.col("c") <= F.col("d")).alias("l"), (F.col("c") >= F.col("d")).alias("g"), "r")
    side = lambda flag: F.collect_list(F.when(F.col(flag), F.col("r")))  # noqa: E731  a chunk
    return dealt.groupBy("s", "x", "y").agg(side("l").alias("left"), side("g").alias("right"))


def _fits(na: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray, t: float) -> np.ndarray:
    """Pairs of sizes and places that similarity ``t`` allows."""
    enough = np.ceil(t / (1 + t) * (na[:, None] + nb) - 1e-9)
    left = 1 + np.minimum((na - 1 - ia)[:, None], nb - 1 - ib)
    return (np.minimum(na[:, None], nb) >= np.maximum(na[:, None], nb) * t) & (left >= enough)


def _has_partner(left: list[dict], right: list[dict], same: bool, s: int, t: float) -> set[int]:
    """Sets of either side with a partner that sizes, places, sketches and the elements before ``s`` allow."""
    ids, n, i, sketch = ([np.array([r[c] for r in side]) for side in (left, right)] for c in ("id", "n", "i", "sketch"))
    words = [np.frombuffer(b"".join(r["sketch"] for r in side), np.uint16).reshape(len(side), -1) for side in (left, right)]
    before = [np.frombuffer(b"".join(r["before"] for r in side), np.int64).reshape(len(side), -1) for side in (left, right)]
    found: set[int] = set()
    for a in range(0, len(left), 256):
        part = slice(a, a + 256)
        ok = _fits(n[0][part], n[1], i[0][part], i[1], t) & (ids[0][part, None] != ids[1])
        if same:
            ok &= ids[0][part, None] < ids[1]
        near = before[0][part, 0]
        ok &= (near[:, None] != before[1][:, 0]) | (near == s)[:, None]
        p, q = np.nonzero(ok)
        for b in range(0, len(p), 1 << 15):
            x, y = p[b : b + (1 << 15)] + a, q[b : b + (1 << 15)]
            apart = _POP[words[0][x] ^ words[1][y]].sum(axis=1)
            # behind the places there are ra and rb elements; of them at least enough - 1 - (those before) are common
            ra, rb = n[0][x] - 1 - i[0][x], n[1][y] - 1 - i[1][y]
            enough = np.ceil(t / (1 + t) * (n[0][x] + n[1][y]) - 1e-9) - 1  # the group's element is the first common one
            ok2 = apart <= ra + rb - 2 * enough
            x, y = x[ok2], y[ok2]
            fa, fb = before[0][x], before[1][y]
            first = np.ones(len(x), bool)
            for k in range(fa.shape[1]):
                first &= (fa[:, k] == s) | (fa[:, k, None] != fb).all(axis=1)
            x, y = x[first], y[first]
            found.update(ids[0][x].tolist(), ids[1][y].tolist())
    return found


def _counts(left: list[dict], right: list[dict], same: bool, s: int, t: float) -> dict[int, int]:
    """Similar pairs of two chunks by set, of those whose first common element is ``s``."""
    def sparse(side: list[dict]) -> tuple[np.ndarray, ...]:
        n, held = np.array([r["n"] for r in side]), np.array([len(r["o"]) for r in side])
        places = np.arange(held.sum()) + np.repeat(n - np.cumsum(held), held)  # elements that one set alone holds stand before
        return np.array([r["id"] for r in side]), n, np.concatenate([np.array(r["o"], np.int64) for r in side]), np.repeat(np.arange(len(side)), held), np.array([r["i"] for r in side]), places

    (ia, na, ea, ra, pa_, place_a), (ib, nb, eb, rb, pb, place_b) = sparse(left), sparse(right)
    ok = _fits(na, nb, pa_, pb, t) & (ia[:, None] != ib)
    if same:
        ok &= ia[:, None] < ib
    if not ok.any():
        return {}
    common, ca, cb = np.unique(np.concatenate([ea, eb])), None, None
    common = common[np.isin(common, ea) & np.isin(common, eb)]
    ca, cb = np.searchsorted(common, ea), np.searchsorted(common, eb)
    in_a, in_b = np.isin(ea, common), np.isin(eb, common)
    shared, before = np.zeros(ok.shape, np.float32), np.zeros(ok.shape, np.float32)
    for c in range(0, len(common), WIDE):
        wide = min(WIDE, len(common) - c)

        def dense(rows: np.ndarray, cols: np.ndarray, pick: np.ndarray, n: int, c: int = c, wide: int = wide) -> np.ndarray:
            out = np.zeros((n, wide), np.float32)
            pick = pick & (cols >= c) & (cols < c + wide)
            out[rows[pick], cols[pick] - c] = 1
            return out

        shared += dense(ra, ca, in_a, len(ia)) @ dense(rb, cb, in_b, len(ib)).T
        before += dense(ra, ca, in_a & (place_a < pa_[ra]), len(ia)) @ dense(rb, cb, in_b & (place_b < pb[rb]), len(ib)).T
    ok &= (before == 0) & (shared / (na[:, None] + nb - shared.astype(np.float64)) >= t)
    out: dict[int, int] = {}
    for ids, k in ((ia, ok.sum(axis=1)), (ib, ok.sum(axis=0))):
        for id_, m in zip(ids[k > 0].tolist(), k[k > 0].tolist(), strict=True):
            out[id_] = out.get(id_, 0) + m
    return out


def link_counts(sets: DataFrame, at_least: float, work: Workspace) -> DataFrame:
    """(id, n_links) of the ``sets`` (id, shingles array<long>; ids distinct) that are similar to another one."""
    ordered, held = prefixes(sets, at_least, work)
    held = work.table(held, "held", clean=True)
    groups = held.groupBy("s").agg(F.count("*").alias("m")).filter("m > 1").select("s", F.ceil(F.col("m") / SETS_MOST).cast("int").alias("k"))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, x, y, left, right = (batch.column(c)[r].as_py() for c in ("s", "x", "y", "left", "right"))
                if left and right and (found := sorted(_has_partner(left, right, x == y, s, at_least))):  # a chunk may be empty
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(found), pa.int64()), pa.array(found, pa.int64())], ["s", "id"])

    first = chunk_pairs(held, groups, ["id", "n", "i", "sketch", "before"]).mapInArrow(partners, "s long, id long").distinct()
    first = work.table(first.join(held.select("s", "id", "n", "i"), ["s", "id"]), "partners", clean=True)
    weights = first.groupBy("s").agg(F.ceil(F.sum("n") / ELEMENTS_MOST).cast("int").alias("k"))
    rows = first.join(ordered.select(F.col("id").alias("_id"), "o"), F.col("id") == F.col("_id")).select("s", "id", "n", "i", "o")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, x, y, left, right = (batch.column(c)[r].as_py() for c in ("s", "x", "y", "left", "right"))
                if left and right and (found := _counts(left, right, x == y, s, at_least)):
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["id", "n"])

    pairs = chunk_pairs(rows, weights, ["id", "n", "i", "o"]).mapInArrow(verified, "id long, n long")
    return pairs.groupBy("id").agg(F.sum("n").alias("n_links"))
