"""Exact dense search over an inverted-file index: vectors lie in cells, and cells that can't matter are not read.

Centroids are fitted to a bounded sample (the SAMPLE_MOST rows of smallest id hash); every row goes to the cell of its
nearest centroid, and a cell knows its radius, the largest distance of a row from the centroid. By the triangle
inequality no row of a cell has a larger inner product with q than q.c + |q| r. The cells of the largest bounds are read
first; the k-th best score there is a floor, and of the other cells only those whose bound reaches it are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import top

#: Rows that centroids are fitted to, cells at most, and rounds of fitting.
SAMPLE_MOST, CELLS_MOST, ROUNDS = 20_000, 1024, 10
#: Bytes of queries that every worker may hold.
QUERY_BYTES = 256 << 20
#: Cells of a query that are read before there is a floor.
FIRST_CELLS = 2
#: Scores are rounded to five digits.
SLACK = 2e-5


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids by k-means; the same for the same sample. An empty cell keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].astype(np.float64)
    for _ in range(ROUNDS):
        near = nearest(sample, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance from it."""
    near = np.concatenate([((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


class CellIndex:
    """An index of (vec_id, embedding) below ``path``; rows with a null in either, or in a vector, are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, base: DataFrame, path: str) -> CellIndex:
        """Fit the cells, deal every row into one, and write the rows by cell and the cells with their radii."""
        made = cls(base.sparkSession, path)
        rows = base.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_MOST).collect()
        sample = _matrix([r.embedding for r in picked])
        centres = fit_centroids(sample, min(CELLS_MOST, max(1, int(2 * np.sqrt(len(sample)))))) if len(sample) else np.zeros((0, 0))
        shared = base.sparkSession.sparkContext.broadcast(centres)  # CELLS_MOST vectors at most

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, apart = nearest(_matrix(batch.column("embedding").to_pylist()), shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], ["vec_id", "embedding", "cell", "apart"])

        dealt = rows.mapInArrow(deal, "vec_id long, embedding array<double>, cell int, apart double")
        dealt.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.parquet(f"{made.path}/rows")
        radii = base.sparkSession.read.parquet(f"{made.path}/rows").groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
        held = base.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        radii.join(F.broadcast(held), "cell").coalesce(1).write.parquet(f"{made.path}/cells")
        return made

    def _queries(self, queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of the queries, whose bytes are checked before they come to the driver."""
        rows = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
        size = rows.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0)).alias("b")).first().b
        if size > QUERY_BYTES:
            raise ValueError(f"queries of {size} bytes; give them in blocks of {QUERY_BYTES}")
        found = rows.orderBy("vec_id").collect()
        return np.array([r.vec_id for r in found], np.int64), _matrix([r.embedding for r in found])

    def _scored(self, ids: np.ndarray, vectors: np.ndarray, asks: dict[int, np.ndarray], k: int) -> DataFrame:
        """The k best rows a query among the cells that it asks for (cell -> places of queries), with all ties."""
        shared = self.spark.sparkContext.broadcast((ids, vectors, asks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, asks = shared.value
            for batch in batches:
                cells, rows, x = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), None
                for cell in np.unique(cells):
                    if (who := asks.get(int(cell))) is None:
                        continue
                    x = _matrix(batch.column("embedding").to_pylist()) if x is None else x
                    here = np.flatnonzero(cells == cell)
                    for a in range(0, len(who), 1024):
                        part = who[a : a + 1024]
                        dots = vectors[part] @ x[here].T
                        dots[ids[part][:, None] == rows[here]] = -np.inf
                        floor = np.partition(dots, -k, axis=1)[:, -k] - SLACK if len(here) > k else np.full(len(part), -np.inf)
                        q, r = np.nonzero((dots >= floor[:, None]) & np.isfinite(dots))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][q]), pa.array(rows[here][r]), pa.array(dots[q, r])], ["query_id", "doc_id", "dot"])

        table = self.spark.read.schema("vec_id long, embedding array<double>, cell int").parquet(f"{self.path}/rows")
        wanted = table.filter(F.col("cell").isin(sorted(asks))) if len(asks) <= CELLS_MOST else table
        found = wanted.mapInArrow(run, "query_id long, doc_id long, dot double")
        return top(found.select("query_id", "doc_id", F.round("dot", 5).alias("score")), k)

    def _plan(self, queries: DataFrame, k: int) -> tuple:
        ids, vectors = self._queries(queries)
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # CELLS_MOST rows at most
        centres = _matrix([c.centre for c in cells])
        names, radii = np.array([c.cell for c in cells], np.int64), np.array([c.radius for c in cells])
        bound = vectors @ centres.T + np.linalg.norm(vectors, axis=1)[:, None] * radii if len(ids) and len(cells) else np.zeros((len(ids), len(cells)))
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_CELLS]
        asks = {int(names[j]): np.flatnonzero((first == j).any(axis=1)) for j in np.unique(first)} if first.size else {}
        floors = {r.query_id: r.score for r in self._scored(ids, vectors, asks, k).filter(F.col("rank") == k).collect()} if asks else {}  # a number a query
        floor = np.array([floors.get(int(i), -np.inf) for i in ids])
        needed = bound >= floor[:, None] - SLACK if len(ids) else np.zeros(bound.shape, bool)
        if first.size:
            np.put_along_axis(needed, first, True, axis=1)
        return ids, vectors, names, needed, np.array([c.n for c in cells], np.int64)

    def cells_read(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, n_cells, n_read, rows_read): how much of the index a query takes."""
        ids, _, names, needed, n = self._plan(queries, k)
        rows = [(int(i), len(names), int(m.sum()), int(n[m].sum())) for i, m in zip(ids, needed, strict=True)]
        return self.spark.createDataFrame(rows, "query_id long, n_cells int, n_read int, rows_read long")

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best rows a query vector other than itself, as :func:`.search.inner_product_topk`."""
        ids, vectors, names, needed, _ = self._plan(queries, k)
        asks = {int(names[j]): np.flatnonzero(needed[:, j]) for j in range(len(names)) if needed[:, j].any()}
        return self._scored(ids, vectors, asks, k)
