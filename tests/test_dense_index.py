"""Cells with exact bounds against a search of all rows."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import dense_index, search


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


def test_rows_are_those_of_a_full_search(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 600)] + rng.normal(0, 0.3, (600, 8)), np.zeros((3, 8)), np.repeat(centres[:1], 20, axis=0)])
    base = frame(spark, x).unionByName(spark.createDataFrame([(9000, None, 1), (None, [1.0] * 8, 1), (9001, [None] + [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int"))
    clean = base.filter("vec_id < 9000")
    index = dense_index.CellIndex.build(base.repartition(3), str(tmp_path / "a"))
    queries = clean.filter("vec_id % 9 = 0").unionByName(frame(spark, rng.normal(0, 4, (5, 8)), 5000))
    assert rows(index.topk(queries, 4)) == rows(search.inner_product_topk(clean, queries, 4))
    read = index.cells_read(queries, 4)
    share = read.agg(F.sum("n_read") / F.sum("n_cells")).first()[0]
    assert 0 < share < 0.5
    assert index.topk(queries.limit(0), 4).count() == 0


def test_few_rows_and_none(spark, tmp_path):
    base = frame(spark, np.eye(3))
    index = dense_index.CellIndex.build(base, str(tmp_path / "b"))
    assert rows(index.topk(base, 5)) == rows(search.inner_product_topk(base, base, 5))
    empty = dense_index.CellIndex.build(base.limit(0), str(tmp_path / "c"))
    assert empty.topk(base, 5).count() == 0
