"""Greedy suppression of near vectors against a plain loop."""

import numpy as np

import __spark_entry__ as entry


def plain(ids, x, at_least):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near, kept = unit @ unit.T >= at_least, np.ones(len(ids), bool)
    for i in range(len(ids)):
        if kept[i]:
            kept[i + 1 :] &= ~near[i, i + 1 :]
    return {v: (bool(k), int(n.sum() - n[i])) for i, (v, k, n) in enumerate(zip(ids, kept, near, strict=True))}


def test_a_suppressed_row_suppresses_none(spark, tmp_path):
    rng = np.random.default_rng(3)
    angle = np.concatenate([np.arange(0, 5, 0.3), rng.uniform(0, 6.2, 60)])  # a chain of neighbours and random ones
    x = np.stack([np.cos(angle), np.sin(angle), np.repeat([0.0, 3.0], [40, len(angle) - 40])], 1)
    x = np.concatenate([x, x[5:9], x[5:9], np.zeros((2, 3))])
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["semantic_dedup"](spark, str(tmp_path)).collect()
    assert {r.vec_id: (r.kept, r.n_links) for r in got} == plain([r[0] for r in rows], x, 0.92) and len(got) == len(rows)
    first = {}
    assert all(r.class_id == first.setdefault(tuple(x[r.vec_id // 3]), r.vec_id) or not any(x[r.vec_id // 3]) for r in sorted(got))
