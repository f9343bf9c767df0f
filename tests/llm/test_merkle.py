"""Merkle manifests against a plain recursive version, and against SQL on the given tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from quillstone.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def tree(nodes):
    """(root, siblings of each leaf by level as (left, right))."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for a in range(0, len(nodes), merkle.FAN_OUT):
            run = nodes[a : a + merkle.FAN_OUT]
            for k in range(len(run)):
                for i in owners[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            up_owners.append([i for o in owners[a : a + merkle.FAN_OUT] for i in o])
        nodes, owners = up, up_owners
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, leaf(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([h for _, h in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (r, h), path in zip(groups[s], trees[s][1], strict=True):
            y = h
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                y = leaf(*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            steps = path + top
            for left, right in steps:
                y = H(left, y, right)
            out.append((r[0], h, trees[s][0], root, H(*[a + b for a, b in steps]), y, y == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def got(spark, rows, parts=3):
    return sorted(map(tuple, merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, n int").repartition(parts)).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_one_group_of_any_size(spark, n):
    rows = [(i * 3 % 1009, "s", "en", i, f"Text {i}") for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_groups_nulls_repeats_and_odd_texts(spark):
    rows = [(i, f"source-{i % 40}", "en", None, f"Straße ÀÉ {i}") for i in range(90)]
    rows += [(1000 + i, None, None, 3, None) for i in range(20)] + [(2000, "", "", 0, ""), (2001, "", None, 0, "A" * 200_000), (None, "z", "en", 1, "NOBODY"), (None, "z", "en", 1, "NOBODY")]
    rows += [(3, "hot", "de", i, "SAME") for i in range(400)] + [(3, "hot", "de", 1, "SAME")] * 20 + [(-5, "Ünï", "x", 1, "Y"), (-5, "zz", "x", 1, "Y")]
    assert got(spark, rows, 5) == plain(rows)
    outcome = {r[-1] for r in got(spark, rows)}
    assert outcome == {True, False}


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(merkle.ORACLE_SQL)
    names = [c[0] for c in want.description]
    found = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
