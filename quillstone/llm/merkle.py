"""Merkle manifest of a dataset: a tree a group and one over the groups' roots, built level by level with windows.

A node is its place (from 0) in its group and its digest. A level's rows are windowed by (group, place div FAN_OUT): the
ordered list over the full frame is the parent's preimage and holds each row's siblings as well. Parents are
deduplicated and written before the next level is built from them. Digests go up, and paths come down: a node's path
to the root is its own siblings before its parent's path, so each level is joined with the one above by the key that
its window has, which is spread evenly whatever the sizes of the groups.

Places come from a sort by ranges: a row's place in its part, after the rows of its group in the parts before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, col

FAN_OUT = 16
#: Documents whose crc32 this divides are tampered with in the proof.
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _frame(value: Column) -> Column:
    """A field of a leaf's preimage: its length in bytes, a colon and its value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_frame(f).cast("binary") for f in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], work: Workspace) -> DataFrame:
    """``rows`` with g (a number a group, ascending as the groups do), i (the place in it, from 0) and n (its size).

    ``order`` begins with the group's columns, nulls first. Rows are sorted by ranges; only a count for each part and
    group that meet is added up further, so no group, whatever its size, comes into one task.
    """
    number = F.monotonically_increasing_id()  # the part in the upper bits, the row in it in the lower 33
    split = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", number)
    split = work.table(split.withColumns({"_part": F.shiftright("_m", 33), "_row": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"), "sorted")
    keys = [col(c) for c in group]
    meets = split.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_row").alias("_least"))
    sizes = meets.groupBy("_part").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a number a part
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a group has a row a part at most
    earlier = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = meets.join(offsets, F.col("_part") == F.col("_p")).select(
        "_p",
        *[k.alias(f"_g{j}") for j, k in enumerate(keys)],
        "_least",
        F.min(F.col("_offset") + F.col("_least")).over(inside).alias("g"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(inside).alias("n"),
    )
    same = F.col("_part") == F.col("_p")
    for j, k in enumerate(keys):
        same &= k.eqNullSafe(F.col(f"_g{j}"))
    joined = split.join(found, same).withColumn("i", F.col("_start") + F.col("_row") - F.col("_least"))
    return joined.drop("_part", "_row", "_p", "_least", "_start", *[f"_g{j}" for j in range(len(keys))])


def _run(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, i, h) with p, the place of the parent, and run: the digests of the parent's children in order."""
    nodes = nodes.withColumn("p", F.floor(F.col("i") / FAN_OUT))
    full = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("h").over(full))


def levels(nodes: DataFrame, work: Workspace) -> list[DataFrame]:
    """The nodes (g, i, n, h) of each level; a group ends at the level where it has one node, its root."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        parents = _run(out[-1].filter("n > 1")).select("g", F.col("p").alias("i"), F.ceil(F.col("n") / FAN_OUT).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("h"))
        out.append(work.table(parents.dropDuplicates(["g", "i"]), "level"))
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """(g, root) of each group."""
    out = tree[0].filter("n = 1").select("g", F.col("h").alias("root"))
    for nodes in tree[1:]:
        out = out.union(nodes.filter("n = 1").select("g", F.col("h").alias("root")))
    return out


def paths(tree: list[DataFrame], tops: DataFrame | None = None) -> DataFrame:
    """The lowest level's rows with path, and what ``tops`` (g, path and others; one row a group) says of their groups.

    A path is an array of struct<left, right>, from the lowest level up: the joined digests of the siblings on either
    side. ``tops`` has what follows above a group's root. Each level meets the one above by (g, p).
    """
    if tops is None:
        tops = roots(tree).withColumn("path", F.expr(f"cast(array() as {_PATH})"))
    tops = tops.withColumnRenamed("g", "_g")
    more = [c for c in tops.columns if c not in ("_g", "path")]
    upper: DataFrame | None = None
    for nodes in reversed(tree):
        own = nodes.columns
        found = nodes.filter("n = 1").join(tops, F.col("g") == F.col("_g")).select(*own, "path", *more)
        if upper is not None:
            at = (F.col("i") % FAN_OUT).cast("int")
            side = lambda a, n: F.array_join(F.slice("run", a, n), "")
            step = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.greatest(F.size("run") - at - 1, F.lit(0))).alias("right"))
            above = upper.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_path"), *more)
            many = _run(nodes.filter("n > 1")).join(above, (F.col("g") == F.col("_g")) & (F.col("p") == F.col("_i")))
            found = found.unionByName(many.select(*own, F.concat(F.array(step), F.col("_path")).alias("path"), *more))
        upper = found
    return upper


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, group: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    ``docs`` has doc_id, text, the group's column and the other ``fields``; columns beside them are ignored. Each field
    may be null, which its leaf tells from an empty value. Groups come in the order of their value, a null group first;
    leaves by doc_id (null first), rows of one doc_id by their leaf, so repeated rows are leaves of their own, one after
    another, and all have the same outcome but for their siblings. A lone leaf is its group's root, a lone group's root
    the root of all. An empty table gives an empty one.

    The proof is tried with a text whose A-Z are lower-cased where TAMPER_EVERY divides crc32(doc_id): it fails then,
    unless the text had none.
    """
    work = Workspace(docs.sparkSession, "merkle")
    tampered = [lower_ascii(col(f).cast("string")) if f == "text" else col(f) for f in fields]
    try_it = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPER_EVERY == 0
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), col(group).alias("grp"), leaf_digest([col(f) for f in fields]).alias("h"), F.when(try_it, leaf_digest(tampered)).alias("tampered"))
    base = work.table(base, "leaves")
    leaves = placed(base, ["grp"], [F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("h")], work)
    leaves = work.table(leaves.select("g", "i", "n", "doc_id", "h", "tampered"), "placed")
    tree = levels(leaves, work)
    groups = work.table(roots(tree), "roots")
    tops = placed(groups.withColumnRenamed("g", "grp"), [], [F.col("grp")], work)
    top_tree = levels(work.table(tops.withColumnRenamed("root", "h"), "groups"), work)
    # a group's path above its own root, under the group's number
    above = paths(top_tree).select(F.col("grp").alias("g"), "path", F.col("h").alias("subroot"), "root")
    out = paths(tree, work.table(above, "above"))
    folded = fold(F.coalesce("tampered", "h"), F.col("path"))
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(most_levels: int = 8) -> str:
    """SQL for :func:`manifest`; its levels are written out, as a level is an aggregate over the one below."""
    frame = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(frame(text if f == "text" else f"cast({f} AS VARCHAR)") for f in FIELDS) + ")"
    shifts = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, (d & 1) * 3988292384))"
    codes = "list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {shifts}), 4294967295)"
    parts = [
        f"""leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, h) - 1 AS i FROM (
  SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN {crc} % {TAMPER_EVERY} = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents)), a0 AS (SELECT source AS g, i, h FROM leaves)"""
    ]
    climb = lambda a, b: f"""{b}r AS (SELECT g, i // {FAN_OUT} AS p, list(h ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {a}) GROUP BY 1, 2),
{b} AS (SELECT g, p AS i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {b}r)"""  # noqa: E731
    parts += [climb(f"a{k}", f"a{k + 1}") for k in range(most_levels)]
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS source FROM a{most_levels})")
    parts += [climb(f"b{k}", f"b{k + 1}") for k in range(most_levels)]
    walk = lambda before, runs, on, after: f"""{after} AS (SELECT x.* REPLACE (x.i // {FAN_OUT} AS i,
    x.proof || CASE WHEN r.n = 1 THEN '' ELSE array_to_string(list_concat(r.run[:x.i % {FAN_OUT}], r.run[x.i % {FAN_OUT} + 2:]), '') END AS proof,
    CASE WHEN r.n = 1 THEN x.y ELSE sha256(array_to_string(list_concat(list_append(r.run[:x.i % {FAN_OUT}], x.y), r.run[x.i % {FAN_OUT} + 2:]), '')) END AS y)
  FROM {before} x JOIN {runs} r ON {on} AND r.p = x.i // {FAN_OUT})"""  # noqa: E731
    parts.append("w0 AS (SELECT doc_id, source, h AS leaf, i, '' AS proof, coalesce(tampered, h) AS y FROM leaves)")
    parts += [walk(f"w{k}", f"a{k + 1}r", "r.g IS NOT DISTINCT FROM x.source", f"w{k + 1}") for k in range(most_levels)]
    parts.append(f"v0 AS (SELECT w.doc_id, w.source, w.leaf, b.h AS subroot, b.i, w.proof, w.y FROM w{most_levels} w JOIN b0 b ON b.source IS NOT DISTINCT FROM w.source)")
    parts += [walk(f"v{k}", f"b{k + 1}r", "true", f"v{k + 1}") for k in range(most_levels)]
    return f"""WITH {', '.join(parts)}
SELECT v.doc_id, v.leaf, v.subroot, t.h AS root, sha256(v.proof) AS proof_sha256, v.y AS folded_root, v.y = t.h AS verified FROM v{most_levels} v, b{most_levels} t"""


ORACLE_SQL = _oracle()
