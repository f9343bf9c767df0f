"""SimHash near-dedup: 64-bit fingerprints linked by a binary-trie self-join.

Method: fingerprints are leaves of a binary trie (a sorted array; a node is a range that shares its upper bits). Node
pairs are walked together, differing bits are added up and a pair is pruned once more than ``max_bits`` differ. The
trie is cut into sub-tries that fit a task by the pigeonhole rule: of k blocks of the 64 bits at most ``max_bits`` can
differ, so two linked fingerprints agree on some choice of k - max_bits blocks; k follows the number of fingerprints,
which keeps groups short at every size and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Workspace, as_bytes, hot_join, small_batches, whole_row
from .components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints aimed at in a group, the most in one task's group before it is dealt as pairs of chunks, rows in a task.
GROUP, GROUP_MOST, TASK_ROWS = 64, 20_000, 200_000
_FRONTIER = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; no words (or null): 0. A bit is 1 if over half of the shingles' XXH64 have it.

    Bytes are lower-cased A-Z and cut at the bytes 09-0D and 20; fewer words than a shingle make one shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # one hash: over half of one is the hash itself
    ones, step, total = np.zeros(64, np.int64), 1 << 16, len(words) - shingle + 1
    for at in range(0, total, step):
        part = words[at : at + step + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(part) - shingle + 1)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(prints.view(np.int64))], ["doc_id", "mark", "fp"])


class _Labels:
    """Union-find over the rows of one task, as an array of roots, with a quick test for ranges of one label."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)
        self.turns = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
        self.turns = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))

    def one(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Pairs of ranges whose leaves all carry one label: nothing left to link there."""
        return (self.root[alo] == self.root[blo]) & (self.turns[alo] == self.turns[ahi - 1]) & (self.turns[blo] == self.turns[bhi - 1])


def trie_links(group: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (row, root) that span, group by group, the components of fingerprints at most ``max_bits`` apart.

    ``group`` and ``prints`` are sorted by (group, fingerprint) and hold no repeats. The walk goes down level by
    level over slices of node pairs, deepest slice first, so dense clusters unite early and the rest of their pairs
    is pruned: no list of all pairs of a cluster is ever made.
    """
    n = len(prints)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    labels = _Labels(n)
    zeros = np.zeros((64, n + 1), np.int32)
    for bit in range(64):
        np.cumsum(((prints >> np.uint64(63 - bit)) & np.uint64(1)) == 0, out=zeros[bit, 1:])
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    s, e = starts[big].astype(np.int64), ends[big].astype(np.int64)
    stack = [(0, s, e, s, e, np.zeros(len(s), np.int8))]
    while stack:
        level, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > _FRONTIER:
            cut = len(alo) // 2
            stack.append((level, *(x[:cut] for x in (alo, ahi, blo, bhi, d))))
            stack.append((level, *(x[cut:] for x in (alo, ahi, blo, bhi, d))))
            continue
        # pairs of single leaves are settled at once: the path below them has no branches
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (np.bitwise_count(prints[a] ^ prints[b]) <= max_bits) & (a != b)
            if near.any():
                labels.link(a[near], b[near])
        go = ~leaf & ~labels.one(alo, ahi, blo, bhi)
        if level == 64 or not go.any():
            continue
        alo, ahi, blo, bhi, d = alo[go], ahi[go], blo[go], bhi[go], d[go]
        z = zeros[level]
        amid, bmid = alo + (z[ahi] - z[alo]), blo + (z[bhi] - z[blo])
        other = alo != blo
        parts = [
            (amid[other], ahi[other], blo[other], bmid[other], d[other] + 1),
            (alo, amid, bmid, bhi, d + 1),
            (alo, amid, blo, bmid, d),
            (amid, ahi, bmid, bhi, d),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        ok = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= max_bits) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        stack.append((level + 1, *(x[ok] for x in nxt)))
    moved = np.flatnonzero(labels.root != np.arange(n))
    return moved, labels.root[moved]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("g").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        g, fp = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]).view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        if len(g) > 1:
            keep = np.concatenate(([True], (g[1:] != g[:-1]) | (fp[1:] != fp[:-1])))
            g, fp = g[keep], fp[keep]
        a, b = trie_links(g, fp, max_bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["u", "v"])

    return run


def block_masks(n: int, max_bits: int = MAX_BITS, group: int = GROUP) -> list[int]:
    """Bit masks, one a table: linked fingerprints agree under at least one of them; expected groups hold ``group`` or fewer."""
    for k in range(max_bits + 1, 4 * max_bits + 1):
        if n / 2.0 ** (64 * (k - max_bits) / k) <= group:
            break
    cuts = [round(64 * i / k) for i in range(k + 1)]
    blocks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(k)]
    return [sum(c) for c in combinations(blocks, k - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_prints(prints: DataFrame, n: int, work: Workspace, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links of the distinct fingerprints ``fp`` (n rows) that span every component of links within ``max_bits``."""
    masks = block_masks(n, max_bits)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("b")) for t, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("fp", F.xxhash64("k.t", "k.b").alias("g"))  # equal hashes of other groups only add comparisons
    if n > GROUP_MOST:  # only then can a group be over it; such groups are dealt out as pairs of chunks
        heavy = keyed.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > GROUP_MOST)
        heavy = work.table(heavy.select("g", F.ceil(F.col("c") / (GROUP_MOST // 2)).cast("int").alias("chunks")), "heavy")
        if heavy.take(1):
            keyed = keyed.join(heavy, "g", "left")
            mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks").cast("long"))
            pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.xxhash64("g", F.least(i.cast("long"), mine), F.greatest(i.cast("long"), mine)))
            keyed = keyed.select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("g")).otherwise(pairs)).alias("g"))
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // TASK_ROWS))
    found = keyed.repartition(tasks, "g").mapInArrow(_links(max_bits), "u long, v long")
    return found.distinct()


def _grouped(docs: DataFrame, max_bits: int, work: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """(rows, groups, number of rows): (doc_id, mark, fp) a row of ``docs``; (fp, n, component_id, first) a fingerprint.

    mark is a hash of the text. first is the (doc_id, mark) that comes first in the component, component_id its doc_id.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    rows = work.table(marked.mapInArrow(_prints, "doc_id long, mark long, fp long"), "prints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    groups = work.table(rows.groupBy("fp").agg(first.alias("rep"), F.count("*").alias("n")), "groups")
    total, n = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    linked = work.table(components(link_prints(groups.select("fp"), n, work, max_bits), work), "linked")
    named = linked.join(groups.select(F.col("fp").alias("node"), "rep"), "node")
    roots = work.table(named.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("c")), "roots")
    names = hot_join(named, roots, "root", F.col("c") * HOT_SHARE >= max(n, 1), ["first"]).select(F.col("node").alias("fp"), F.col("first").alias("linked"))
    named_groups = groups.join(names, "fp", "left").select("fp", "n", F.coalesce("linked", "rep").alias("first"))
    return rows, work.table(named_groups.withColumn("component_id", F.col("first.doc_id")), "named"), total


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links, the row's own included. Null or blank texts have
    fingerprint 0 and link like any other. Rows with a null doc_id keep it and take their component's id (null if it
    has no other). Repeated rows give repeated results; an empty table gives an empty one.
    """
    rows, groups, total = _grouped(docs, max_bits, Workspace(docs.sparkSession, "simhash"))
    return hot_join(rows, groups, "fp", F.col("n") * HOT_SHARE >= max(total, 1), ["component_id"]).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` with one row of each group left: that with the smallest doc_id (of several, with the smallest hash of its text).

    Rows are told apart by doc_id and text, so two different texts of one doc_id lose none that is no copy; repeated
    rows are brought to one. Rows with a null doc_id can't be named by a group and all stay.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    rows, groups, total = _grouped(docs, max_bits, work)
    found = hot_join(rows, groups, "fp", F.col("n") * HOT_SHARE >= max(total, 1), ["first"]).filter("doc_id is not null")
    mine = F.struct("doc_id", "mark")
    drop = found.filter(mine != F.col("first")).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    packed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    kept = packed.join(drop, (F.col("id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_anti")
    if rows.filter("doc_id is not null").groupBy("doc_id", "mark").count().filter("count > 1").take(1):
        kept = kept.filter("id is not null").dropDuplicates(["id", "mark"]).unionByName(kept.filter("id is null"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
