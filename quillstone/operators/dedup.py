"""Exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, duplicate_key
from ..functions.text import ngrams, similarity_text
from ..shared import HOT_SHARE, Workspace, hot_join, small_batches
from . import setjoin

#: Grams of items that may be broadcast.
GRAMS_MOST = 1_000_000
#: Ids of documents that may be broadcast.
IDS_MOST = 1_000_000
#: Shingles are counted in 1/PART of the range of hashes, by hashes less BITS_OFF bits, and add up over ELEMENTS_MOST of them before they move.
PART, BITS_OFF, ELEMENTS_MOST = 3, 24, 500_000


def first_of(docs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, n): the smallest ``order`` of each key. Adds up before the shuffle, so hot keys cost a row a task."""
    return docs.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, first, n) of texts that occur more than once."""
    return first_of(docs.select("doc_id", content_hash(F.col("text")).alias("content_hash")), "content_hash", "doc_id").filter("n > 1")


def quick_duplicates(docs: DataFrame) -> DataFrame:
    return first_of(docs.select("doc_id", duplicate_key(F.col("text")).alias("dup_key")), "dup_key", "doc_id").filter("n > 1")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_of(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words, ascending; of fewer words all are one run."""
    words = word_hashes(text.split())
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _set_key(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def _lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def shingle_keys(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, key, n, part): a key of equal sets of word shingles, their number and the shortened hashes of those in the first 1/PART of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in small_batches(batches, "text", 2 << 20):
            sets = [shingles_of(t.encode(), size) if t else np.zeros(0, np.int64) for t in piece.column("text").to_pylist()]
            hashes = [x.view(np.uint64) for x in sets]
            parts = [np.unique(h[h < np.uint64(2**64 // PART)] >> np.uint64(BITS_OFF)).astype(np.int64) for h in hashes]
            keys = pa.array(map(_set_key, sets), pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), keys, pa.array(map(len, sets), pa.int32()), _lists(parts)], ["doc_id", "key", "n", "part"])

    return docs.select("doc_id", similarity_text("text").alias("text")).mapInArrow(run, "doc_id long, key string, n int, part array<long>")


def alone_counts(parts: DataFrame, elements: int) -> DataFrame:
    """(i, alone): how many elements of ``parts`` (i, part) only rows of this i have, where there are any; there are about ``elements``.

    Elements of a piece add up to their smallest and largest i in Python, and meet as these: hardly any is there twice, so an
    aggregate of Spark before the shuffle would hold and spill nearly all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lists = batch.column("i").to_numpy(), batch.column("part")
            ends, start = np.cumsum(pc.list_value_length(lists).to_numpy()), 0
            while start < len(of):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ELEMENTS_MOST, "right")))
                piece = lists.slice(start, stop - start)
                s, i = piece.flatten().to_numpy(), np.repeat(of[start:stop], pc.list_value_length(piece).to_numpy())
                start = stop
                if not len(s):
                    continue
                order = np.lexsort((i, s))
                edge = np.concatenate([[True], np.diff(s[order]) != 0, [True]])
                pick = np.sort(order[edge[:-1] | edge[1:]])  # in the order of the rows, where i repeats
                yield pa.RecordBatch.from_arrays([pa.array(s[pick]), pa.array(i[pick])], ["s", "i"])

    n = max(8, -(-elements // ELEMENTS_MOST))
    held = parts.mapInArrow(run, "s long, i long").repartition(n, "s").groupBy("s").agg(F.min("i").alias("i"), F.max("i").alias("last"))
    return held.filter("i = last").groupBy("i").agg(F.count("*").alias("alone"))


def shingles_of_classes(docs: DataFrame, classes: DataFrame, size: int = 5) -> DataFrame:
    """(id, shingles): hashed word shingles, sorted, of the documents that name the ``classes`` (class_id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in small_batches(batches, "text", 2 << 20):
            ids, sets = [], []
            for id_, text, key in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "key")), strict=True):
                found = shingles_of(text.encode(), size) if text else np.zeros(0, np.int64)
                if _set_key(found) == key:  # another text may have the same doc_id
                    ids.append(id_)
                    sets.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets)], ["id", "shingles"])

    if classes.count() <= IDS_MOST:  # then texts are not moved
        classes = F.broadcast(classes)
    named = docs.join(classes, F.col("doc_id") == F.col("class_id")).select("doc_id", similarity_text("text").alias("text"), "key")
    return named.mapInArrow(run, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, at_least: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, class_id, n_links): documents of equal shingle sets are a class, named by its smallest doc_id.

    n_links is the number of other classes with a Jaccard similarity of ``at_least``. Exact; see :mod:`.setjoin`. Copies
    are never expanded, and sets without shingles have no links.

    A set of n shingles that is similar to another one has n - ceil(t n) at most that no other set has. Most texts have
    more of these in a part of the range of hashes alone, so only such a part of the shingles is moved for all sets, and
    all shingles for those that may have links. Shortened hashes that meet only make a set stay.
    """
    work = Workspace(docs.sparkSession, "near-duplicates")
    parts = work.table(shingle_keys(docs, size), "parts", clean=True)
    rows = work.table(parts.select("doc_id", "key"), "keys", clean=True)
    set_id = F.xxhash64("key")
    classes = parts.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.min("n").alias("n"), F.count("*").alias("n_docs"))
    classes = work.table(classes.withColumn("set_id", set_id), "classes", clean=True)
    elements = classes.agg(F.sum(F.col("n") * F.col("n_docs"))).first()[0] or 0
    alone = alone_counts(parts.select(set_id.alias("i"), "part"), elements // PART)
    may = F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least) - F.lit(1e-9))
    possible = classes.filter("n > 0").join(alone, F.col("set_id") == F.col("i"), "left").filter(may).select("class_id", "key")
    possible = work.table(possible, "possible", clean=True)
    work.drop(parts)
    sets = shingles_of_classes(docs, possible, size)
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates()
    sets = work.table(sets, "sets", clean=True)
    counts = setjoin.link_counts(sets, at_least, work)
    named = classes.join(counts.withColumnRenamed("id", "_id"), F.col("class_id") == F.col("_id"), "left")
    named = named.select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_docs")
    size_of = rows.count()
    return hot_join(rows, named, "key", F.col("n_docs") * HOT_SHARE >= size_of, ["class_id", "n_links"]).select("doc_id", "class_id", "n_links")


def overlap(docs: DataFrame, items: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, item_id, n_shared) of documents that hold word ``size``-grams of an item.

    The items' grams are distinct before the join, so a gram that many documents hold meets each item once.
    """
    grams = lambda text: F.array_distinct(ngrams(F.filter(F.split(similarity_text(text), " "), lambda w: w != ""), size))
    d = docs.select("doc_id", F.explode(grams("text")).alias("g"))
    i = items.select("item_id", F.explode(grams("text")).alias("g"))
    if i.limit(GRAMS_MOST + 1).count() <= GRAMS_MOST:  # reads the items alone; then only grams that match are moved
        i = F.broadcast(i)
    return d.join(i, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
