"""Counts of words and of neighbouring words, whose distinct values may be as many as the words of all texts.

A map of what a task has seen would grow with its split, so counts are made a piece of bounded words at a time, and
rows of the pieces meet in partitions whose number follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a piece (one row at least), and bytes of text aimed at in a partition of the counts.
PIECE_WORDS, PART_BYTES = 400_000, 32 << 20


def parts_of(docs: DataFrame, text: str = "text") -> int:
    """Partitions for what texts hold."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(1, -(-size // PART_BYTES))


def _pieces(batches: Iterator[pa.RecordBatch], words: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + PIECE_WORDS, "right")))
            yield batch.slice(start, end - start)
            start = end


def _pairs(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Joined neighbours of all lists, and the row of each."""
    flat, row = column.flatten(), pc.list_parent_indices(column).to_numpy()
    same = row[1:] == row[:-1]
    keep = pa.array(same)
    return pc.binary_join_element_wise(flat[:-1].filter(keep), flat[1:].filter(keep), " "), row[1:][same]


def pair_counts(docs: DataFrame, words: Column, text: str = "text") -> DataFrame:
    """(pair, n) of neighbours in the ``words`` (an array made of the text) of all rows of ``docs``; null arrays have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, "w"):
            found = pc.value_counts(_pairs(piece.column("w"))[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["pair", "n"])

    counted = docs.select(words.alias("w")).mapInArrow(run, "pair string, n long")
    return counted.repartition(parts_of(docs, text), "pair").groupBy("pair").agg(F.sum("n").alias("n"))


def term_classes(docs: DataFrame, words: Column, label: Column, parts: int) -> DataFrame:
    """(kind, term, low_df, high_df): rows of label 0 and 1 that hold each token and each bigram of their ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, "w"):
            column, labels = piece.column("w"), pc.fill_null(piece.column("label"), -1).to_numpy()
            tokens = column.flatten(), pc.list_parent_indices(column).to_numpy()
            for kind, (terms, row) in (("token", tokens), ("bigram", _pairs(column))):
                coded = terms.dictionary_encode()
                n = len(coded.dictionary)
                if not n:
                    continue
                held = np.unique(row.astype(np.int64) * n + coded.indices.to_numpy())  # once a row
                row, code = held // n, held % n
                low, high = (np.bincount(code[labels[row] == k], minlength=n) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n), coded.dictionary, pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["kind", "term", "low_df", "high_df"])

    counted = docs.select(words.alias("w"), label.cast("long").alias("label")).mapInArrow(run, "kind string, term string, low_df long, high_df long")
    return counted.repartition(parts, "kind", "term").groupBy("kind", "term").agg(F.sum("low_df").alias("low_df"), F.sum("high_df").alias("high_df"))
