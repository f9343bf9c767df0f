"""Substring dedup on sliding spans of sentences, with their edges to the word.

A text is cut into sentences. A span is the shortest run of SPAN_SENTENCES sentences or more, from any sentence on, that
holds SPAN_WORDS words. Every span is hashed and spans meet globally; its first place is the one with the smallest
(doc_id, word), and sentences that a span in any other place covers are removed.

Passages also begin and end inside sentences, or repeat a part of a single long one. So a second pass slides by words:
runs of SPAN_WORDS words that are found more than once lose the words in all but their first place. It takes the edges
on either side of repeated sentences and passages that hold no span, and leaves shorter repeats alone.

Both passes share one candidate search. The anchor of a run of SPAN_WORDS words is the run of ANCHOR_WORDS words in it
with the smallest hash, the last of equal ones; equal runs have equal anchors. Runs that follow each other and share an
anchor are one segment, a row. Segments whose anchor is found once hold no repeat; spans of sentences that touch such a
segment can't repeat and are not hashed. Of equal segments all but the first go whole. Where an anchor has different
segments, the runs of the first of each are hashed to 128 bits and compared one by one, as spans of sentences are.

A document is one text of one doc_id: rows of one doc_id with different texts are documents side by side, ordered by a
mark (64 bits) of the text, and equal rows are one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import HOT_SHARE, Workspace, as_bytes, hot_join, small_batches, whole_row

SPAN_SENTENCES = 3
SPAN_WORDS = 25
ANCHOR_WORDS = 13
#: What a text's columns are replaced by.
ADDED = ("n_sentences", "n_removed", "n_words_removed")
#: A sentence ends behind these marks and closing quotes or brackets before white space, and at the end of a line.
_END = re.compile(rb"[.!?]+[\"')\]]*(?=[\t-\r ])|[\n\r]")
_WORD = re.compile(rb"[^\t-\r ]+[\t-\r ]*")
_U = np.uint64
#: Odd multipliers of the places of a run, one row a hash.
_TIMES = np.frombuffer(b"".join(xxhash.xxh3_64(bytes([k % 256, k // 256])).digest() for k in range(512)), "<u8").reshape(2, -1) | _U(1)


def pieces(text: bytes) -> list[bytes]:
    """The words of a text with the white space after each; joined they are the text."""
    out = _WORD.findall(text)
    blank = len(text) - len(text.lstrip())
    if blank:
        out[:1] = [text[:blank] + (out[0] if out else b"")]
    return out


def sentence_ends(text: bytes) -> np.ndarray:
    """How many words of the text there are up to the end of each sentence; sentences have a word at least."""
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | (raw >= 9) & (raw <= 13)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(raw) else np.zeros(0, np.int64)
    marks = np.fromiter((m.end() for m in _END.finditer(text)), np.int64)
    ends = np.unique(np.append(np.searchsorted(starts, marks, "left"), len(starts)))
    return ends[ends > 0]


def count_sentences(text: bytes) -> int:
    """As many as :func:`sentence_ends` has, in less time."""
    n = before = 0
    for m in _END.finditer(text):
        end = m.end()
        if not text[before:end].isspace():
            n += 1
        before = end
    return n + bool(text[before:].strip())


def sentence_spans(ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each span."""
    starts = np.append(0, ends[:-1])[: len(ends)]
    last = np.maximum(np.arange(len(ends)) + SPAN_SENTENCES - 1, np.searchsorted(ends, starts + least, "left"))
    fits = last < len(ends)
    return starts[fits], ends[last[fits]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _runs(words: np.ndarray, n: int, row: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    out = np.zeros(max(len(words) - n + 1, 0), _U)
    for k in range(n if len(out) else 0):
        out += words[k : k + len(out)] * _TIMES[row, k % 256]
    return _mix(out)


def _last_least(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the smallest of each n neighbours, the last of equal ones."""
    at, done = np.arange(len(x)), 1
    while done < n and len(at):
        step = min(done, n - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] <= x[left], right, left)
        done += step
    return at


def _hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's words begin (and the last end)."""
    split = [t.split() if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, split)])
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for words in split for w in words), _U, int(ends[-1])), ends


def segments(texts: list[bytes | None], least: int = SPAN_WORDS) -> tuple[np.ndarray, ...]:
    """(text, a, b, h1, h2) of each segment: its text, first span and end of spans (words), hashes of anchor and words."""
    words, ends = _hashed(texts)
    k = min(ANCHOR_WORDS, least)
    grams = _runs(words, k, 0)
    anchor = _last_least(grams, least - k + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    n = len(anchor)
    whole = doc[:n] == doc[least - 1 : least - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    a = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), n)
    b = stop[np.searchsorted(stop, a, "right")]
    # the hash of a segment: of its length and its words, as sums of products by place
    mixed, h2 = _mix(words ^ _TIMES[1, 255]), _mix((b - a).astype(_U))
    for j in range(2 * least - k if len(a) else 0):
        inside = a + j < b + least - 1
        h2 += np.where(inside, mixed[np.minimum(a + j, len(mixed) - 1)] * _TIMES[1, j % 256], _U(0))
    return doc[a], a - ends[doc[a]], b - ends[doc[a]], grams[anchor[a]].view(np.int64), _mix(h2).view(np.int64)


def _segment_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            doc, a, b, h1, h2 = segments([t if d is not None else None for d, t in zip(ids, texts, strict=True)], least)
            ids = np.array([d or 0 for d in ids], np.int64)
            marks = np.array([xxhash.xxh64_intdigest(t or b"", seed=42) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids[doc]), pa.array(marks[doc]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["h1", "h2", "doc_id", "mark", "a", "b"])

    return run


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many of the runs that begin before each word are in one of the segments."""
    steps = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return np.append(0, np.cumsum(np.cumsum(steps)[:n] > 0))


def _span_rows(least: int):
    """(h, doc_id, mark, a, b) of what may repeat in each text: spans of sentences in its segments, and runs of words of those marked ``each``."""

    def of_text(text: bytes, split: list[bytes], words: np.ndarray, a: np.ndarray, b: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, ...]:
        covered = _covered(a, b, len(words))
        i, j = sentence_spans(sentence_ends(text), least)
        inside = covered[j - least + 1] - covered[i] == j - least + 1 - i
        i, j = i[inside], j[inside]
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(split[x:y]), seed=1) for x, y in zip(i.tolist(), j.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        if each.any():
            at = np.flatnonzero(np.diff(_covered(a[each], b[each], len(words))))
            pair = np.empty((max(len(words) - least + 1, 0), 2), np.uint64)
            pair[:, 0], pair[:, 1] = _runs(words, least, 0), _runs(_mix(words ^ _TIMES[1, 255]), least, 1)
            i, j, h = np.concatenate([i, at]), np.concatenate([j, at + least]), np.concatenate([h, pair[at]])
        return h, i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            texts, segments = as_bytes(batch.column("text")), batch.column("segments")
            flat, ends = segments.flatten(), np.cumsum([0, *segments.value_lengths().to_pylist()])
            a, b, each = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            found = []
            for k, text in enumerate(texts):
                split, own = text.split(), slice(ends[k], ends[k + 1])
                words = np.fromiter(map(xxhash.xxh3_64_intdigest, split), _U, len(split))
                found.append(of_text(text, split, words, a[own], b[own], each[own]))
            sizes = [len(x[1]) for x in found]
            docs, marks = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("doc_id", "mark"))
            h, i, j = (np.concatenate([x[k] for x in found]) for k in range(3))
            for s in range(0, len(i), 200_000):
                part = slice(s, s + 200_000)
                m = len(i[part])
                keys = pa.Array.from_buffers(pa.binary(16), m, [None, pa.py_buffer(np.ascontiguousarray(h[part]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(docs[part]), pa.array(marks[part]), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32))], ["h", "doc_id", "mark", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, least: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, mark, spans array<struct<a,b>>) of documents with a repeated span in other than its first place; b is the end in words.

    Counting moves one hash a segment and adds up before the shuffle, so a passage that a third of the documents hold is
    one row a task; only segments with a repeated anchor are joined, with hot hashes spread.
    """
    work = Workspace(docs.sparkSession, "spans")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = work.table(ids.mapInArrow(_segment_rows(least), "h1 long, h2 long, doc_id long, mark long, a int, b int"), "segments")
    often = work.table(every.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    total = max(often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1)
    hot = F.col("n") * HOT_SHARE >= total
    place = ["doc_id", "mark", "a"]
    found = work.table(hot_join(every, often, "h1", hot, ["n"], salt=place, written=True).filter("n is not null").drop("n"), "found")
    work.drop(every)
    elsewhere = F.struct(*place) != F.col("first")
    key = F.hex(F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0")))).alias("h")
    classes = work.table(found.groupBy("h1", "h2").agg(F.min(F.struct(*place, "b")).alias("first"), F.count("*").alias("n")), "classes")
    several = classes.filter("n > 1").select(key, F.struct(*[F.col("first")[c].alias(c) for c in place]).alias("first"), "n")
    whole = hot_join(found.select(key, *place, "b"), several, "h", hot, ["first"], written=True).filter(elsewhere)
    gone = work.table(whole.select(*place, (F.col("b") + least - 1).alias("b")), "whole")

    # anchors of different segments: the runs of the first of each; and spans of sentences within segments
    mixed = work.table(classes.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "mixed")
    kinds = max(mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1)
    part = hot_join(classes.select("h1", "h2", "first"), mixed, "h1", F.col("n") * HOT_SHARE >= kinds, ["n"], salt=["h2"], written=True).filter("n is not null")
    part = part.select(*[F.col("first")[c].alias(c) for c in (*place, "b")], F.lit(True).alias("each"))
    part = part.unionByName(found.select(*place, "b", F.lit(False).alias("each")))
    part = part.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.collect_set(F.struct("a", "b", "each")).alias("segments"))
    texts = ids.withColumn("mark", text_mark())
    spans = texts.join(part, (F.col("doc_id") == F.col("_d")) & (F.col("mark") == F.col("_m"))).select("doc_id", "mark", "text", "segments").mapInArrow(_span_rows(least), "h binary, doc_id long, mark long, a int, b int")
    spans = work.table(spans, "spans")
    first = work.table(spans.groupBy("h").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    most = max(first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1)
    later = hot_join(spans, first, "h", F.col("n") * HOT_SHARE >= most, ["first"], written=True).filter(elsewhere)
    gone = gone.unionByName(later.select(*place, "b"))
    return gone.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def text_mark() -> Column:
    """The mark of the text, as the segments have it."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def cut(text: bytes | None, pairs: list[dict] | None) -> tuple[bytes | None, int, int, int]:
    """Text without the words that the spans cover; how many sentences it has, and how many sentences and words went."""
    if not text or not pairs:
        return text, count_sentences(text) if text else 0, 0, 0
    ends = sentence_ends(text)
    words = pieces(text)
    gone = np.zeros(len(words) + 1, np.int64)
    for p in pairs:
        gone[min(p["a"], len(words))] += 1
        gone[min(p["b"], len(words))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    before = np.append(0, np.cumsum(gone))
    whole = int((np.diff(before[np.append(0, ends)]) == np.diff(np.append(0, ends))).sum())
    return b"".join([p for p, g in zip(words, gone, strict=True) if not g]).rstrip(), len(ends), whole, int(gone.sum())


def dedup(docs: DataFrame, least: int = SPAN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) without repeated sentences and their edges, and what went.

    n_sentences counts the sentences of the text, n_removed those that went whole, n_words_removed the words that went;
    columns of ``docs`` with these names are replaced. Null texts stay null, texts without repeats keep every byte, and
    texts of which all words go become empty. Equal rows are one document, so they are not each other's repeats; rows of
    one doc_id with different texts are documents side by side. Rows with a null doc_id have no place in the order and
    stay as they are. n_chars follows the text where it changed. Columns of other names stay; an empty table stays empty.
    """
    found = repeated_spans(docs, least).withColumnsRenamed({"doc_id": "_span_doc", "mark": "_span_mark"})
    packed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_mark().alias("_mark"), F.col("text").cast("string").alias("text"))
    joined = packed.join(found, (F.col("_doc") == F.col("_span_doc")) & (F.col("_mark") == F.col("_span_mark")), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            got = [cut(t, p) for t, p in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([None if g[0] is None or not g[3] else g[0].decode() for g in got], pa.string()), *[pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)]],
                ["row", "new_text", *ADDED],
            )

    schema = StructType([packed.schema["row"], StructField("new_text", StringType()), *[StructField(c, LongType()) for c in ADDED]])
    out = joined.mapInArrow(run, schema)
    changed, cols = F.col("n_words_removed") > 0, []
    for c in docs.columns:
        if c.lower() in ADDED:
            continue
        value = F.col("row").getField(c)
        if c == "text":
            value = F.when(changed, F.col("new_text")).otherwise(value)
        elif c == "n_chars":
            value = F.when(changed, F.char_length("new_text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols, *ADDED)
