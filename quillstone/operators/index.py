"""A stored inverted index: postings in blocks of documents with bounds, so that ranking reads the blocks that can matter.

An index is a folder of tables. Documents are added as segments; a segment's documents are dealt into spans of up to
SPAN, as they come, and each term has one block a span: its documents in order with their term counts and lengths, and
the least length of each count, which give the most that the term adds to a score of the span, whatever the averages
become as documents are added. Blocks lie by a hash bucket of their term. A segment counts from the moment that its line in ``segments``
is written, which is the last of its files.

Ranking is exact. The bounds of a query's terms add up to a bound for each span. A query's best spans by that are scored
first; the k-th best score found there is a floor, and of the other spans only those whose bound reaches it are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import tokens
from .ranking import SLACK, Asked, Best, sums
from .search import B, K1, TERMS_MOST, asked, query_norms, query_terms, small, top

#: Documents of a span at most: a power of two.
SPAN_BITS = 8
BUCKETS = 64
#: Spans of a query that are scored before there is a floor.
FIRST_SPANS = 4

_SEGMENTS = "segment string, n_docs long, n_texts long, n_tokens long"
_BLOCKS = "term string, span long, n int, tops array<struct<tf:long,dl:int>>, docs array<long>, tfs array<long>, dls array<int>, segment string, bucket int"
_DOCS = "doc_id long, dl int, norm double, segment string"


def impact(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each span, which follow each other."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        segment, span = rows.column("segment").to_numpy(), rows.column("span").to_numpy()
        cuts = np.flatnonzero((segment[1:] != segment[:-1]) | (span[1:] != span[:-1])) + 1
        ends = np.append(0, cuts)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield rows.slice(a, b - a).combine_chunks()
        held = rows.slice(int(ends[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _blocks_of(ids: pa.Array, s: pa.Array, span: int) -> pa.RecordBatch:
    """Blocks of a span's documents; that of the empty term holds all documents, with the squares of their norms."""
    dl, words = pc.list_value_length(s), s.flatten().dictionary_encode()
    codes, count = words.indices.to_numpy().astype(np.int64), len(s)
    order = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64) - 1  # a document's place by id
    ids, lengths = ids.take(pa.array(np.argsort(order))), dl.take(pa.array(np.argsort(order)))
    key, tf = np.unique(codes * count + np.repeat(order, pc.fill_null(dl, 0).to_numpy()), return_counts=True)
    term, doc = key // count, key % count
    squares = np.bincount(doc, tf.astype(np.float64) ** 2, count).astype(np.int64)
    term, doc, tf = np.append(term, np.full(count, len(words.dictionary))), np.append(doc, np.arange(count)), np.append(tf, squares).astype(np.int64)
    ends = np.append(np.flatnonzero(term[1:] != term[:-1]) + 1, len(term))
    # the least length of each count of a term; a null text has none
    long = pc.fill_null(lengths, 0).to_numpy().astype(np.int64)[doc]
    by = np.lexsort((long, tf, term))
    first = by[np.append(True, (term[by][1:] != term[by][:-1]) | (tf[by][1:] != tf[by][:-1]))]
    tops = pa.StructArray.from_arrays([pa.array(tf[first]), pa.array(long[first].astype(np.int32))], ["tf", "dl"])
    names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""])]).take(pa.array(term[ends - 1]))
    return pa.RecordBatch.from_arrays(
        [names, pa.array(np.full(len(ends), span)), pa.array(np.diff(np.append(0, ends)).astype(np.int32)), _lists(tops, np.searchsorted(term[first], term[ends - 1], "right")), _lists(ids.take(pa.array(doc)), ends), _lists(tf, ends), _lists(lengths.take(pa.array(doc)).cast(pa.int32()), ends)],
        ["term", "span", "n", "tops", "docs", "tfs", "dls"],
    )


def _span_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, s, span) to blocks: the documents of a span follow each other."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        span = rows.column("span").to_numpy()
        ends = np.append(0, np.flatnonzero(span[1:] != span[:-1]) + 1)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part = rows.slice(a, b - a).combine_chunks()
            yield _blocks_of(part.column("doc_id").combine_chunks(), part.column("s").combine_chunks(), int(span[a]))
        held = rows.slice(int(ends[-1]))
    if held is not None and held.num_rows:
        part = held.combine_chunks()
        yield _blocks_of(part.column("doc_id").combine_chunks(), part.column("s").combine_chunks(), part.column("span")[0].as_py())


class TermIndex:
    """An inverted index below ``path``, in a file system that all parts of Spark share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> TermIndex:
        made = cls(docs.sparkSession, path)
        made.add(docs)
        return made

    def add(self, docs: DataFrame) -> str:
        """Add documents (doc_id, text), none of which may be in the index yet, as a segment; earlier ones stay as they are.

        Null texts have no terms; they count as documents, not in the average length. Rows with a null doc_id are refused, and so are ids that the
        index has or that come twice. A segment whose making failed or was refused is never read.
        """
        segment = uuid.uuid4().hex
        folder = f"{self.path}/%s/segment={segment}"
        words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens("text").alias("s"), F.shiftright(F.monotonically_increasing_id(), SPAN_BITS).alias("span"))
        blocks = words.mapInArrow(_span_blocks, "term string, span long, n int, tops array<struct<tf:long,dl:int>>, docs array<long>, tfs array<long>, dls array<int>")
        blocks = blocks.withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        blocks.repartitionByRange("bucket", "term", "span").sortWithinPartitions("bucket", "term", "span").write.partitionBy("bucket").parquet(folder % "blocks")
        own = self.spark.read.schema(_BLOCKS).parquet(folder % "blocks").filter((F.col("term") == "") & (F.col("bucket") == F.pmod(F.hash(F.lit("")), F.lit(BUCKETS))))
        own = own.select(F.inline(F.arrays_zip("docs", "dls", "tfs")))
        own.select(F.col("docs").alias("doc_id"), F.col("dls").alias("dl"), F.sqrt(F.col("tfs").cast("double")).alias("norm")).write.parquet(folder % "docs")
        added = self.spark.read.schema("doc_id long, dl int, norm double").parquet(folder % "docs")
        known = self._table("docs", _DOCS).select("doc_id", F.lit(0).alias("new"))
        twice = added.select("doc_id", F.lit(1).alias("new")).unionByName(known).groupBy("doc_id").agg(F.sum("new").alias("new"), F.count("*").alias("n"))
        if wrong := twice.filter("new > 0 and (n > 1 or doc_id is null)").first():
            raise ValueError(f"doc_id {wrong.doc_id} is null, comes twice or is in the index already")
        sums = added.agg(F.lit(segment).alias("segment"), F.count("*").alias("n_docs"), F.count("dl").alias("n_texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
        sums.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return segment

    def _segments(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments") if there else self.spark.createDataFrame([], _SEGMENTS)

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of the segments that count; there are as many segments as there were additions."""
        names = [r.segment for r in self._segments().collect()]
        if not names:
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema)
        return table.parquet(*[f"{self.path}/{name}/segment={s}" for s in names])

    def sizes(self) -> tuple[int, float]:
        """Documents of the index, and the average length of those with a text."""
        sums = self._segments().agg(F.sum("n_docs").alias("n"), F.sum("n_texts").alias("m"), F.sum("n_tokens").alias("t")).first()
        return sums.n or 0, (sums.t or 0) / (sums.m or 1)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table: small, read several times, and there when an executor is lost."""
        path = f"{self.path}/plans/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _weights(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(bucket, term, query_id, weight): what a query's term counts, by how often the query says it and how rare it is."""
        n, _ = self.sizes()
        terms = query_terms(queries, key, text).withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        df = self._table("blocks", _BLOCKS).join(small(terms.select("bucket", "term").distinct()), ["bucket", "term"]).groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return self._kept(terms.join(df, "term").select("bucket", "term", "query_id", weight.alias("weight")), "weights")

    def _scored(self, weights: DataFrame, spans: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents of whole spans (query_id, segment, span); a span's documents are in no other."""
        average = F.lit(self.sizes()[1])
        rows = self._table("blocks", _BLOCKS).join(small(weights), ["bucket", "term"]).join(small(spans), ["query_id", "segment", "span"])
        postings = rows.select("query_id", "weight", F.inline(F.arrays_zip("docs", "tfs", "dls")))
        part = F.col("weight") * impact(F.col("tfs"), F.col("dls"), average)
        return postings.groupBy("query_id", F.col("docs").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")

    def _spans(self, weights: DataFrame, k: int) -> DataFrame:
        average = F.lit(self.sizes()[1])
        rows = self._table("blocks", _BLOCKS).withColumn("most", F.array_max(F.transform("tops", lambda x: impact(x["tf"], x["dl"], average))))
        rows = rows.select("bucket", "term", "segment", "span", "most").join(small(weights), ["bucket", "term"])
        bounds = rows.groupBy("query_id", "segment", "span").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.count("*").alias("n_blocks"))
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "span")
        first = F.row_number().over(order) <= FIRST_SPANS
        bounds = self._kept(bounds.withColumn("first", first), "bounds")
        found = top(self._scored(weights, bounds.filter("first").select("query_id", "segment", "span")), k)
        floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        marked = bounds.join(small(floors), "query_id", "left")
        return marked.withColumn("needed", F.col("first") | (F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)).drop("floor")

    def spans(self, queries: DataFrame, key: str, text: str = "text", k: int = 5) -> DataFrame:
        """(query_id, segment, span, n_blocks, bound, first, needed): what each query has in each span, and whether it is read.

        ``first`` spans give the floor; a span is ``needed`` where it is one of these or its bound reaches the floor.
        """
        return self._spans(self._weights(queries, key, text), k)

    def _blocks(self, asks: Asked) -> DataFrame:
        """Blocks of the terms asked for, by their numbers t, and of the documents themselves (t = -1)."""
        names = self.spark.createDataFrame([(-1, ""), *enumerate(asks.terms)], "t int, term string").withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        return self._table("blocks", _BLOCKS).join(F.broadcast(names), ["bucket", "term"])  # TERMS_MOST rows at most

    def _best(self, asks: Asked, blocks: DataFrame, terms: DataFrame, k: int, impacts: Callable | None) -> DataFrame:
        """The k best documents a query by the sums of ``impacts`` (of term, tf and dl), or by cosine; blocks move once, by span."""
        shared = self.spark.sparkContext.broadcast(asks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks = shared.value
            best, norms = Best(asks, k), query_norms(asks)
            for span in _spans_of(batches):
                t, size = span.column("t").to_numpy().astype(np.int64), pc.list_value_length(span.column("docs")).to_numpy().astype(np.int64)
                docs, tf = (span.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "tfs"))
                own = np.repeat(t < 0, size)
                names, tf, squares = docs[own], tf[~own].astype(np.float64), tf[own].astype(np.float64)
                if not len(tf):
                    continue
                doc, term, of, n = np.searchsorted(names, docs[~own]), t[t >= 0], np.repeat(t[t >= 0], size[t >= 0]), size[t >= 0]
                if impacts is None:
                    scores = sums(asks, len(names), term, n, doc, tf) / np.maximum(np.sqrt(squares)[:, None] * norms, 1e-300)
                else:
                    value = impacts(of, tf, pc.fill_null(span.column("dls").combine_chunks().flatten(), 0).to_numpy()[~own])
                    most = np.maximum.reduceat(value, np.cumsum(n) - n)
                    bound = sums(asks, 1, term, np.ones(len(term), np.int64), np.zeros(len(term), np.int64), most)[0]
                    scores = sums(asks, len(names), term, n, doc, value, bound >= best.floor - SLACK)
                best.add(scores, pa.array(names))
            if (rows := best.rows()) is not None:
                yield rows

        kind = StructType([StructField("query_id", terms.schema["query_id"].dataType), *StructType.fromDDL("doc_id long, score double").fields])
        spans = blocks.select("segment", "span", "t", "docs", "tfs", "dls").repartition("segment", "span").sortWithinPartitions("segment", "span", "t")
        return top(spans.mapInArrow(run, kind), k)

    def bm25(self, queries: DataFrame, key: str, k: int = 5, text: str = "text") -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best documents a query, as :func:`.search.bm25` gives them.

        Few queries go to the tasks, where a span is scored as a whole for the queries whose bound reaches the floor so far.
        """
        terms = query_terms(queries, key, text)
        if terms.limit(TERMS_MOST + 1).count() <= TERMS_MOST:
            asks, (n, average) = asked(terms), self.sizes()
            blocks, df = self._blocks(asks), np.zeros(len(asks.terms))
            for r in blocks.filter("t >= 0").groupBy("t").agg(F.sum("n").alias("df")).collect():  # a row a query term
                df[r.t] = r.df
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            return self._best(asks, blocks, terms, k, lambda t, tf, dl: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (average or 1.0))))
        weights = self._weights(queries, key, text)
        needed = self._kept(self._spans(weights, k).filter("needed").select("query_id", "segment", "span"), "needed")
        return top(self._scored(weights, needed), k)

    def cosine(self, queries: DataFrame, key: str, k: int = 5, text: str = "text") -> DataFrame:
        """(query_id, doc_id, score, rank) by cosine, as :func:`.search.cosine` gives them; norms come from the index."""
        terms = query_terms(queries, key, text)
        if terms.limit(TERMS_MOST + 1).count() <= TERMS_MOST:
            asks = asked(terms)
            return self._best(asks, self._blocks(asks), terms, k, None)
        qnorm = terms.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf")) + F.count("*") - 1).alias("qnorm"))
        held = terms.join(qnorm, "query_id").withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        rows = self._table("blocks", _BLOCKS).join(small(held), ["bucket", "term"]).select("query_id", "qnorm", "qtf", F.inline(F.arrays_zip("docs", "tfs")))
        dots = rows.groupBy("query_id", F.col("docs").alias("doc_id")).agg(F.sum(F.col("tfs") * F.col("qtf")).alias("dot"), F.first("qnorm").alias("qnorm"))
        scored = dots.join(self._table("docs", _DOCS).select("doc_id", "norm"), "doc_id")
        return top(scored.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score")).filter("score > 0"), k)
