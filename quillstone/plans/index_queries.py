"""Queries over a stored search index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query, sql_of
from ..operators.dense_index import CellIndex
from ..operators.index import TermIndex
from ..shared import shared_dir
from . import search_queries

#: The index of each folder's documents, made once a session.
_MADE: dict[tuple[str, str], TermIndex] = {}


def document_index(t: Tables) -> TermIndex:
    """The stored index of a folder's documents; the first call in a session makes it."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _MADE:
        _MADE[key] = TermIndex.build(t.documents, f"{shared_dir(t.spark)}/terms-{uuid.uuid4().hex}")
    return _MADE[key]


@query(sql_of(search_queries.bm25_topk))
def bm25_indexed(t: Tables) -> DataFrame:
    return document_index(t).bm25(t.benchmark, "item_id", 5)


@query(sql_of(search_queries.cosine_topk))
def cosine_indexed(t: Tables) -> DataFrame:
    return document_index(t).cosine(t.benchmark, "item_id", 5)


@query(sql_of(search_queries.bm25_topk))
def bm25_index_added(t: Tables) -> DataFrame:
    """The same after documents were added: some sources first, the others later, without building anew."""
    early = F.col("source") < "src3"
    index = TermIndex.build(t.documents.filter(early), f"{shared_dir(t.spark)}/added-{uuid.uuid4().hex}")
    index.add(t.documents.filter(~early | early.isNull()))
    return index.bm25(t.benchmark, "item_id", 5)


@query(sql_of(search_queries.dense_topk))
def dense_indexed(t: Tables) -> DataFrame:
    index = CellIndex.build(t.embeddings, f"{shared_dir(t.spark)}/cells-{uuid.uuid4().hex}")
    return index.topk(t.embeddings.filter("vec_id % 100 = 0"), 5)
