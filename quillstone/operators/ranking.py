"""Scores of blocks of postings for a table of queries, in a task: only the best of each query leave it.

A task reads its documents in groups. What a query's terms count is held by every worker (the queries' bytes are checked
before); a group's sums are one dense matrix of documents and queries, and after each group only the k best of a query
stay. So no row a query and document is ever made, a task's memory doesn't grow with its documents, and what is moved is
k rows a query and task.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are rounded to six digits, so a bound has to be lower by more than that to rule anything out.
SLACK = 2e-6
#: Products that are made at once, and sums of a group at most.
PRODUCTS, CELLS = 2_000_000, 4_000_000


class Asked:
    """What every query asks for: for each term (numbered) the places of its queries and a number of each."""

    def __init__(self, ids: pa.Array, terms: list[str], term: np.ndarray, place: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.terms = ids, terms
        self.place, self.weight = place[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def __len__(self) -> int:
        return len(self.ids)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def sums(asked: Asked, n_docs: int, term: np.ndarray, size: np.ndarray, doc: np.ndarray, value: np.ndarray, needed: np.ndarray | None = None) -> np.ndarray:
    """Sums of value times weight by document and query. Block b has the ``size[b]`` next postings (doc, value) of its term; ``needed`` tells the queries that matter."""
    out = np.zeros(n_docs * len(asked))
    asks = asked.starts[term + 1] - asked.starts[term]
    begin = np.cumsum(size) - size
    made = np.cumsum(asks * size)
    a = 0
    while a < len(term):
        b = max(a + 1, int(np.searchsorted(made, (made[a - 1] if a else 0) + PRODUCTS, "right")))
        at = spread(asked.starts[term[a:b]], asks[a:b])
        block = np.repeat(np.arange(a, b), asks[a:b])
        if needed is not None:
            keep = needed[asked.place[at]]
            at, block = at[keep], block[keep]
        n = size[block]
        posting = spread(begin[block], n)
        out += np.bincount(doc[posting] * len(asked) + np.repeat(asked.place[at], n), value[posting] * np.repeat(asked.weight[at], n), len(out))
        a = b
    return out.reshape(n_docs, len(asked))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark rounds doubles: by their decimal digits, halves up."""
    values, back = np.unique(x, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in values.tolist()], np.float64)[back]


class Best:
    """The k best documents of each query so far: by rounded score, ties by id."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.floor = asked, k, np.full(len(asked), -np.inf)
        self.place, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        if not scores.size:
            return
        floor = self.floor
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k] - SLACK)
        doc, place = np.nonzero((scores >= floor) & (scores > 0))
        if not len(doc):
            return
        score = rounded(scores[doc, place])
        found = ids.take(pa.array(doc[score > 0]))
        self.place, self.score = np.concatenate([self.place, place[score > 0]]), np.concatenate([self.score, score[score > 0]])
        self.ids = found if self.ids is None else pa.concat_arrays([self.ids, found])
        name = pc.rank(self.ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((name, -self.score, self.place))
        q = self.place[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = order[rank < self.k]
        self.place, self.score, self.ids = self.place[kept], self.score[kept], self.ids.take(pa.array(kept))
        ends = np.flatnonzero(np.append(self.place[1:] != self.place[:-1], True))
        full = ends[np.bincount(self.place, minlength=len(self.asked))[self.place[ends]] == self.k]
        self.floor[self.place[full]] = self.score[full] - SLACK

    def rows(self) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        return pa.RecordBatch.from_arrays([self.asked.ids.take(pa.array(self.place)), self.ids, pa.array(self.score)], ["query_id", "doc_id", "score"])
