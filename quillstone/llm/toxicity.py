"""Toxic spans by a two-state linear-chain conditional random field, and document scores from its marginals.

Learning uses a bounded sample of labelled training documents. Words that mark toxic documents there label the tokens;
the field is fitted to windows of such tokens by gradient steps on the exact likelihood (forward-backward). Scoring runs
forward-backward over every token of every document, as log-odds recursions over many documents at once; the marginals
give a document's score through a logistic fit, and the offsets of tokens with a marginal of SPAN_AT or more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches
from .decontam import words_of

HELD_OUT = 2
PREDICT_AT, SPAN_AT = 0.3, 0.5
#: Bounds of the sample: labelled toxic and other training documents, and bytes of all their texts. Texts are learned
#: from whole; a document that does not fit into the bytes that are left is passed over.
TOXIC_MOST, OTHER_MOST, SAMPLE_BYTES = 1500, 4500, 48 << 20
#: A word marks toxicity if it is in MARK_DOCS of the sampled toxic documents or more and MARK_RATIO times likelier there.
MARK_DOCS, MARK_RATIO = 5, 25.0
#: Beginnings of words, in bytes, that are features beside the words; they carry over to words that training never saw.
PREFIXES = (5, 6, 7, 8)
#: Words beside a marking one in a window, windows that the field is fitted to (by hash, documented bound), steps, words kept.
WINDOW, WINDOWS_MOST, STEPS, CACHE_MOST = 12, 6000, 80, 400_000
#: Words of a document that is not toxic for each window taken from it.
WINDOWS_EVERY = 1000
#: Near copies in the sample count once: texts of one label of which this share of 5-word windows is the same.
SAME = 0.8
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in PREFIXES if len(word) > k]


class _Own(dict):
    """Word -> its own weight, worked out once a worker and word."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, word: bytes) -> float:
        f = self.field
        w = float(f.own[f.vocab.get(word, 0)] + sum(f.begin[f.prefixes.get(b, 0)] for b in beginnings(word)))
        if len(self) >= CACHE_MOST:
            self.clear()
        self[word] = w
        return w


@dataclass
class Field:
    """Weights of the toxic state against the other: by word and its beginnings, by word before and after, transitions, and the score's fit."""

    vocab: dict[bytes, int]
    prefixes: dict[bytes, int]
    own: np.ndarray
    begin: np.ndarray
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray  # 2 x 2 log potentials
    start: float
    bias: float
    fit: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_own"}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        own = self.__dict__.get("_own")
        if own is None:
            own = self._own = _Own(self)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        e = np.fromiter(map(own.__getitem__, words), np.float64, len(words)) + self.bias
        if len(ids) > 1:
            e[1:] += self.before[ids[:-1]]
            e[:-1] += self.after[ids[1:]]
        return e


def _pass(x: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    """log((e^a + e^(b + x)) / (e^c + e^(d + x)))."""
    return np.logaddexp(a, b + x) - np.logaddexp(c, d + x)


def marginals(field: Field, chains: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of the toxic state at each place of each chain of emissions (log-odds)."""
    order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
    out = [np.zeros(0) for _ in chains]
    if not order:
        return out
    sizes = np.array([len(chains[i]) for i in order])
    longest, m = int(sizes[0]), field.move
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    e = np.concatenate([[0], np.cumsum(active)])
    # place-major layout: the values of place t of all chains that reach it are adjacent
    flat = np.empty(int(e[-1]))
    for k, i in enumerate(order):
        flat[e[:-1][: sizes[k]] + k] = chains[i]
    f, g = np.empty_like(flat), np.empty_like(flat)
    f[: e[1]] = flat[: e[1]] + field.start
    for t in range(1, longest):
        n = active[t]
        f[e[t] : e[t + 1]] = flat[e[t] : e[t + 1]] + _pass(f[e[t - 1] : e[t - 1] + n], m[0, 1], m[1, 1], m[0, 0], m[1, 0])
    g[e[longest - 1] :] = 0.0
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        g[e[t] + n : e[t + 1]] = 0.0
        g[e[t] : e[t] + n] = _pass(g[e[t + 1] : e[t + 2]] + flat[e[t + 1] : e[t + 2]], m[1, 0], m[1, 1], m[0, 0], m[0, 1])
    p = 1.0 / (1.0 + np.exp(-np.clip(f + g, -60, 60)))
    for k, i in enumerate(order):
        out[i] = p[e[:-1][: sizes[k]] + k]
    return out


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What the score is made of: the largest marginal, the expected number of toxic tokens, and their share (logs)."""
    if not len(p):
        return 0.0, 0.0, 0.0
    return float(p.max()), float(np.log1p(p.sum())), float(np.log1p(100 * p.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _distinct(texts: list[list[bytes]], labels: list[int]) -> list[int]:
    """Places of documents without near copies (SAME or more of their 5-word windows) of kept ones of the same label.

    Copies are looked for among kept documents that share one of 3 minimum hashes, and then compared window by window.
    """
    found: dict[tuple[int, int, int], list[int]] = {}
    kept, sets = [], {}
    for i, (w, y) in enumerate(zip(texts, labels, strict=True)):
        n = max(1, len(w) - 4)
        grams = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[j : j + 5])) for j in range(n)), np.uint64, n))
        marks = [(y, s, int((grams * np.uint64(m)).min())) for s, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))]
        others = {k for m in marks for k in found.get(m, ())}
        shared = {k: len(np.intersect1d(grams, sets[k], assume_unique=True)) for k in others}
        if any(same >= SAME * (len(grams) + len(sets[k]) - same) for k, same in shared.items()):
            continue
        kept.append(i)
        sets[i] = grams
        for m in marks:
            found.setdefault(m, []).append(i)
    return kept


def learn(sample: list[tuple[bytes | None, int]]) -> Field:
    """Fit a field to (text, toxic 0/1) pairs. Deterministic. Without toxic labels nothing is flagged: every score is 1/4 at most; with toxic labels alone every score is their share."""
    one: dict[bytes, bytes] = {}  # one object a word, whatever the number of its places
    pairs = [([one.setdefault(w, w) for w in words_of(t)], int(y)) for t, y in sample]
    pairs = [pairs[i] for i in _distinct([w for w, _ in pairs], [y for _, y in pairs])]
    n = Counter(y for _, y in pairs)
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    starts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for w, y in pairs:
        seen = set(w)
        df[y].update(seen)
        starts[y].update({b for x in seen for b in beginnings(x)})
    rate = (n[1] or 1) / max(n[0], 1)
    least = max(MARK_DOCS, n[1] // 100)
    telling = lambda found: {w for w, c in found[1].items() if c >= least and c >= MARK_RATIO * rate * (found[0][w] + 0.5)}
    words_, begun = telling(df), telling(starts)
    marks = words_ | {w for w in df[1] if any(b in begun for b in beginnings(w))}
    # windows: around each marking word of toxic documents; of the others one, at a place by hash, for each WINDOWS_EVERY words
    windows: list[tuple[list[bytes], np.ndarray]] = []
    for w, y in pairs:
        last = -1
        for i in [i for i, x in enumerate(w) if x in marks] if y else []:
            if i > last:
                part = w[max(0, i - WINDOW) : i + WINDOW + 1]
                windows.append((part, np.array([x in marks for x in part], float)))
                last = i + WINDOW
        for at in range(0, 0 if y else len(w), WINDOWS_EVERY):
            rest = w[at : at + WINDOWS_EVERY]
            start = zlib.crc32(rest[-1]) % max(1, len(rest) - 2 * WINDOW)
            part = rest[start : start + 2 * WINDOW + 1]
            windows.append((part, np.zeros(len(part))))
    # over the bound: those with the smallest hashes, as many of each label as its share of all
    for y in (0, 1):
        mine = sorted((xxhash.xxh64_intdigest(b" ".join(p)), k) for k, (p, z) in enumerate(windows) if z.any() == y)
        if len(mine) > WINDOWS_MOST // 2:
            gone = {k for _, k in mine[WINDOWS_MOST // 2 :]}
            windows = [x for k, x in enumerate(windows) if k not in gone]
    counts = Counter(x for p, _ in windows for x in p)
    begins = Counter(b for x in counts for b in beginnings(x))
    vocab = {x: i + 1 for i, x in enumerate(sorted(x for x, c in counts.items() if c >= 3 or x in words_))}
    prefixes = {x: i + 1 for i, x in enumerate(sorted(x for x, c in begins.items() if c >= 3 or x in begun))}
    size = len(vocab) + 1
    field = Field(vocab, prefixes, np.zeros(size), np.zeros(len(prefixes) + 1), np.zeros(size), np.zeros(size), np.zeros((2, 2)), 0.0, 0.0, np.zeros(4))
    if windows and marks:
        _fit(field, windows)
    chains = marginals(field, [field.emissions(w) for w, _ in pairs])
    y = np.array([y for _, y in pairs], float)
    if len(set(y)) == 2:
        field.fit = _logistic(np.array([summary(p) for p in chains]), y)
    else:
        share = (y.sum() + 1 if y.sum() else 0.5) / (len(y) + 2)  # without toxic labels nothing is flagged: 1/4 at most
        field.fit = np.array([np.log(share / (1 - share)), 0, 0, 0])
    return field


def _fit(field: Field, windows: list[tuple[list[bytes], np.ndarray]], rate: float = 0.15, ridge: float = 2e-3) -> None:
    """Adam steps on the mean log-likelihood of the windows."""
    ids = [np.fromiter(map(field.vocab.get, w, repeat(0)), np.int32, len(w)) for w, _ in windows]
    width, n = max(map(len, ids)), len(ids)
    x, y, here = np.zeros((n, width), np.int32), np.zeros((n, width)), np.zeros((n, width))
    for k, (i, (_, lab)) in enumerate(zip(ids, windows, strict=True)):
        x[k, : len(i)], y[k, : len(i)], here[k, : len(i)] = i, lab, 1
    z = np.zeros((n, width, len(PREFIXES)), np.int32)
    for k, (w, _) in enumerate(windows):
        for t, word in enumerate(w):
            for j, b in enumerate(beginnings(word)):
                z[k, t, j] = field.prefixes.get(b, 0)
    both = here[:, 1:] * here[:, :-1]
    size, begins = len(field.own), len(field.begin)
    theta = np.zeros(3 * size + 6 + begins)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[:, :-1] == a) * (y[:, 1:] == b) * both).sum()
    for step in range(1, STEPS + 1):
        own, bef, aft = theta[:size], theta[size : 2 * size], theta[2 * size : 3 * size]
        move, start, bias = theta[3 * size : 3 * size + 4].reshape(2, 2), theta[3 * size + 4], theta[3 * size + 5]
        e = own[x] + theta[3 * size + 6 :][z].sum(2) + bias
        e[:, 1:] += bef[x[:, :-1]] * both
        e[:, :-1] += aft[x[:, 1:]] * both
        f, g = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0] + start
        for t in range(1, width):
            f[:, t] = e[:, t] + _pass(f[:, t - 1], move[0, 1], move[1, 1], move[0, 0], move[1, 0])
        for t in range(width - 2, -1, -1):
            g[:, t] = _pass(g[:, t + 1] + e[:, t + 1], move[1, 0], move[1, 1], move[0, 0], move[0, 1]) * both[:, t]
        p = 1 / (1 + np.exp(-np.clip(f + g, -60, 60)))
        miss = (y - p) * here
        # pair marginals: of places t and t + 1, from what comes before and after
        pair = np.zeros((2, 2))
        logit = {(a, b): a * f[:, :-1] + move[a, b] + b * (e[:, 1:] + g[:, 1:]) for a in (0, 1) for b in (0, 1)}
        norm = np.logaddexp(np.logaddexp(logit[0, 0], logit[0, 1]), np.logaddexp(logit[1, 0], logit[1, 1]))
        for a, b in logit:
            pair[a, b] = (np.exp(logit[a, b] - norm) * both).sum()
        grad = np.concatenate([
            np.bincount(x.ravel(), miss.ravel(), size),
            np.bincount(x[:, :-1].ravel(), (miss[:, 1:] * both).ravel(), size),
            np.bincount(x[:, 1:].ravel(), (miss[:, :-1] * both).ravel(), size),
            (seen - pair).ravel(),
            [miss[:, 0].sum(), miss.sum()],
            np.bincount(z.ravel(), np.repeat(miss.ravel(), len(PREFIXES)), begins),
        ])
        grad[[0, size, 2 * size, 3 * size + 6]] = 0.0  # words outside the vocabulary say nothing
        grad = grad / n - ridge * theta / 10
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta = theta + rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    field.own, field.before, field.after = theta[:size].copy(), theta[size : 2 * size].copy(), theta[2 * size : 3 * size].copy()
    field.move, field.start, field.bias = theta[3 * size : 3 * size + 4].reshape(2, 2).copy(), float(theta[3 * size + 4]), float(theta[3 * size + 5])
    field.begin = theta[3 * size + 6 :].copy()


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes | None, int]]:
    """Whole texts of at most TOXIC_MOST toxic and OTHER_MOST other labelled documents that are not held out, of SAMPLE_BYTES in all.

    Documents are taken in an order by hash; ids and lengths of the candidates, whose number is bounded, come to the driver
    first, so that the bytes are known before any text does.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    usable = usable.filter(F.crc32(F.col("_id").cast("string")) % 4 != HELD_OUT).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = usable.filter("_y = 1").orderBy(*order).limit(TOXIC_MOST).union(usable.filter("_y = 0").orderBy(*order).limit(OTHER_MOST))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("t"))
    # repeated rows of one id count once, with their longest text
    sizes = texts.select("_id", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).join(F.broadcast(picked), "_id").groupBy("_id").agg(F.max("n").alias("n"), F.first("_y").alias("_y")).collect()
    sizes.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["_id"])), r["_id"]))
    left, chosen = SAMPLE_BYTES, {}
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            chosen[r["_id"]] = r["_y"]
    wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "_id long, _y int")
    rows = texts.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.max_by("t", F.struct(F.coalesce(F.octet_length("t"), F.lit(0)), "t")).alias("t"), F.first("_y").alias("_y")).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["_id"])), r["_id"]))
    return [(bytes(r["t"]) if r["t"] is not None else None, r["_y"]) for r in rows]


def score(docs: DataFrame, field: Field, with_spans: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted[, spans]) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and wordless texts get the score of a text without toxic tokens. A row with a null doc_id is not held out.
    spans: [start, end) in code points of runs of tokens with a marginal of SPAN_AT or more. Rows are not moved, so
    repeated rows get equal results and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in small_batches(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            chains = marginals(field, [field.emissions(words_of(t)) for t in texts])
            x = np.array([summary(p) for p in chains]).reshape(-1, 3)
            s = 1 / (1 + np.exp(-np.clip(field.fit[0] + x @ field.fit[1:], -60, 60)))
            held = [d is not None and zlib.crc32(str(d).encode()) % 4 == HELD_OUT for d in ids]
            cols, names = [batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            if with_spans:
                cols.append(pa.array([offsets(t, p) for t, p in zip(texts, chains, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, held_out boolean, score double, predicted int" + (", spans array<struct<start:bigint,end:bigint>>" if with_spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def offsets(text: bytes | None, p: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of runs of toxic tokens."""
    if not len(p) or p.max() < SPAN_AT:
        return []
    at, out, last, seen, chars = [m.span() for m in _WORD.finditer(text)], [], -2, 0, 0
    for i in np.flatnonzero(p >= SPAN_AT):
        a, b = at[i]
        start = chars + len(text[seen:a].decode())
        chars = start + len(text[a:b].decode())
        seen = b
        if i == last + 1:
            out[-1]["end"] = chars
        else:
            out.append({"start": start, "end": chars})
        last = i
    return out


def score_documents(docs: DataFrame, labels: DataFrame, with_spans: bool = False) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score every document; see :func:`training_sample` and :func:`score`."""
    return score(docs, learn(training_sample(docs, labels)), with_spans)
