"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks. Each block is a vector: hashed tokens of its tag path (tag names and words of
class, id and role of the innermost elements, the nearer the heavier, and which elements are open around it), hashed
words of its text, and a few shapes (length, share of links, punctuation, how much of the page has the same path). A bidirectional LSTM in numpy reads the
sequence and labels every block as main text or not with the whole page as its context. The weights are fitted to pages
that :mod:`.html_samples` lays out in many styles, with a fixed seed, by

    python -m quillstone.llm.html_main

which writes them to WEIGHTS beside this module, with a mark of what they were fitted to; other marks are refused.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_blocks import AROUND, Block, blocks
from .html_samples import sample_page

PATH_DIM, WORD_DIM, SHAPES, HIDDEN = 384, 96, 10, 20
REST = len(AROUND) + WORD_DIM + SHAPES
DIM = PATH_DIM + REST
TRAIN_PAGES, EPOCHS, LOT, SEED = 14000, 10, 24, 11
WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Blocks whose vectors are made at once; a longer page is read in such pieces.
PIECE = 8192
#: An element outside of another counts this much of it in the path's vector.
FADE = 0.8
#: Words, names and paths whose places or vectors a process keeps (emptied when full).
KEPT_MOST = 300_000
_WORD = re.compile(r"\w+").findall
_WORD_AT: dict[str, int] = {}
_PATHS: dict[tuple, np.ndarray] = {}


def _hash(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % dim


def _tokens(name: str) -> list[str]:
    """A name with how it begins and ends, as names are often put together of known ones."""
    return [name, f"^{name[2:6]}", f"{name[-4:]}$", f"{name[-3:]}$"] if name[1:2] == ":" and len(name) > 6 else [name]


def path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    got = _PATHS.get(path)
    if got is None:
        if len(_PATHS) > KEPT_MOST // 10:
            _PATHS.clear()
        got = _PATHS[path] = np.zeros(PATH_DIM, np.float32)
        for depth, names in enumerate(path):
            for t in names:
                for x in _tokens(t):
                    got[_hash(x, PATH_DIM)] += FADE**depth
        if path:  # what stands next to the text is told apart from what is around it
            for t in path[0]:
                got[_hash(f"0{t}", PATH_DIM)] += 1.0
    return got


class Shares:
    """How many blocks and characters of a page have each path."""

    def __init__(self, found: list[Block]):
        self.of: dict[tuple, list[int]] = {}
        for path, _, text, _ in found:
            got = self.of.setdefault(path, [0, 0])
            got[0] += 1
            got[1] += len(text)
        self.n, self.chars = len(found), sum(got[1] for got in self.of.values())


def rest_vectors(found: list[Block], shares: Shares | None = None, start: int = 0) -> np.ndarray:
    """What is around each block, its words and shapes; ``found`` may be a piece of a page that begins at block ``start``."""
    shares, m, a = shares or Shares(found), len(found), len(AROUND)
    x = np.zeros((m, REST), np.float32)
    if not m:
        return x
    at, n_words, rows = [], [], []
    for path, _, text, linked in found:
        words, before = _WORD(text.lower()), len(at)
        for w in words:
            k = _WORD_AT.get(w)
            if k is None:
                if len(_WORD_AT) > KEPT_MOST:
                    _WORD_AT.clear()
                k = _WORD_AT[w] = _hash(w, WORD_DIM)
            at.append(k)
        n_words.append(len(at) - before)
        rows.append((len(text), linked, text.count("."), text.count("|"), *shares.of[path]))
    words = np.array(n_words)
    counts = np.bincount(np.repeat(np.arange(m) * WORD_DIM, words) + np.array(at, np.int64), minlength=m * WORD_DIM).reshape(m, WORD_DIM)
    x[:, :a] = np.frombuffer(b"".join([b.around for b in found]), np.uint8).reshape(m, a)
    x[:, a : a + WORD_DIM] = np.sqrt(counts / np.maximum(words, 1)[:, None])
    chars, linked, dots, bars, same, same_chars = np.array(rows, np.float64).T
    place = start + np.arange(m)
    x[:, -SHAPES:] = np.stack([np.log1p(chars) / 6, linked / chars, np.log1p(words) / 4, dots * 10 / chars, bars * 5 / chars, (place + 0.5) / shares.n, 1.0 / (1 + place), 1.0 / (shares.n - place), np.log1p(same) / 3, same_chars / shares.chars], axis=1)
    return x


def vectors(found: list[Block]) -> np.ndarray:
    return np.hstack([np.array([path_vector(b.path) for b in found]).reshape(len(found), PATH_DIM), rest_vectors(found)])


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the blocks of all pages, one after another) that the two directions read at each step, by (step, side, page).

    A page that has ended repeats its last place; what comes of that is read nowhere.
    """
    starts, t = np.cumsum(sizes) - sizes, np.arange(sizes.max())[:, None]
    ahead = starts + np.minimum(t, sizes - 1)
    return np.stack([ahead, starts + np.maximum(sizes - 1 - t, 0)], axis=1), (t < sizes)


class Labeller:
    """Weights of the two directions, side by side, and of the output."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.w = rng.normal(0, 1 / np.sqrt(60), (DIM, 8 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)).astype(np.float32)
        self.b = np.tile(np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]), 2).astype(np.float32)
        self.out = rng.normal(0, 0.3, 2 * h + 1).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b, self.out]

    def run(self, z: np.ndarray, sizes: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of the blocks of all pages, from their inputs to the gates (block, 8 * HIDDEN); what training needs goes on ``tape``.

        Gates are in, forget, out and new; sigmoid(x) is taken as (1 + tanh(x / 2)) / 2, so that one tanh does for all.
        """
        h, pages = HIDDEN, len(sizes)
        at, here = _order(sizes)
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        u, sides = self.u * half, np.arange(2)[:, None]
        z = (z.reshape(-1, 2, 4 * h) * half).astype(np.float32)
        hidden = np.zeros((len(z), 2 * h), np.float32)
        s, c = np.zeros((2, pages, h), np.float32), np.zeros((2, pages, h), np.float32)
        for t in range(len(at)):
            g = np.tanh(z[at[t], sides] + np.matmul(s, u))
            gate = g[..., : 3 * h] * 0.5 + 0.5
            new = gate[..., h : 2 * h] * c + gate[..., :h] * g[..., 3 * h :]
            tc = np.tanh(new)
            if tape is not None:
                tape.append((s, c, gate, g[..., 3 * h :], tc))
            s, c = gate[..., 2 * h :] * tc, new
            if pages == 1:
                hidden[at[t, 0, 0], :h], hidden[at[t, 1, 0], h:] = s[0, 0], s[1, 0]
            else:
                ok = here[t]
                hidden[at[t, 0, ok], :h], hidden[at[t, 1, ok], h:] = s[0, ok], s[1, ok]
        if tape is not None:
            tape.append(hidden)
        return hidden @ self.out[:-1] + self.out[-1]

    def run_long(self, gates: Callable[[int, int], np.ndarray], n: int) -> np.ndarray:
        """Logits of one page of any length: ``gates(a, b)`` gives the inputs to the gates of blocks a to b.

        Both directions go at once, each over pieces of its own; of hidden states only their share of the logits is kept.
        """
        h = HIDDEN
        order = np.concatenate([np.arange(k * h, (k + 1) * h) + side * 4 * h for k in range(4) for side in (0, 1)])  # gate by gate
        half = np.concatenate([np.full(6 * h, 0.5), np.ones(2 * h)]).astype(np.float32)
        u = np.zeros((2 * h, 8 * h), np.float32)
        u[:h, : 4 * h], u[h:, 4 * h :] = self.u[0], self.u[1]
        u = np.ascontiguousarray(u[:, order] * half * 0.5)  # states below are twice as large
        back = np.repeat([[False, True] * 4], h, axis=1).ravel()
        logits, s, c, more = np.full(n, self.out[-1], np.float32), np.zeros(2 * h, np.float32), np.zeros(2 * h, np.float32), np.empty(2 * h, np.float32)
        i, f, o, new = (slice(k * 2 * h, (k + 1) * 2 * h) for k in range(4))
        for a in range(0, n, PIECE):
            b = min(a + PIECE, n)
            z = gates(a, b)[:, order]
            z[:, back] = gates(n - b, n - a)[::-1, order[back]]
            z *= half
            states = np.empty((b - a, 2 * h), np.float32)
            for g, state in zip(z, states, strict=True):
                g += s @ u
                np.tanh(g, out=g)
                g[: 6 * h] += 1  # twice the gate
                np.multiply(g[i], g[new], out=more)
                c *= g[f]
                c += more
                c *= 0.5
                np.tanh(c, out=state)
                state *= g[o]
                s = state
            logits[a:b] += states[:, :h] @ (self.out[:h] / 2)
            logits[n - b : n - a] += (states[:, h:] @ (self.out[h : 2 * h] / 2))[::-1]
        return logits

    def grads(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the blocks (x: their vectors, y: labels) of all pages, and its gradient for each of :meth:`params`."""
        tape: list = []
        logits = self.run(x @ self.w + self.b, sizes, tape)
        hidden, h, n = tape.pop(), HIDDEN, len(x)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        d = ((p - y) / n).astype(np.float32)
        loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).sum() / n)
        g_out = np.concatenate([d @ hidden, [d.sum()]]).astype(np.float32)
        at, here = _order(sizes)
        back = np.stack([d[:, None] * self.out[:h], d[:, None] * self.out[h : 2 * h]], axis=1)
        dz_all, gu = np.zeros((n, 2, 4 * h), np.float32), np.zeros_like(self.u)
        ds, dc_next, sides, ut = np.zeros((2, len(sizes), h), np.float32), np.zeros((2, len(sizes), h), np.float32), np.arange(2)[:, None], self.u.transpose(0, 2, 1)
        for t in range(len(at) - 1, -1, -1):
            s, c, gate, g, tc = tape[t]
            i, f, o = gate[..., :h], gate[..., h : 2 * h], gate[..., 2 * h :]
            m = here[t][None, :, None]
            ds = m * (back[at[t], sides] + ds)
            dc = m * dc_next + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            ok = here[t]
            dz_all[at[t, 0, ok], 0], dz_all[at[t, 1, ok], 1] = dz[0, ok], dz[1, ok]
            gu += np.matmul(s.transpose(0, 2, 1), dz)
            ds, dc_next = np.matmul(dz, ut), dc * f
        flat = dz_all.reshape(n, 8 * h)
        return loss, [x.T @ flat, gu, flat.sum(0), g_out]


def training_set(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of ``n`` sample pages."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        html, parts = sample_page(rng)
        found = blocks(html)
        want = [(" ".join(t.split()), y) for t, y in parts if t.split()]
        if not found or sorted(b.text for b in found) != sorted(t for t, _ in want):
            continue  # a nesting that markup rules undo
        label: dict[str, int] = {}
        for t, y in want[::-1]:
            label[t] = y if label.get(t, y) == y else -1
        y = [label[b.text] for b in found]
        if -1 in y:  # a text that is main and other on one page: the title; by place then
            if [b.text for b in found] != [t for t, _ in want]:
                y = [v if v >= 0 else int(k > 0) for k, v in enumerate(y)]
            else:
                y = [v for _, v in want]
        out.append((vectors(found), np.array(y, np.float32)))
    return out


def recipe() -> str:
    """A mark of what the weights are fitted to: settings, and the vectors and labels of the first sample pages."""
    mark = hashlib.sha256(repr((PATH_DIM, WORD_DIM, SHAPES, HIDDEN, TRAIN_PAGES, EPOCHS, LOT, SEED, FADE)).encode())
    for x, y in training_set(60, SEED):
        mark.update(np.round(x * 1000).astype(np.int32).tobytes() + y.tobytes())
    return mark.hexdigest()


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    """The labeller with the weights of WEIGHTS."""
    net = Labeller(np.random.default_rng(SEED))
    with np.load(WEIGHTS) as kept:
        if str(kept["recipe"]) != recipe():
            raise ValueError(f"{WEIGHTS} is of other pages or settings; fit it anew: python -m {__name__}")
        net.w, net.u, net.b, net.out = (kept[k].astype(np.float32) for k in ("w", "u", "b", "out"))
    return net


def fit(pages: int = TRAIN_PAGES) -> Labeller:
    """Fit the labeller by Adam; the same weights each time."""
    data = training_set(pages, SEED)
    rng = np.random.default_rng(SEED)
    net = Labeller(rng)
    mom, var, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    last = EPOCHS * -(-len(data) // LOT)
    for _ in range(EPOCHS):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 12, rng.random()))
        lots = [order[i : i + LOT] for i in range(0, len(order), LOT)]
        for k in rng.permutation(len(lots)):
            lot = [data[i] for i in lots[k]]
            _, grads = net.grads(np.concatenate([x for x, _ in lot]), np.array([len(x) for x, _ in lot]), np.concatenate([y for _, y in lot]))
            step += 1
            rate = 0.014 * max(0.02, 1 - step / last)
            for p, g, m, v in zip(net.params(), grads, mom, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _long_page(found: list[Block], net: Labeller) -> np.ndarray:
    shares = Shares(found)

    def gates(a: int, b: int) -> np.ndarray:
        piece = found[a:b]
        of: dict[tuple, int] = {}
        which = [of.setdefault(x.path, len(of)) for x in piece]
        near = np.array([path_vector(p) for p in of]) @ net.w[:PATH_DIM] + net.b
        return near[which] + rest_vectors(piece, shares, a) @ net.w[PATH_DIM:]

    return net.run_long(gates, len(found))


def main_texts(htmls: list[str | None], net: Labeller) -> list[str]:
    """Main text of each page: its main blocks in page order, joined by one space."""
    out, waiting, total = [""] * len(htmls), [], 0

    def read() -> None:
        lot = sorted(waiting, key=lambda x: len(x[1]))  # pages of like length side by side
        for k in range(0, len(lot), 256):
            part = lot[k : k + 256]
            of: dict[tuple, int] = {}
            which = [of.setdefault(b.path, len(of)) for _, found in part for b in found]
            z = (np.array([path_vector(p) for p in of]) @ net.w[:PATH_DIM] + net.b)[which]
            z += np.concatenate([rest_vectors(found) for _, found in part]) @ net.w[PATH_DIM:]
            keep = net.run(z, np.array([len(found) for _, found in part])) > 0
            start = 0
            for i, found in part:
                out[i] = " ".join(b.text for b, y in zip(found, keep[start : start + len(found)], strict=True) if y)
                start += len(found)

    for i, html in enumerate(htmls):
        found = blocks(html)
        if len(found) > PIECE // 4:
            keep = _long_page(found, net) > 0
            out[i] = " ".join(b.text for b, y in zip(found, keep, strict=True) if y)
        elif found:
            waiting.append((i, found))
            total += len(found)
            if total >= PIECE:
                read()
                waiting, total = [], 0
    if waiting:
        read()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty html, and pages without main blocks, give an empty text and 0. Broken markup is read as far as it
    goes, in time linear in its length. Rows are neither moved nor joined: repeated rows, null ids and urls stay, an
    empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 2 << 20):
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    made = fit()
    np.savez(WEIGHTS, recipe=recipe(), w=made.w, u=made.u, b=made.b, out=made.out)
