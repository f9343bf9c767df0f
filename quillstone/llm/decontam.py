"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words of the items become small integers and all items go into one suffix automaton. Each state knows the items that
hold its strings. A document streams through it: the automaton's current length is the longest run of words, ending
here, that is in some item. Where that length reaches the window, the last ``window`` words are a hit. Words that no
item holds reset the automaton, so only runs of known words long enough for a window are streamed at all.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import Workspace, as_bytes, small_batches, whole_row

WINDOW = 13
#: A document is contaminated if at least 1 in COVER of its words is hit.
COVER = 20
#: Bytes of item text that go to a worker at once, as one automaton. A larger benchmark is dealt out over several passes
#: over the documents, each with a part of the items; what a pass finds is written and read by the next.
PASS_BYTES = 4 << 20
#: Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters are words; the rest separates them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Suffix automaton over integer words with, for each state, the longest string and the items that hold it.

    Most states have one step. It is kept in two arrays; only states with more have a table of their own, so a word of
    an item takes little.
    """

    def __init__(self) -> None:
        self.word, self.next, self.link, self.length = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.next.append(0)
        self.length.append(length)
        self.link.append(link)
        return len(self.word) - 1

    def go(self, s: int, w: int) -> int:
        """The state that word ``w`` leads to, or 0 (to which none leads)."""
        if self.word[s] == w:
            return self.next[s]
        return table.get(w, 0) if (table := self.more.get(s)) else 0

    def _put(self, s: int, w: int, to: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.next[s] = w, to
        else:
            self.more.setdefault(s, {})[w] = to

    def add(self, item: list[int]) -> None:
        """Append one item; the automaton starts from the root again for each, so no string spans two items."""
        last = 0
        for w in item:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        if q := self.go(last, w):
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, 0)
        p = last
        while p != -1 and not self.go(p, w):
            self._put(p, w, cur)
            p = link[p]
        if p != -1:
            q = self.go(p, w)
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q])
        self.word[c], self.next[c] = self.word[q], self.next[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p != -1 and self.go(p, w) == q:
            self._put(p, w, c)
            p = self.link[p]
        return c

    def mark(self, items: list[tuple[str, list[int]]]) -> None:
        """Note at each state the items whose words pass through it or through a state that links to it."""
        held: list[set[int] | tuple[int, ...] | None] = [None] * len(self.word)
        for k, (_, item) in enumerate(items):
            s = 0
            for w in item:
                s = self.go(s, w)
                if held[s] is None:
                    held[s] = {k}
                else:
                    held[s].add(k)
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        for s in sorted(range(1, len(held)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up:
                if held[up] is None:
                    held[up] = set(held[s])
                else:
                    held[up] |= held[s]
            mine = tuple(sorted(held[s]))
            held[s] = same.setdefault(mine, mine)
        held[0] = ()
        self.items = held


class Matcher:
    """One automaton with its vocabulary; items shorter than the window count as one window of their own length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        vocab: dict[bytes, int] = {}
        self.window, named = window, []
        for name, text in items:
            if got := [vocab.setdefault(w, len(vocab)) for w in words_of(text)]:
                named.append((name, got))
        self.vocab, self.names = vocab, [n for n, _ in named]
        self.sizes = [len(x) for _, x in named]
        self.known = vocab
        self.auto = SuffixAutomaton()
        for _, item in named:
            self.auto.add(item)
        self.auto.mark(named)
        self.short = {s for s in self.sizes if s < window}
        least = min([window, *self.short]) if named else window
        self.runs = re.compile(b"\x01{%d,}" % least).finditer
        # for each state: the items whose window, or whole short item, can end there
        self._ends: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}

    def _end(self, state: int, length: int) -> tuple[int, tuple[int, ...]]:
        """Longest window that ends at a state reached with ``length`` words, and the items that have one."""
        auto, window = self.auto, self.window
        reach, found = 0, set()
        s, n = state, length
        while s > 0:
            if n >= window:
                reach = max(reach, window)
            low = auto.length[auto.link[s]]
            for k in auto.items[s]:
                size = self.sizes[k]
                if size >= window:
                    if n >= window:
                        found.add(k)
                elif low < size <= n:  # the whole short item is one of this state's strings
                    found.add(k)
                    reach = max(reach, size)
            s = auto.link[s]
            n = auto.length[s]
            if n < window and not self.short:
                break
        return reach, tuple(sorted(found))

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans of hits, and the names of items with an occurring window."""
        spans: list[list[int]] = []
        names: set[int] = set()
        word, goes, more, link, length, ends = self.auto.word, self.auto.next, self.auto.more, self.auto.link, self.auto.length, self._ends
        for run in self.runs(bytes(map(self.known.__contains__, words))):
            s = n = 0
            for i, w in enumerate(map(self.vocab.__getitem__, words[run.start() : run.end()]), run.start()):
                while (to := goes[s] if word[s] == w else more[s].get(w, 0) if s in more else 0) == 0 and s:
                    s = link[s]
                    n = length[s]
                s, n = to, n + 1 if to else 0
                if n >= self.window or self.short and n:
                    key = (s, min(n, self.window))
                    if key not in ends:
                        ends[key] = self._end(*key)
                    reach, found = ends[key]
                    if reach:
                        names.update(found)
                        if spans and spans[-1][1] >= i + 1 - reach:
                            while len(spans) > 1 and spans[-2][1] >= i + 1 - reach:
                                spans.pop()
                            spans[-1] = [min(spans[-1][0], i + 1 - reach), i + 1]
                        else:
                            spans.append([i + 1 - reach, i + 1])
        return [(a, b) for a, b in spans], {self.names[k] for k in names}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and what stands between them; what is left keeps its bytes."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    out.append(text[last:])
    return b"".join(out)


_FOUND = [StructField("_spans", BinaryType()), StructField("_names", ArrayType(StringType()))]


Batches = Iterator[pa.RecordBatch]


def _pass(shared: Broadcast, before: bool) -> Callable[[Batches], Batches]:
    """Adds to (row, text, and what passes before found) what a part of the benchmark finds: _spans, _names."""

    def run(batches: Batches) -> Batches:
        m = shared.value
        for batch in small_batches(batches, "text"):
            had = zip(batch.column("_spans").to_pylist(), batch.column("_names").to_pylist(), strict=True) if before else repeat((b"", []))
            all_spans, all_names = [], []
            for text, (packed, known) in zip(as_bytes(batch.column("text")), had, strict=False):
                spans, names = m.spans(words_of(text))
                if packed:
                    spans = _merge([*spans, *_unpack(packed)])
                all_spans.append(array("q", [x for s in spans for x in s]).tobytes())
                all_names.append(sorted(names.union(known)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(all_spans, pa.binary()), pa.array(all_names, pa.list_(pa.string()))], ["row", "text", "_spans", "_names"])

    return run


def _unpack(packed: bytes) -> list[tuple[int, int]]:
    flat = array("q", packed)
    return list(zip(flat[::2], flat[1::2], strict=True))


def _kind(with_text: bool) -> StructType:
    extra = [StructField("clean_text", StringType())] if with_text else []
    return StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()), *extra])


def _judge(with_text: bool, names_: list[str]) -> Callable[[Batches], Batches]:
    """(row, found struct) from the spans and names of all passes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n_words, n_hit, items, digest, flag, texts = [], [], [], [], [], []
            for text, packed, names in zip(as_bytes(batch.column("text")), batch.column("_spans").to_pylist(), batch.column("_names").to_pylist(), strict=True):
                words, spans = len(words_of(text)), _unpack(packed)
                hit = sum(b - a for a, b in spans)
                n_words.append(words)
                n_hit.append(hit)
                items.append(len(names))
                digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                flag.append(hit > 0 and COVER * hit >= words)
                if with_text:
                    texts.append(cut(text, spans).decode() if text is not None else None)
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array(flag, pa.bool_()), *([pa.array(texts, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(made, names_)], ["row", "found"])

    return run


def _search(docs: DataFrame, benchmark: DataFrame, window: int, pass_bytes: int | None, with_text: bool) -> DataFrame:
    """(row, found): each row of ``docs`` as it was, and its contamination.

    Only the items of one pass are on the driver and in the workers at once, at most about twice ``pass_bytes`` of text
    (items are dealt out by hash; a single longer item is a pass of its own size).
    """
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // (pass_bytes or PASS_BYTES)))
    now, work = docs.select(whole_row(docs).alias("row"), F.col("text").cast("string").alias("text")), Workspace(docs.sparkSession, "decontam")
    between, kind = StructType([now.schema["row"], now.schema["text"], *_FOUND]), _kind(with_text)
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        matcher = Matcher([(i, bytes(t) if t is not None else None) for i, t in part], window)
        find = _pass(docs.sparkSession.sparkContext.broadcast(matcher), k > 0)
        if k < passes - 1:
            last, now = now, work.table(now.mapInArrow(find, between), f"pass-{k}")
            if k:
                work.drop(last)
    judge = _judge(with_text, kind.names)
    return now.mapInArrow(lambda batches: judge(find(batches)), StructType([now.schema["row"], StructField("found", kind)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False, pass_bytes: int | None = None) -> DataFrame:
    """Contamination of each row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated (and clean_text).

    ``docs`` has text and any other columns, which stay; those named like a result are replaced by it. Null or wordless
    texts have no words, hits or items and are clean. Items without words never occur; items with a null id are ignored;
    repeated rows give repeated results; empty tables are fine. Documents are not moved: the items, in passes of bounded
    size, go to the documents.
    """
    found = _search(docs, benchmark, window, pass_bytes, with_text)
    made = found.schema["found"].dataType.names
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text" and c.lower() not in made], "found.*")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int | None = None) -> DataFrame:
    """``docs`` without the documents over the coverage limit, and without the matched spans of the others.

    Spans of ``window`` words and more (whole shorter items) are over the length limit and go; a document of which at
    least 1/COVER is hit goes as a whole. n_chars follows the text where it changed. Other columns stay, whatever they
    are called; null texts and repeated rows stay; an empty table stays empty.
    """
    found = _search(docs, benchmark, window, pass_bytes, True).filter("not found.contaminated")
    changed = F.col("found.n_hit") > 0
    cols = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.when(changed, F.col("found.clean_text")).otherwise(value)
        elif c == "n_chars":
            value = F.when(changed, F.char_length("found.clean_text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return found.select(*cols)
