"""Token counts of byte-level BPE by a heap of adjacent pairs over a linked list, without token ids.

A pre-token starts as one symbol a byte. The pair of neighbours with the lowest merge rank (leftmost on ties) is popped
and joined until no neighbours have a rank; the token count is the initial symbols less the merges. Counts of chunks
are kept in a bounded table per worker, since a chunk's count depends on nothing outside it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

OVER_LIMIT = 512
#: Chunks whose counts a worker keeps; the table is emptied when full, which costs time and changes nothing.
CACHE_MOST = 600_000
#: Longest chunk kept in the table.
CACHE_BYTES = 64
#: White space beyond ASCII that the tokenizer's pattern knows, as UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A space that may belong to a longer run of white space, before the space that a word takes along.
_RUN = re.compile(rb" (?:[\t-\r ]|$|" + _WIDE.pattern + rb")")
_CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Merge ranks of a vocabulary and the merging of one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        ids = {"".join(t): i for t, i in model["vocab"].items()}
        self.byte_symbol = {b: ids[c] for c, b in to_byte.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((ids[left], ids[right]), (at, ids[left + right]))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def merges(self, piece: bytes) -> int:
        """How many merges the bytes of one pre-token take."""
        symbol = [self.byte_symbol[b] for b in piece]
        n, rank = len(symbol), self.rank
        if n < 2:
            return 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # a neighbour has been merged meanwhile
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if r := rank.get((made, symbol[k])):
                    heapq.heappush(heap, (r[0], i, r[1], made, symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], made))):
                heapq.heappush(heap, (r[0], h, r[1], symbol[h], made))
        return done


class TokenCounter(dict):
    """Chunk -> tokens. A chunk is a run of white space with the run of other characters after it."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.merger, self.of_piece = PairMerger(path), {}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.wide_chunks = regex.compile(r"\s*\S+|\s+").findall
        found = b"|".join(re.escape(t.encode()) for t in sorted(self.merger.special, key=len, reverse=True))
        self.special = re.compile(b"(" + found + b")") if found else None

    def __missing__(self, chunk: bytes) -> int:
        n, known = 0, self.of_piece
        if len(known) >= CACHE_MOST:
            known.clear()
        for piece in self.pieces(chunk.decode()):
            if (k := known.get(piece)) is None:
                raw = piece.encode()
                k = len(raw) - self.merger.merges(raw)
                if len(raw) <= CACHE_BYTES:
                    known[piece] = k
            n += k
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_MOST:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: bytes | None) -> int:
        """Tokens of a whole text; null or empty: 0. Special strings count as the one special token they are."""
        if not text:
            return 0
        if self.special and b"<|" in text:
            parts = self.special.split(text)
            return len(parts) // 2 + sum(map(self._plain, parts[::2]))
        return self._plain(text)

    def _plain(self, text: bytes) -> int:
        if not text:
            return 0
        if _RUN.search(text):  # runs of white space belong to one chunk
            chunks = [c.encode() for c in self.wide_chunks(text.decode())] if _WIDE.search(text) else _CHUNK.findall(text)
            return sum(map(self.__getitem__, chunks))
        first, *rest = text.split(b" ")
        return self[first] + sum(map(self.__getitem__, [b" " + x for x in rest])) if first else sum(map(self.__getitem__, [b" " + x for x in rest]))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter; kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = OVER_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have 0 bytes and tokens. Rows are neither moved nor joined, so repeated rows and null ids stay
    as they are and an empty table gives an empty one.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in small_batches(batches, "text"):
            texts = as_bytes(batch.column("text"))
            sizes, tokens = [len(t) if t else 0 for t in texts], [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
