"""SentencePiece encoding and decoding with seeded merge-dropout, for merge-type (BPE) models with byte fallback.

An agenda holds the candidate merges of a chunk, best score first, leftmost on ties. Each candidate taken from it is
skipped with the probability of the dropout rate. The candidates of a document, taken one after another, are one
sequence; how many are merged before the next is skipped comes from a stream of hashes keyed by seed, variant and
document. So each occurrence of a word draws anew, a document always gets the same segmentation, and at rate 0 it is the
model's own. Dropout never changes what the pieces spell, so decoding gives back the text whatever was skipped.

Chunks are runs of spaces with the characters after them, cut at line ends: no piece spans two of them. A chunk is cut
further between characters that are neighbours in no piece. Bounded tables of a task keep the ids of chunks without a
skip, and of parts by the places of their skips: what a draw gives is looked up, the draw itself is not kept.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RATE, SEED = 0.1, 20_240
#: Chunks, and parts with skips, whose ids a task keeps (emptied when full), and the longest of them.
CACHE_MOST, PARTS_MOST, CACHE_CHARS = 400_000, 600_000, 48
NEVER = 1 << 62
SPACE = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece_id = {sp.id_to_piece(i): i for i in plain}
        # pieces by falling score; equal scores share a rank
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {x: r for r, x in enumerate(scores)}
        self.rank = {sp.id_to_piece(i): place[sp.get_score(i)] for i in plain}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) or " " in p or "\n" in p for p in self.piece_id) or any(sp.is_unknown(i) for i in self.byte_id):
            raise ValueError("needs a merge-type model with byte fallback whose pieces hold spaces at their start only")
        self.bytes_of: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i in self.piece_id.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        # no merge crosses two characters that stand side by side in no piece
        self.pairs = frozenset(p[i : i + 2] for p in self.piece_id for i in range(len(p) - 1))
        self.packed = {p: struct.pack("<i", i) for p, i in self.piece_id.items()}
        self.newline = struct.pack("<i", self.byte_id[10])

    def segment(self, chunk: str, left: int, gaps: Iterator[int]) -> tuple[list[str], int, int]:
        """Pieces of one chunk, whose spaces are given as U+2581; how many candidates were taken; merges left before the next skip.

        ``left`` candidates are merged, one is skipped, then as many as the next of ``gaps`` are merged, and so on.
        """
        part = list(chunk)
        n, rank, taken = len(part), self.rank.get, 0
        if n <= CACHE_CHARS:
            # short: the ranks of all neighbours in a list; what is skipped comes back only as another pair
            ranks = [rank(a + b, NEVER) for a, b in zip(chunk, chunk[1:])]  # noqa: B905, RUF007
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                taken += 1
                if not left:
                    left = next(gaps)
                    ranks[i] = NEVER
                    continue
                left -= 1
                part[i] += part.pop(i + 1)
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(part[i] + part[i + 1], NEVER)
                if i:
                    ranks[i - 1] = rank(part[i - 1] + part[i], NEVER)
            return part, taken, left
        # an agenda entry is one integer: rank of the made piece, then place; stale ones no longer make a piece of that rank
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        if not agenda:
            return part, 0, left
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            head = part[i]
            if not head or j >= n or rank(made := head + part[j]) != entry >> 32:
                continue
            taken += 1
            if not left:
                left = next(gaps)
                continue
            left -= 1
            part[i], part[j] = made, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(made + part[k])) is not None:
                    push(agenda, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(part[h] + made)) is not None:
                push(agenda, r << 32 | h)
        return [p for p in part if p], taken, left

    def parts(self, chunk: str) -> list[str]:
        """A chunk cut wherever no piece can span; merging a part needs nothing of the others."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in pairs:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def ids(self, part: str, left: int = NEVER, gaps: Iterator[int] = iter(())) -> tuple[bytes, int, int]:
        """Little-endian 32-bit ids of one part; how many candidates were taken; merges left before the next skip."""
        pieces, taken, left = self.segment(part, left, gaps)
        return b"".join([self.packed.get(p) or struct.pack(f"<{len(b := p.encode())}i", *(self.byte_id[x] for x in b)) for p in pieces]), taken, left

    def decode(self, ids) -> str:
        """Text of a document's ids, without the space that encoding puts before it."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode() if raw else ""


def gaps_of(rate: float, key: int, block: int) -> Iterator[int]:
    """How many merges go before each skip: geometric draws from hashes of key and counter, without end."""
    start = 0
    while True:
        x = np.arange(start, start + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        yield from (np.log1p(-u) / np.log1p(-rate)).astype(np.int64).tolist() if rate < 1 else [0] * block
        start += block


class Segmenter(dict):
    """Chunk -> ids and candidates without a skip, and parts (none listed for one part); ids and candidates of parts by their skips are kept beside it."""

    def __init__(self, codec: PieceCodec, rate: float, key: int):
        self.codec, self.rate, self.key = codec, rate, key
        self.of_part: dict[tuple, tuple[bytes, int]] = {}
        self.literal = struct.pack("<3i", *(codec.byte_id[b] for b in SPACE.encode()))

    def forget(self) -> None:
        self.clear()
        self.of_part.clear()

    def _parts(self, chunk: str) -> list[str]:
        # a U+2581 of the text itself goes by bytes, else it would decode to a space; it is the empty part
        parts: list[str] = []
        for k, run in enumerate(chunk.split(SPACE)):
            parts += [""] if k else []
            parts += self.codec.parts(run.replace(" ", SPACE)) if run else []
        return parts

    def _chunk(self, chunk: str, parts: tuple[str, ...] | list[str] | None, left: int, gaps: Iterator[int], out: list[bytes]) -> int:
        """Append the ids of a chunk that is not kept (its parts are None), or of which candidates are skipped; merges left before the next skip."""
        new = parts is None
        if new:
            parts = self._parts(chunk)
        elif not parts:  # it is one part
            return self._part(chunk.replace(" ", SPACE), left, gaps, out)
        for part in parts:
            if part:
                left = self._part(part, left, gaps, out)
            else:
                out.append(self.literal)
        if new and len(chunk) <= CACHE_CHARS:
            plain = [self.of_part.get((p,)) if p else (self.literal, 0) for p in parts]
            if all(plain):
                if len(self) >= CACHE_MOST:
                    self.clear()
                self[chunk] = b"".join([ids for ids, _ in plain]), sum([n for _, n in plain]), () if len(parts) == 1 and parts[0] else tuple(parts)
        return left

    def _part(self, part: str, left: int, gaps: Iterator[int], out: list[bytes]) -> int:
        """Append the ids of one part as its draws have it; merges left before the next skip."""
        known, key, n = self.of_part, (part,), -1
        if found := known.get(key):
            ids, n = found
            if left >= n:
                out.append(ids)
                return left - n
            key = (part, left)
            if found := known.get(key):
                ids, n = found
                after = left + 1 + (gap := next(gaps))
                if after >= n:
                    out.append(ids)
                    return after - n
                ids, _, left = self.codec.ids(part, left, chain((gap,), gaps))
                out.append(ids)
                return left
        # not kept: segmented with the draws at hand, and kept if no or one candidate was skipped
        drawn: list[int] = []
        first = left
        ids, n, left = self.codec.ids(part, left, self._noted(gaps, drawn))
        if len(part) <= CACHE_CHARS and len(drawn) <= 1:
            if len(known) >= PARTS_MOST:
                known.clear()
            known[(part, first) if drawn else (part,)] = ids, n
        out.append(ids)
        return left

    @staticmethod
    def _noted(gaps: Iterator[int], drawn: list[int]) -> Iterator[int]:
        for g in gaps:
            drawn.append(g)
            yield g

    def encode(self, text: str | None, key: int = 0) -> bytes:
        """Ids of a text; another ``key`` (of the document) draws other skips."""
        if not text:
            return b""
        gaps = gaps_of(self.rate, key ^ self.key, len(text) // 16 + 8)
        left, out, newline, known = next(gaps) if self.rate > 0 else NEVER, [], self.codec.newline, self.get
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                out.append(newline)
            for chunk in self._chunks(line):
                found = known(chunk)
                if found is None:
                    left = self._chunk(chunk, None, left, gaps, out)
                elif found[1] <= left:
                    left -= found[1]
                    out.append(found[0])
                else:
                    left = self._chunk(chunk, found[2], left, gaps, out)
        return b"".join(out)

    @staticmethod
    def _chunks(line: str) -> list[str]:
        if "  " in line or line.endswith(" "):
            return _CHUNK.findall(line)
        first, *rest = line.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest


_CODECS: dict[str, PieceCodec] = {}
_SEGMENTERS: dict[tuple, Segmenter] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def segmenter(path: str, rate: float, seed: int, variant: int = 0) -> Segmenter:
    at = (path, rate, seed, variant)
    if at not in _SEGMENTERS:
        _SEGMENTERS[at] = Segmenter(codec(path), rate, xxhash.xxh64_intdigest(struct.pack("<qi", seed, variant)))
    return _SEGMENTERS[at]


def key_of(doc_id: int | None, text: str | None) -> int:
    """What the skips of a document are drawn from: its id, or its text where it has none."""
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id)) if doc_id is not None else xxhash.xxh64_intdigest((text or "").encode(), 1)


def encode(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, lossless) a row of ``docs`` (doc_id, text; other columns are ignored).

    The model may not normalise texts: its pieces have to spell them as they are, which lossless checks row by row.
    Null and empty texts have no ids. lossless says that the ids decode to the text exactly (an empty one for null).
    Rows are neither moved nor joined: repeated rows and null ids (keyed by their text) stay, an empty table stays empty.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = segmenter(path, rate, seed)
        of, back = kept.encode, codec(path).decode
        gc.disable()  # the tables hold no cycles, and walking through them takes a fifth of the time
        try:
            for batch in small_batches(batches, "text", 4 << 20):
                docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                raw = [of(t, key_of(d, t)) for d, t in zip(docs_, texts, strict=True)]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                ends = np.concatenate(([0], np.cumsum(sizes)))
                same = [back(flat[a:b].tolist()) == (t or "") for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(sizes), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "lossless"])
        finally:
            gc.enable()
            kept.forget()  # an idle worker should not hold the memory that others need

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text, empty ones an empty text.

    An id that the model has no piece for, or bytes that are no UTF-8, fail the job: they are no text's ids. Repeated
    rows and null doc_ids stay; an empty table stays empty.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(path).decode
        for batch in batches:
            texts = [None if i is None else back(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
