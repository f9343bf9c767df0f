"""Token-ID files: one independent zstandard frame a document, with a document index and a trailing seek table.

A shard is, in order:

* frames: little-endian unsigned 32-bit ids of one document (or of a part of FRAME_IDS ids of a longer one);
* a skippable frame 0x184D2A5C with the index: an entry of 12 bytes (int64 doc_id, uint32 frames) a document;
* a skippable frame 0x184D2A5E with the seek table: an entry of 12 bytes (uint32 compressed size, uint32 decompressed
  size, uint32 low half of the XXH64 of the decompressed bytes) a frame, then the footer (uint32 number of frames,
  one byte of flags with bit 7 set for checksums, uint32 0x8F92EAB1).

Plain zstandard readers skip both skippable frames; :class:`ShardReader` reads the tail and then only the frames asked
for. Shards are written under a name of their attempt and listed by the rows that the job returns, so a task that runs
twice leaves a file that nothing lists.
"""

from __future__ import annotations

import gc
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, make_dirs, open_fs, small_batches

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
END_ID = 2
FRAME_IDS = 1 << 24
LEVEL = 1
#: Bytes of text aimed at in a shard, and the chunks and cores whose ids a worker keeps (each emptied when full).
SHARD_BYTES, CACHE_MOST, CORES_MOST = 64 << 20, 600_000, 1_200_000
#: What stands between cores that the library is asked for as one text, and how many they are.
BETWEEN, ASK_CORES = b"|", 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Ids of whole texts by the library, asked once for each distinct core of a white-space delimited chunk.

    Right for tokenizers that drop white space and lower-case: no special string, normalisation or pre-token spans
    ASCII white space, and ASCII punctuation (but for the apostrophe) after an ASCII letter or digit starts a pre-token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of a worker's node have its cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}

        self.between = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids

    def _ask(self, cores: list[bytes]) -> None:
        """Have the ids of ``cores``: of groups joined by BETWEEN, where no core gives that id, else of each alone."""
        joins = len(self.between) == 1
        alone, rest = [c for c in cores if not joins or BETWEEN in c], [c for c in cores if joins and BETWEEN not in c]
        groups = [rest[i : i + ASK_CORES] for i in range(0, len(rest), ASK_CORES)]
        for group, got in zip(groups, self._ids([(b" " + BETWEEN + b" ").join(g) for g in groups]), strict=True):
            at = np.flatnonzero(got == self.between[0])
            if len(at) != len(group) - 1:  # a core gives that id too
                alone += group
                continue
            raw, start = got.tobytes(), 0
            for core, end in zip(group, [*(4 * at).tolist(), len(raw)], strict=True):
                self.cores[core] = raw[start:end]
                start = end + 4
        self.cores.update(zip(alone, (got.tobytes() for got in self._ids(alone)), strict=True))

    def _ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for got in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
            yield np.array(got.ids, "<u4")

    def learn(self, wanted: set[bytes]) -> None:
        """Have the ids of all ``wanted`` chunks in the table."""
        if len(self.chunks) + len(wanted) > CACHE_MOST:
            self.chunks = {}
        if len(self.cores) > CORES_MOST:
            self.cores = {b"": b""}
        parts = {c: split_core(c) for c in wanted.difference(self.chunks)}
        self._ask([*{x for p in parts.values() for x in p}.difference(self.cores, (b"",))])
        cores = self.cores
        self.chunks.update((c, cores[p[0]] + cores[p[1]]) for c, p in parts.items())

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null or empty: none."""
        for start in range(0, len(texts), 64):
            split = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts[start : start + 64]]
            found = [[*map(self.chunks.get, chunks)] for chunks in split]
            gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
            self.learn({chunks[i] for chunks, at in zip(split, gaps, strict=True) for i in at})
            table = self.chunks
            for chunks, ids, at in zip(split, found, gaps, strict=True):
                for i in at:
                    ids[i] = table[chunks[i]]
                yield b"".join(ids)


#: ASCII punctuation but for the apostrophe.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def split_core(chunk: bytes) -> tuple[bytes, bytes]:
    """Core and the ASCII punctuation after it, where the core ends in a letter or digit of ASCII; special strings are left whole."""
    core = chunk.rstrip(_PUNCTUATION)
    if core[-1:].isalnum() and b"<|" not in chunk:
        return core, chunk[len(core) :]
    return chunk, b""


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Writes documents in the order they are given."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.seek, self.index, self.frames = bytearray(), bytearray(), 0

    def add(self, doc_id: int, ids: bytes) -> None:
        step = 4 * FRAME_IDS
        parts = [ids[i : i + step] for i in range(0, len(ids), step)] or [b""]
        for part in parts:
            data = self.pack(part)
            self.sink.write(data)
            self.seek += struct.pack("<III", len(data), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
        self.frames += len(parts)
        self.index += struct.pack("<qI", doc_id, len(parts))

    def close(self) -> None:
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(self.index)) + self.index)
        table = bytes(self.seek) + struct.pack("<IBI", self.frames, 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to the documents of a shard by position; checks every frame it decompresses."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        table_at = end - 9 - 12 * frames - 8
        source.seek(table_at)
        head = struct.unpack("<II", source.read(8))
        if head != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3)
        self.offset = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        source.seek(int(self.offset[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC or int(self.offset[-1]) + 8 + size != table_at:
            raise ValueError("broken document index")
        index = np.frombuffer(source.read(size), np.dtype([("doc", "<i8"), ("frames", "<u4")]))
        self.doc_ids, self.first = index["doc"], np.concatenate(([0], np.cumsum(index["frames"], dtype=np.int64)))
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, at: int) -> bytes:
        """All ids of the document at a position; reads and decompresses its frames alone."""
        out = []
        for f in range(int(self.first[at]), int(self.first[at + 1])):
            self.source.seek(int(self.offset[f]))
            size, full, want = map(int, self.table[f])
            data = self.unpack.decompress(self.source.read(size), max_output_size=max(full, 1)) if full else b""
            if len(data) != full or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != want:
                raise ValueError(f"frame {f} is damaged")
            out.append(data)
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document; shards are in ascending doc_id order."""
        return [*range(int(np.searchsorted(self.doc_ids, doc_id)), int(np.searchsorted(self.doc_ids, doc_id, "right")))]


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards below ``folder`` in ascending doc_id order; returns the manifest.

    The manifest has a row a shard: shard (its rank), file, n_docs, n_ids, first_doc. Null texts hold the end id alone;
    rows with a null doc_id can't be addressed and are not written; repeated rows are written one after another.
    """
    path, spark = path or default_tokenizer(), docs.sparkSession
    make_dirs(folder)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    tail = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        encode, (fs, root) = encoder(path).encode_all, open_fs(folder)
        name, n_docs, n_ids, least = f"{root}/{uuid.uuid4().hex}.ids.zst", 0, 0, first.column("doc_id")[0].as_py()
        gc.disable()  # the tables hold no cycles
        try:
            with fs.open_output_stream(name, compression=None) as sink:
                out = ShardWriter(sink)
                for batch in small_batches(chain([first], batches), "text"):
                    for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(as_bytes(batch.column("text"))), strict=True):
                        ids += tail
                        out.add(doc, ids)
                        n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
                out.close()
        finally:
            gc.enable()
        yield pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "n_docs": [n_docs], "n_ids": [n_ids], "first_doc": [least]})

    ordered = rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id")
    listed = ordered.mapInArrow(write, "file string, n_docs long, n_ids long, first_doc long")
    return Workspace(spark, "ids-manifest").table(listed, "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    The manifest has a row a shard, so its running sum of ids (``start`` of each shard) is taken on the driver.
    """
    shards = sorted(manifest.select("first_doc", "file", "n_ids", "n_docs").collect())
    starts = np.concatenate(([0], np.cumsum([s.n_ids for s in shards], dtype=np.int64)))
    work = [(s.file, int(at), s.n_docs) for s, at in zip(shards, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not work:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for file, start, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{file}") as source:
                    shard = ShardReader(source)
                    if len(shard) != n_docs:
                        raise ValueError(f"{file}: {len(shard)} documents, {n_docs} listed")
                    for at in range(0, n_docs, 20_000):
                        got = [shard.ids(i) for i in range(at, min(n_docs, at + 20_000))]
                        sizes = np.array([len(x) // 4 for x in got], np.int64)
                        begin = start + np.concatenate(([0], np.cumsum(sizes)))
                        start = int(begin[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[at : at + len(got)]), pa.array(begin[:-1]), pa.array(sizes), pa.array([zlib.crc32(x) for x in got], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(work, "file string, start long, n_docs long").repartition(len(work), "file").mapInArrow(read, schema)


def store_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back; see :func:`read_shards`. Empty table: no rows."""
    folder = Workspace(docs.sparkSession, "ids").path("shards")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, path, end_id))
