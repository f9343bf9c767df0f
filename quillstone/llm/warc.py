"""WARC archives in zstandard: a dictionary in the leading skippable frame, then one frame a record.

An archive starts with a skippable frame 0x184D2A5D that holds a dictionary trained on the first pages of the task
(SAMPLE_BYTES at most); where those are too few to train on, the frame is empty and no dictionary is used. Each record
is one zstandard frame with a content checksum. The reader streams: it holds one chunk of the file and the header of
one record, hashes the block as it comes and checks version, header fields, lengths, digests and the end of the record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, Workspace, as_bytes, hot_join, make_dirs, open_fs, small_batches

DICT_MAGIC = 0x184D2A5D
SAMPLE_BYTES, DICT_BYTES, LEVEL, CHUNK = 1 << 20, 32 << 10, 3, 1 << 20
#: Bytes of html after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int, url: str | None, payload: bytes, kind: str, payload_digest: str, refers_to: int | None) -> bytes:
    """Bytes of one record. A revisit holds the response's HTTP header, with its length, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ID_PREFIX}{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, sink, samples: list[bytes]):
        trained = None
        if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICT_BYTES:
            try:
                trained = zstandard.train_dictionary(DICT_BYTES, samples)
            except zstandard.ZstdError:  # samples without anything in common
                trained = None
        raw = trained.as_bytes() if trained else b""
        sink.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True).compress

    def add(self, data: bytes) -> None:
        self.sink.write(self.pack(data))


class BadArchive(ValueError):
    """An archive breaks its format."""


def frames(source) -> Iterator[Iterator[bytes]]:
    """For each record frame, its decompressed pieces. A frame has to be read to its end before the next."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICT_MAGIC:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack("<II", head)[1]
    raw = source.read(size)
    if len(raw) != size:
        raise BadArchive("short dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""

    def pieces() -> Iterator[bytes]:
        nonlocal left
        one = unpack.decompressobj()
        while not one.eof:
            data = left or source.read(CHUNK)
            left = b""
            if not data:
                raise BadArchive("the last frame is cut off")
            try:
                out = one.decompress(data)
            except zstandard.ZstdError as e:
                raise BadArchive(f"damaged frame: {e}") from e
            if out:
                yield out
        left = one.unused_data

    while True:
        left = left or source.read(CHUNK)
        if not left:
            return
        yield pieces()


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise BadArchive(f"{what}: broken field {line[:80]!r}")
        found[name.decode().lower()] = value.strip().decode()
    return found


def _take_head(data: bytearray, pieces: Iterator[bytes], what: str) -> list[bytes]:
    """Lines up to the empty line; what follows stays in ``data``."""
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = next(pieces, None)
        if more is None:
            raise BadArchive(f"{what} without an end")
        data += more
    lines = bytes(data[:end]).split(b"\r\n")
    del data[: end + 4]
    return lines


def read_record(pieces: Iterator[bytes]) -> dict:
    """Check one record and tell its id, type, url, what it refers to, payload length and digest."""
    data = bytearray()
    version, *lines = _take_head(data, pieces, "a record header")
    if version != VERSION:
        raise BadArchive(f"version {version[:40]!r}")
    head = _fields(lines, "record header")
    if missing := [k for k in _NEEDED if not head.get(k)]:
        raise BadArchive(f"no {', '.join(missing)}")
    if not head["content-length"].isdigit():
        raise BadArchive("Content-Length is no number")
    size, whole, body, n_body, n = int(head["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, 0
    http_lines: list[bytes] | None = None
    http, tail = bytearray(), bytearray()
    for piece in chain([bytes(data)], pieces):
        part = piece[: size - n]
        n += len(part)
        tail += piece[len(part) :]
        whole.update(part)
        if http_lines is None:
            http += part
            if (end := http.find(b"\r\n\r\n")) >= 0:
                http_lines, part = bytes(http[:end]).split(b"\r\n"), bytes(http[end + 4 :])
        if http_lines is not None:
            body.update(part)
            n_body += len(part)
    if n != size or tail != b"\r\n\r\n":
        raise BadArchive(f"block of {n} bytes with {bytes(tail[:8])!r} after it; Content-Length is {size}")
    if http_lines is None or not http_lines[0].startswith(b"HTTP/"):
        raise BadArchive("no HTTP header in the block")
    said = _fields(http_lines[1:], "HTTP header").get("content-length", "")
    if head.get("warc-block-digest") != f"sha1:{base64.b32encode(whole.digest()).decode()}":
        raise BadArchive("the block digest doesn't match")
    kind, of_payload = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if said != str(n_body) or of_payload != base64.b32encode(body.digest()).decode():
            raise BadArchive("the payload's length or digest doesn't match")
    elif kind == "revisit":
        if n_body or not said.isdigit() or head.get("warc-profile") != REVISIT_PROFILE or not head.get("warc-refers-to") or not of_payload:
            raise BadArchive("broken revisit record")
    else:
        raise BadArchive(f"unknown type {kind}")
    number = lambda x: int(x.strip("<>").removeprefix(ID_PREFIX)) if x else None
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": int(said), "payload_digest": of_payload, "record_type": kind, "refers_to": number(head.get("warc-refers-to"))}


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def first_pages(pages: DataFrame, min_bytes: int, work: Workspace) -> DataFrame:
    """``pages`` (page_id, url, html) with first_page: for a revisit the smallest page_id with an equal payload of at least ``min_bytes`` bytes, else null.

    Payloads are compared by SHA-256. Counting adds up before the shuffle, and the digests of groups of two or more are
    joined with ids and digests alone, hot groups spread. Pages then meet their decision by id and digest, so that rows
    of one page_id with different payloads keep their own; that is the one shuffle of payloads.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    key = F.when(F.octet_length(payload) >= min_bytes, F.unhex(F.sha2(payload, 256)))
    ids = work.table(pages.select("page_id", key.alias("key")), "keys")
    groups = ids.filter("key is not null").groupBy("key").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).filter("n > 1")
    groups = work.table(groups, "groups")
    total = ids.count()
    named = hot_join(ids, groups, "key", F.col("n") * HOT_SHARE >= max(total, 1), ["first_page"]).filter("first_page is not null and page_id != first_page")
    later = named.select(F.col("page_id").alias("_p"), F.col("key").alias("_k"), "first_page").distinct()
    return pages.withColumn("key", key).join(later, (F.col("page_id") == F.col("_p")) & (F.col("key") == F.col("_k")), "left").drop("_p", "_k", "key")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns (file, n_records), a row an archive.

    A task begins another archive, with a dictionary of its own, where one holds ``archive_bytes`` of html or more.
    """
    spark, work, most = pages.sparkSession, Workspace(pages.sparkSession, "warc"), archive_bytes or ARCHIVE_BYTES
    make_dirs(folder)
    rows = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marked = first_pages(rows, min_bytes, work)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        parts = (b for b in small_batches(batches, "html") if b.num_rows)
        for first in parts:  # one archive a turn; the rest of it is taken from the same batches
            samples, held = [], 0
            for html in as_bytes(first.column("html")):
                if html and held + len(html) <= SAMPLE_BYTES:
                    samples.append(html)
                    held += len(html)
            name, n, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
            with fs.open_output_stream(name, compression=None) as sink:
                out = ArchiveWriter(sink, samples)
                for batch in chain([first], parts):
                    for page, url, html, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch.column("html")), batch.column("first_page").to_pylist(), strict=True):
                        payload = html or b""
                        out.add(record(page, url, payload, "response" if refers is None else "revisit", digest(payload), refers))
                        n, size = n + 1, size + len(payload)
                    if size >= most:
                        break
            yield pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "n_records": [n]})

    return Workspace(spark, "warc-list").table(marked.mapInArrow(write, "file string, n_records long"), "archives")


def read_archives(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """Every record of the listed archives (file, n_records), checked; raises on the first broken one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for file, n_records in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}", compression=None) as source:
                    seen, rows = 0, []
                    for pieces in frames(source):
                        rows.append(read_record(pieces))
                        seen += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, OUT)
                            rows = []
                    if seen != n_records:
                        raise BadArchive(f"{file}: {seen} records, {n_records} listed")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, OUT)

    OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    archives = max(1, listed.count())
    return listed.repartition(archives, "file").mapInArrow(read, SCHEMA)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: one row a record, columns of SCHEMA.

    Null html is an empty payload and a null url is left out. Rows with a null page_id can't be named by a record id
    and are not written. Repeated rows of one page_id are all written, with one record id; those with equal payloads are
    of one type, others keep their own, and a revisit of a repeated page_id refers to its rows together. White space in
    an url becomes single spaces. Other columns are ignored; an empty table gives no rows.
    """
    folder = Workspace(pages.sparkSession, "warc-files").path("archives")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder, min_bytes))
