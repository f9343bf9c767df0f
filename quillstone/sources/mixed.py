"""A data source over folders of mixed files: text, JSON, JSON lines and HTML, told apart by what is in them.

    spark.dataSource.register(MixedFiles)
    spark.read.format("mixed_files").option("path", folder).load()

Partitions are planned by bytes: small files share one, JSON lines of any size are cut at lines. A file or record that
can't be read gives a row with its error, and the others are read all the same.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.chunking import json_text
from ..functions.html import parse

SCHEMA = "path string, kind string, at long, n_bytes long, title string, text string, error string"
#: Bytes of a partition, unless the option ``bytes`` says otherwise.
PART_BYTES = 16 << 20
#: Bytes that tell what a file is, unless it begins with an object.
HEAD_BYTES = 4096
SUFFIXES = {"html": "html", "htm": "html", "xhtml": "html", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "md": "text", "markdown": "text"}
_MARKUP = re.compile(rb"\s*(?:<!doctype html|<html|<head|<body|<article|<div|<p[\s>])", re.IGNORECASE)
#: Fields of a record that hold its text and title, in order of preference.
TEXT_FIELDS, TITLE_FIELDS = ("text", "content", "page_content", "body", "desc"), ("title", "name", "heading")
#: What is cut off around a field's value; other white space, as U+00A0, belongs to it.
WHITE = " \t\n\r\x0b\x0c"


def sniff(path: str, head: bytes) -> str:
    """html, json, jsonl or text, by suffix or else by content; JSON lines may go by any suffix but those of HTML and Markdown, which may begin with markup or braces."""
    kind = SUFFIXES.get(path.rpartition("/")[2].rpartition(".")[2].lower())
    head = head.removeprefix(b"\xef\xbb\xbf")
    if kind == "text":
        return kind
    if kind == "html" or kind is None and _MARKUP.match(head):
        return "html"
    if head.lstrip()[:1] == b"{":
        first, _, more = head.lstrip().partition(b"\n")
        try:
            if isinstance(json.loads(first), dict) and (more.lstrip()[:1] == b"{" or kind != "json"):
                return "jsonl"
        except ValueError:
            pass
        return kind or ("json" if b'"' in head else "text")
    return kind or "text"


def head_of(source, most: int) -> bytes:
    """The bytes that tell what a file is: of one that begins with an object also its first line, however long, up to what follows or about ``most`` bytes."""
    head = source.read(HEAD_BYTES)
    while len(head) < most:
        body = head.removeprefix(b"\xef\xbb\xbf").lstrip()
        if body[:1] != b"{" or body.partition(b"\n")[2].strip() or not (more := source.read(len(head))):
            break
        head += more
    return head


@dataclass
class Files(InputPartition):
    """Pieces of files: (path, size of the file, first byte, end)."""

    pieces: tuple[tuple[str, int, int, int], ...]


def plan(sizes: list[tuple[str, int]], most: int, lines: set[str]) -> list[Files]:
    """Deal files into partitions of about ``most`` bytes; those in ``lines`` may be cut."""
    out, now, total = [], [], 0
    for path, size in sorted(sizes):
        cuts = range(0, size, most) if path in lines else [0]
        for start in cuts or [0]:
            end = min(start + most, size) if path in lines else size
            if now and total + end - start > most:
                out.append(Files(tuple(now)))
                now, total = [], 0
            now.append((path, size, start, end))
            total += end - start
    return out + ([Files(tuple(now))] if now else [])


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root.replace("file:", "file://", 1) if re.match("file:/[^/]", root) else root if "://" in root else f"file://{root}")


def _first(record: dict, names: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(name, value) of the first field that holds more than white space."""
    return next(((n, x) for n in names if isinstance(record.get(n), str) and (x := record[n].strip(WHITE))), (None, None))


def of_json(raw: bytes) -> tuple[str | None, str]:
    """(title, text) of a JSON value; raises ValueError. Where a field for the text is there and blank, the title is not taken for text."""
    text = raw.decode()
    value = json.loads(text)
    if not isinstance(value, dict):
        return None, json_text(text)
    (named, title), (_, found) = _first(value, TITLE_FIELDS), _first(value, TEXT_FIELDS)
    if found is None and any(isinstance(value.get(n), str) for n in TEXT_FIELDS):
        text = json.dumps({k: v for k, v in value.items() if k != named})
    return title, json_text(text) if found is None else found


def of_text(raw: bytes) -> tuple[str | None, str]:
    return None, raw.decode()


def of_html(raw: bytes) -> tuple[str | None, str]:
    title, _, text, _ = parse(raw.decode("utf-8", "replace"))
    return title or None, text


class MixedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["path"], int(options.get("bytes", PART_BYTES))

    def partitions(self) -> list[Files]:
        fs, root = _open(self.root)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not re.search(r"(?:^|/)[._]", f.path.removeprefix(root).lstrip("/"))]
        lines = set()
        for f in found:
            if f.size > self.most:  # only these are worth a look before they are read
                with fs.open_input_stream(f.path) as source:
                    if sniff(f.path, head_of(source, self.most)) == "jsonl":
                        lines.add(f.path)
        return plan([(f.path, f.size) for f in found], self.most, lines)

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _open(self.root)
        for path, size, start, end in partition.pieces:
            kind = None
            try:
                with io.BufferedReader(fs.open_input_file(path), 1 << 20) as source:
                    kind = sniff(path, head_of(source, size))
                    if kind == "jsonl":
                        yield from self._lines(source, path, start, end)
                    else:
                        source.seek(0)
                        raw = source.read(size)
                        title, text = {"json": of_json, "html": of_html, "text": of_text}[kind](raw)
                        yield path, kind, 0, len(raw), title, text, None
            except (ValueError, OSError) as e:
                yield path, kind, start, size, None, None, f"{type(e).__name__}: {e}"[:300]

    @staticmethod
    def _lines(source, path: str, start: int, end: int) -> Iterator[tuple]:
        """Records of the lines that begin in [start, end)."""
        source.seek(max(start - 1, 0))
        at = start
        if start:
            at = start - 1 + len(source.readline())  # the line that holds the byte before belongs to the piece before
        while at < end and (line := source.readline()):
            begin, at = at, at + len(line)
            if not line.strip():
                continue
            try:
                title, text = of_json(line.removeprefix(b"\xef\xbb\xbf") if not begin else line)
                yield path, "jsonl", begin, len(line.rstrip(b"\r\n")), title, text, None
            except ValueError as e:
                yield path, "jsonl", begin, len(line), None, None, f"{type(e).__name__}: {e}"[:300]


class MixedFiles(DataSource):
    """See the module; options: path, bytes."""

    @classmethod
    def name(cls) -> str:
        return "mixed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MixedReader:
        return MixedReader(self.options)
