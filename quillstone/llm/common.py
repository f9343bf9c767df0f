"""Shared plumbing of the training-data operators: column access, files of own formats, Arrow rows; with the core's tables and joins."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import HOT_SHARE, Workspace, hot_join, shared_dir, small_batches

__all__ = ["HOT_SHARE", "Workspace", "as_bytes", "col", "hot_join", "make_dirs", "open_fs", "quoted", "shared_dir", "small_batches", "whole_row"]

def quoted(name: str) -> str:
    """A column's name as SQL reads it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as one struct, which clashes with no other column."""
    return F.struct(*[col(c) for c in df.columns])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI, for executors that write or read files of their own format."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def make_dirs(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of a string column without decoding it."""
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
