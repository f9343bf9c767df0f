"""A table whose versions are committed by compare and set.

Data files of a version lie in a folder of their own; the version exists once its commit file does, which is made by one
put-if-absent. Of two writers that start from the same version one makes the file; the other reads the new version and
applies its change again, so no change is lost and readers only ever see whole versions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

#: Times that a change is applied anew because another writer was faster.
TRIES = 50


class CommitConflict(RuntimeError):
    """Every try found another writer's version."""


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make the file ``path`` with ``data`` in one step; False, and nothing changed, if it is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(data)
    out.close()
    try:
        if fs.getScheme() == "file":  # Hadoop's local rename is no atomic put, a hard link is
            local = [jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString() for p in (draft, target)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            if fs.exists(target):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


class VersionedTable:
    """A table with numbered versions from 1 on, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> dict[int, str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {int(n): f"{self.path}/commits/{n}" for n in found if n.isdigit()}

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self._commits(), default=0)

    def folder(self, version: int) -> str:
        """Where the data files of a version lie."""
        return f"{self.path}/{self.spark.read.text(self._commits()[version]).first().value}"

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version, the newest unless given; None before the first."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(self.folder(version)) if version else None

    def commit(self, folder: str, base: int) -> bool:
        """Make ``folder`` (below ``path``) the version after ``base``; False if another writer has made it."""
        return put_if_absent(self.spark, f"{self.path}/commits/{base + 1:020d}", folder.encode())

    def update(self, change: Callable[[DataFrame | None, str], object]) -> tuple[int, object]:
        """Apply ``change`` to the newest version until it is committed; (version, what the change that counts returned).

        ``change(now, to)`` gets the table and a fresh folder to write the next one to; it may be called several times.
        """
        for _ in range(TRIES):
            base, folder = self.version(), f"data/{uuid.uuid4().hex}"
            result = change(self.read(base) if base else None, f"{self.path}/{folder}")
            if self.commit(folder, base):
                return base + 1, result
        raise CommitConflict(f"{self.path}: {TRIES} tries met other writers")


class SessionStore(VersionedTable):
    """Sessions with revisions: (session_id, revision, payload, payload_sha256)."""

    def sessions(self) -> DataFrame:
        version = self.version()
        return sinks.read_sessions(self.spark, self.folder(version)) if version else self.spark.createDataFrame([], "session_id long, revision long, payload string, payload_sha256 string")

    def save(self, attempts: DataFrame) -> DataFrame:
        """Save ``attempts`` (session_id, expected, payload); (session_id, outcome, revision) as :func:`.sinks.save_sessions`.

        An attempt fits or conflicts by the revision stored at the commit, whoever else writes meanwhile.
        """
        empty = self.spark.createDataFrame([], "session_id long, revision long, payload string, payload_sha256 string")
        _, outcome = self.update(lambda now, to: sinks.save_sessions(empty if now is None else now.filter(F.col("revision").isNotNull()).select(*empty.columns), attempts, to))
        return outcome
