"""Driver-side services around the frames: registries, degraded search, a query cache, jobs and a crawl loop."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[DataFrame, DataFrame, int], DataFrame]


class Registry:
    """Named handlers: backends, rerankers, rules, jobs. A name can be taken once."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def add(self, name: str, item: object) -> None:
        if name in self._items:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._items[name] = item

    def get(self, name: str) -> object:
        if name not in self._items:
            raise KeyError(f"no {self.kind} {name!r}")
        return self._items[name]

    def names(self) -> list[str]:
        return list(self._items)


@dataclass
class CorpusRegistry:
    """Corpora by id with version and permission; searches see allowed ones only."""

    versions: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, bool] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, corpus: str, version: str, docs: DataFrame, allowed: bool = True) -> None:
        if corpus in self.frames:
            raise ValueError(f"corpus {corpus!r} is registered already")
        if "corpus" in docs.columns and docs.filter(~F.col("corpus").eqNullSafe(F.lit(corpus))).take(1):
            raise ValueError(f"documents of another corpus than {corpus!r}")
        self.versions[corpus], self.allowed[corpus] = version, allowed
        self.frames[corpus] = docs.withColumn("corpus", F.lit(corpus))

    def scope(self, corpus: str | None = None) -> list[str]:
        if corpus is None:
            return [c for c, ok in self.allowed.items() if ok]
        if not self.allowed.get(corpus):
            raise KeyError(f"corpus {corpus!r} is not registered or not allowed")
        return [corpus]


def cache_key(request: dict) -> str:
    """SHA-256 of the request as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class QueryCache:
    """Results by key until their time is over; can be emptied for one corpus."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._held = seconds, clock, {}

    def get(self, key: str) -> object | None:
        until, _, value = self._held.get(key, (0.0, None, None))
        if until <= self.clock():
            self._held.pop(key, None)
            return None
        return value

    def put(self, key: str, value: object, corpus: str | None = None) -> None:
        self._held[key] = (self.clock() + self.seconds, corpus, value)

    def drop(self, corpus: str | None = None) -> None:
        self._held = {k: v for k, v in self._held.items() if corpus is not None and v[1] != corpus}


def search_all(backends: dict[str, Backend], docs: DataFrame, queries: DataFrame, k: int) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """Results of the backends that answer, and a diagnosis of each. Fails only if none answers."""
    found, said = {}, {}
    for name, backend in backends.items():
        try:
            found[name] = backend(docs, queries, k)
            said[name] = {"available": True, "message": ""}
        except Exception as e:  # noqa: BLE001 - a backend may fail in any way; that is what degraded means
            said[name] = {"available": False, "message": str(e)}
    if not found:
        raise RuntimeError("all search backends are down: " + "; ".join(v["message"] for v in said.values()))
    return found, said


@dataclass
class Job:
    """A job of the scheduler; ``next_run`` and ``every`` are seconds."""

    name: str
    kind: str
    next_run: float
    every: float
    depends: tuple[str, ...] = ()
    retries: int = 3
    backoff: float = 60.0
    failures: int = 0


def run_due(jobs: list[Job], handlers: Registry, done: set[str], now: float) -> list[tuple[str, str]]:
    """Run the jobs that are due and whose dependencies have run; reschedule them, or back off after a failure."""
    log = []
    for job in sorted((j for j in jobs if j.next_run <= now), key=lambda j: (j.next_run, j.name)):
        if not set(job.depends) <= done:
            log.append((job.name, "waiting"))
            continue
        try:
            handlers.get(job.kind)(job)
        except Exception as e:  # noqa: BLE001 - whatever a handler raises counts as a failed run
            job.failures += 1
            job.next_run = now + (job.backoff * 2 ** (job.failures - 1) if job.failures <= job.retries else job.every)
            log.append((job.name, f"failed: {e}"))
            continue
        job.failures, job.next_run = 0, now + job.every
        done.add(job.name)
        log.append((job.name, "completed"))
    return log


def crawl(edges: DataFrame, seeds: DataFrame, table: Callable[[DataFrame, int], DataFrame], most_depth: int = 10) -> DataFrame:
    """(url, depth) of pages reached from the seeds over (url, target), breadth first; each page once, at its least depth.

    ``table`` writes a round's frame and returns the written table, which cuts the lineage.
    """
    seen = table(seeds.select("url", F.lit(0).alias("depth")).distinct(), 0)
    frontier = seen
    for depth in range(1, most_depth + 1):
        reached = edges.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct()
        frontier = table(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), depth)
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen
