"""Validation rules with a severity, registered by name, and policies that switch them off or change what they weigh."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .governance import Rules

ERROR, WARNING = "error", "warning"
SPACE = r"^\s*$"


@dataclass(frozen=True)
class Policy:
    """``allowed`` rules are not applied; ``severity`` gives rules another weight than their own."""

    allowed: frozenset[str] = frozenset()
    severity: Mapping[str, str] = field(default_factory=dict)


class Rulebook:
    """Rules in the order of their registration; a condition that is null does not fail."""

    def __init__(self) -> None:
        self._rules: dict[str, tuple[str, Callable[[], Column]]] = {}

    def rule(self, code: str, severity: str = ERROR) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
        """Register a function that gives the failing condition; a code can be taken once."""
        if severity not in (ERROR, WARNING):
            raise ValueError(f"{code}: {severity} is no severity")

        def register(bad: Callable[[], Column]) -> Callable[[], Column]:
            if code in self._rules:
                raise ValueError(f"two rules are named {code}")
            self._rules[code] = (severity, bad)
            return bad

        return register

    @classmethod
    def of(cls, rules: Rules, warnings: Iterable[str] = ()) -> Rulebook:
        made, weak = cls(), set(warnings)
        for code, bad in rules:
            made.rule(code, WARNING if code in weak else ERROR)(lambda bad=bad: bad)
        return made

    def codes(self) -> list[str]:
        return list(self._rules)

    def judge(self, df: DataFrame, policy: Policy = Policy()) -> DataFrame:
        """``df`` with errors and warnings (arrays of codes) and passed (no error); each condition is evaluated once."""
        if lost := (policy.allowed | set(policy.severity)) - set(self._rules):
            raise ValueError(f"no such rules: {', '.join(sorted(lost))}")
        held = {code: (policy.severity.get(code, severity), bad) for code, (severity, bad) in self._rules.items() if code not in policy.allowed}
        pick = lambda level: F.array_compact(F.array(*[F.when(bad(), F.lit(code)) for code, (severity, bad) in held.items() if severity == level])).cast("array<string>")
        judged = df.withColumns({"errors": pick(ERROR), "warnings": pick(WARNING)})
        return judged.withColumn("passed", F.size("errors") == 0)


# Words and patterns of texts that show where they come from, or what their time can't know.
TOOLING = r"(?i)\b(?:manifest|pipeline|watchdog)\b"
ANACHRONISM = r"(?i)\b(?:email|google|internet|laptop|podcast|smartphone|streaming|usb|wi-fi|wifi)\b"
URL = r"(?i)\b(?:https?://|www\.)\S+\b"
PATH = r"(?i)\b[a-z]:[\\/][^\s]+|(?<![:/.\w-])(?:/[^/\s]+){2,}"
HASH = r"^sha256:[a-f0-9]{64}$"


def output_rules(text: str = "text") -> Rulebook:
    """What a text that is shown may not hold."""
    x = F.col(text)
    return Rulebook.of([
        ("empty_output", F.coalesce(x, F.lit("")).rlike(SPACE)), ("path_leakage", x.rlike(PATH)), ("filename_leakage", x.rlike(T.FILE_NAME)), ("url_leakage", x.rlike(URL)),
        ("tooling_leakage", x.rlike(TOOLING)), ("anachronism", x.rlike(ANACHRONISM)),
    ])


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def training_rules() -> Rulebook:
    """Rules of a training record: lengths of the stripped fields, the task, and the hash that is given, which has to be the text's."""
    size = lambda c: F.coalesce(F.char_length(stripped(F.col(c))), F.lit(0))
    c = F.col
    return Rulebook.of([
        ("record_id", size("record_id") < 3), ("source_id", size("source_id") < 3), ("text", size("text") < 1), ("domain", size("domain") < 1), ("language", size("language") < 2),
        ("tone", c("tone").isNotNull() & (size("tone") < 1)), ("task_family", ~F.coalesce(c("task_family"), F.lit("")).isin("narration", "teaching", "reasoning", "routing")),
        ("use_flags", c("allowed_for_training").isNull() | c("allowed_for_rag").isNull()), ("hash_format", ~F.coalesce(stripped(c("content_hash")), F.lit("")).rlike(HASH)),
        ("hash_of_text", stripped(c("content_hash")).rlike(HASH) & (stripped(c("content_hash")) != F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)))),
    ], warnings=["hash_of_text"])


def memory_rules() -> Rulebook:
    """Rules of a memory: what is private to a player has an owner, and places in the sequence count from 1."""
    c = F.col
    return Rulebook.of([
        ("scope", ~F.coalesce(c("scope"), F.lit("")).isin("PUBLIC", "PARTY", "PLAYER_PRIVATE", "DM_PRIVATE")), ("owner", (c("scope") == "PLAYER_PRIVATE") & F.coalesce(c("owner_id"), F.lit("")).rlike("^$")), ("sequence", c("sequence_number") < 1), ("text", F.coalesce(c("text"), F.lit("")).rlike(SPACE)),
    ])


def answers(content: Column, expects_json: Column, keyed: Column, df: DataFrame) -> DataFrame:
    """``df`` with passed: JSON answers by their keys, prose by the output rules."""
    prose = output_rules("_prose").judge(df.withColumn("_prose", content)).withColumnRenamed("passed", "_sound")
    return prose.withColumn("passed", F.when(expects_json, keyed).otherwise(F.col("_sound"))).drop("_prose", "_sound", "errors", "warnings")
