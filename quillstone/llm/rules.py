"""Quality rules as a bitmask ledger, in DataFrame expressions alone.

Every rule is evaluated once for a document; the ledger keeps the measurements and one bit a rule (set: failed). A
policy is a named, versioned mask over those bits, so policies are applied, compared and ablated by bitwise operations
on the ledger without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, whole_row

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


#: The order fixes the bits: append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("shouting", "n_upper > n_lower"),
    Rule("often_repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("some_symbols", "20 * n_symbols > n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document that fails one of them is rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting"))
#: The next version, on trial: two rules more, which the ledger has bits for already.
STRICT = Policy("standard", 2, (*STANDARD.rules, "often_repeated_windows", "some_symbols"))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements as longs beside its columns, which keep their values.

    Words are runs of characters other than the bytes 09-0D and 20. Null and blank texts measure 0 throughout.
    Needs a column text; columns of ``docs`` named like a measurement are replaced.
    """
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    d = docs.select(whole_row(docs).alias("_row"))
    d = d.select("_row", text.alias("_t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"))
    n = F.size("_w")
    window = lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    d = d.select("_row", "_t", "_w", "_l", F.array_sort(F.slice(F.transform("_w", window), 1, F.greatest(n - 2, F.lit(0)))).alias("_s"))
    again = lambda x, i: F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("_s", again), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("c"))
    d = d.select("_row", "_t", "_w", "_l", F.aggregate(at, start, lambda a, p: F.struct(p.alias("p"), (a["c"] + F.least(F.lit(3), p - a["p"])).alias("c")), lambda a: a["c"]).alias("_r"))
    # always 0; not being deterministic, it keeps filters on measurements above this projection, where they would be
    # replaced by the expressions themselves, to be evaluated once an element
    barrier = F.least(F.spark_partition_id(), F.lit(0))
    made = {
        "n_words": F.size("_w") + barrier,
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.col("_r"),
        "n_upper": F.regexp_count("_t", F.lit("[A-Z]")),
        "n_lower": F.regexp_count("_t", F.lit("[a-z]")),
    }
    return d.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in made], *[v.cast("long").alias(k) for k, v in made.items()])


def ledger(docs: DataFrame) -> DataFrame:
    """:func:`measure` with ``fail_bits``: every rule evaluated once, one bit each."""
    bits = [F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(F.lit(0)) for r in RULES]
    total: Column = F.lit(0)
    for b in bits:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total.cast("long"))


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Ledger entries with kept, and the policy and version that decided."""
    return entries.withColumns({"kept": ~fails(policy), "policy": F.lit(policy.name), "policy_version": F.lit(policy.version)})


def ablate(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those it alone rejects. One pass, one row a task is moved."""
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = [x for r in policy.rules for x in (F.count_if(held.bitwiseAND(F.lit(BIT[r])) != 0).alias(f"{r}_f"), F.count_if(held == BIT[r]).alias(f"{r}_a"))]
    one = entries.agg(*sums, F.count_if(held != 0).alias("_rejected"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_f").alias("n_failed"), F.col(f"{r}_a").alias("n_alone"), F.col("_rejected").alias("n_rejected")) for r in policy.rules])
    return one.select(F.inline(rows))


def compare(entries: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """How many documents each of two policies keeps, by both verdicts."""
    return entries.groupBy((~fails(old)).alias("kept_before"), (~fails(new)).alias("kept_after")).count()


def sole_rule(policy: Policy, bits: str = "fail_bits") -> Column:
    """The bit of the only rule of a policy that a document fails, else 0: without that rule the document would be kept."""
    held = F.col(bits).bitwiseAND(F.lit(policy.mask))
    return F.when(F.bit_count(held) == 1, held).otherwise(F.lit(0)).cast("long")


def store(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs`` (doc_id, text), written to the shared folder: ids, all measurements and bits, no texts."""
    return Workspace(docs.sparkSession, "rules").table(ledger(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "ledger")


def judge(docs: DataFrame, policies: tuple[Policy, Policy] = (STANDARD, STRICT)) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the measurements, base_failed, kept, fail_bits, kept_strict, sole_bit, sole_docs.

    The ledger is stored first; all verdicts and the ablation come from what is stored. kept is the first policy's
    verdict and kept_strict the second's, both false where a base rule fails. sole_bit is the bit of the only rule of
    the first policy that a document fails (else 0), and sole_docs how many documents that rule alone rejects. Rows are
    not joined with each other: repeated rows and null ids stay, an empty table gives an empty one. Null and blank texts
    fail the base rule on words.
    """
    entries = store(docs)
    alone = ablate(entries, policies[0]).select(F.element_at(F.create_map(*[x for r in policies[0].rules for x in (F.lit(r), F.lit(BIT[r]))]), F.col("rule")).cast("long").alias("bit"), "n_alone")
    kept = [~fails(BASE) & ~fails(p) for p in policies]
    found = entries.select("doc_id", *MEASURES, fails(BASE).alias("base_failed"), kept[0].alias("kept"), "fail_bits", kept[1].alias("kept_strict"), sole_rule(policies[0]).alias("sole_bit"))
    # a row a rule: its size is the number of rules
    joined = found.join(F.broadcast(alone), F.col("sole_bit") == F.col("bit"), "left")
    return joined.select(*found.columns, F.coalesce("n_alone", F.lit(0)).cast("long").alias("sole_docs"))


def keep(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the policy, with their columns as they were.

    Null and blank texts go (they have too few words); repeated rows and null ids stay; an empty table stays empty.
    """
    packed = docs.select(whole_row(docs).alias("row"), "text")
    found = ledger(packed).filter(~fails(BASE) & ~fails(policy))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same ledger for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN n_upper > n_lower THEN 32 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 64 ELSE 0 END)
             + (CASE WHEN 20 * n_symbols > n_words THEN 128 ELSE 0 END) AS fail_bits FROM m),
s AS (SELECT *, CASE WHEN (fail_bits & 63) IN (1, 2, 4, 8, 16, 32) THEN fail_bits & 63 ELSE 0 END AS sole_bit FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_lines::BIGINT AS n_lines,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_upper::BIGINT AS n_upper, n_lower::BIGINT AS n_lower,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits::BIGINT AS fail_bits, fail_bits = 0 AS kept_strict,
       sole_bit::BIGINT AS sole_bit, (CASE WHEN sole_bit = 0 THEN 0 ELSE count(*) OVER (PARTITION BY sole_bit) END)::BIGINT AS sole_docs FROM s
"""
