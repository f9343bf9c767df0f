"""Queries over rules with severities and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import text as T
from ..operators import rulebook as R
from .text_queries import NOISY_SQL, noisy

_list = lambda *rules: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules) + "], lambda e: e IS NOT NULL), ',')"
_OUT = {
    "empty_output": "trim(text, E' \\t\\n\\r\\x0b\\x0c') = ''", "path_leakage": "(regexp_matches(text, '(?i)\\b[a-z]:[\\\\/][^\\s]+') OR regexp_matches(text, '(^|[^:/.\\w-])(?:/[^/\\s]+){2,}'))", "filename_leakage": f"regexp_matches(text, '{T.FILE_NAME}')",
    "url_leakage": f"regexp_matches(text, '{R.URL}')", "tooling_leakage": f"regexp_matches(text, '{R.TOOLING}')", "anachronism": f"regexp_matches(text, '{R.ANACHRONISM}')",
}
_ADDED = {0: " the wifi manifest ", 1: " in /var/data/run ", 2: " see http://a.example/b now"}


@query(f"""WITH n AS (SELECT doc_id, text || CASE doc_id % 4 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _ADDED.items())} ELSE '' END AS text FROM ({NOISY_SQL})),
r AS (SELECT doc_id, {_list(*[(c, b) for c, b in _OUT.items() if c not in ('anachronism', 'url_leakage')])} AS errors, {_list(('url_leakage', _OUT['url_leakage']))} AS warnings FROM n)
SELECT *, errors = '' AS passed FROM r""")
def output_policy(t: Tables) -> DataFrame:
    """Texts under a policy for modern settings: anachronisms are allowed, addresses only warned of."""
    case = F.lit("")
    for k, v in _ADDED.items():
        case = F.when(F.col("doc_id") % 4 == k, v).otherwise(case)
    policy = R.Policy(frozenset(["anachronism"]), {"url_leakage": R.WARNING})
    judged = R.output_rules().judge(noisy(t).select("doc_id", F.concat("text", case).alias("text")), policy)
    return judged.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "passed")


_RECORD = {
    "record_id": "CASE doc_id % 7 WHEN 0 THEN '  r ' ELSE 'rec-' || doc_id END", "source_id": "CASE doc_id % 5 WHEN 0 THEN NULL ELSE source END", "text": "CASE doc_id % 11 WHEN 0 THEN chr(9) || chr(10) ELSE text END", "domain": "CASE doc_id % 4 WHEN 0 THEN '' ELSE 'd' END",
    "language": "lang", "tone": "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'dry' END", "task_family": "CASE doc_id % 6 WHEN 0 THEN 'dancing' ELSE 'routing' END", "allowed_for_training": "doc_id % 2 = 0", "allowed_for_rag": "CASE WHEN doc_id % 13 > 0 THEN true END",
}
_HASH = "CASE doc_id % 9 WHEN 0 THEN 'sha256:' || upper({0}) WHEN 1 THEN 'sha256:' || {1} ELSE ' sha256:' || {0} || chr(10) END"
_blank = lambda c: f"coalesce(trim({c}, E' \\t\\n\\r\\x0b\\x0c'), '')"
_WRONG = [
    ("record_id", f"length({_blank('record_id')}) < 3"), ("source_id", f"length({_blank('source_id')}) < 3"), ("text", f"{_blank('text')} = ''"), ("domain", f"{_blank('domain')} = ''"), ("language", f"length({_blank('language')}) < 2"), ("tone", "tone = ' '"),
    ("task_family", "task_family = 'dancing'"), ("use_flags", "allowed_for_rag IS NULL"), ("hash_format", "doc_id % 9 = 0"),
]


@query(f"""WITH r AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _RECORD.items())} FROM documents)
SELECT doc_id, {_list(*_WRONG)} AS errors, CASE WHEN doc_id % 9 = 1 THEN 'hash_of_text' ELSE '' END AS warnings FROM r""")
def training_records_given(t: Tables) -> DataFrame:
    """Training records by the fields that they come with, the hash among them."""
    rows = t.documents.selectExpr("doc_id", *[f"{v} AS {k}" for k, v in _RECORD.items()])
    own, other = "sha2(text, 256)", "sha2(concat(text, '.'), 256)"
    rows = rows.withColumn("content_hash", F.expr(_HASH.format(own, other)))
    judged = R.training_rules().judge(rows)
    return judged.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH m AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'PLAYER_PRIVATE' WHEN 'system' THEN 'DM_PRIVATE' ELSE CASE turn % 3 WHEN 0 THEN 'PUBLIC' ELSE 'SECRET' END END AS scope, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'p' || conv_id END AS owner_id, turn AS sequence_number FROM conversations)
SELECT conv_id, turn, {_list(('scope', "scope = 'SECRET'"), ('owner', "scope = 'PLAYER_PRIVATE' AND coalesce(owner_id, '') = ''"), ('sequence', 'sequence_number < 1'), ('text', _blank('text') + " = ''"))} AS errors FROM m""")
def memory_contract(t: Tables) -> DataFrame:
    """Turns as memories: private ones need an owner."""
    scope = F.when(F.col("role") == "user", "PLAYER_PRIVATE").when(F.col("role") == "system", "DM_PRIVATE").when(F.col("turn") % 3 == 0, "PUBLIC").otherwise("SECRET")
    owner = F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, F.concat(F.lit("p"), "conv_id"))
    rows = t.conversations.select("conv_id", "turn", "text", scope.alias("scope"), owner.alias("owner_id"), F.col("turn").alias("sequence_number"))
    return R.memory_rules().judge(rows).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))
