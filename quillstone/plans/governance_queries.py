"""Queries over validation, eligibility and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import text as T
from ..operators import governance as G
from .text_queries import NOISY_SQL, noisy

#: A manifest for each source, made from the source's number alike in both engines.
_MANIFEST = """m AS (SELECT source, substr(source, 4)::INT AS i, ['cc-by-4.0', 'unknown', 'owned', 'cc-by-sa-4.0', 'cc0-1.0'][i % 5 + 1] AS license, CASE i % 7 WHEN 3 THEN '' ELSE 'license' END AS rights_basis,
 i % 2 = 0 AS allowed_for_training, i % 3 <> 2 AS allowed_for_rag, ['training_and_retrieval', 'retrieval_only', 'neither'][i % 3 + 1] AS eligibility_class, i % 4 = 0 AS attribution_required, CASE i % 8 WHEN 0 THEN 'by us' ELSE ' ' END AS attribution_text,
 i % 5 = 3 AS share_alike_required, CASE i % 6 WHEN 5 THEN 'odd' ELSE 'approved' END AS review_status, CASE i % 5 WHEN 1 THEN 'quarantined' ELSE 'active' END AS status, i % 9 = 4 AS removal_required, CASE i % 2 WHEN 0 THEN 'http://l' END AS license_url
 FROM (SELECT DISTINCT source FROM documents))"""


def _manifests(t: Tables) -> DataFrame:
    i = F.col("i")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), i % len(xs) + 1)
    m = t.documents.select("source").distinct().withColumn("i", F.expr("try_cast(substr(source, 4) AS int)"))
    return m.withColumns({
        "license": pick("cc-by-4.0", "unknown", "owned", "cc-by-sa-4.0", "cc0-1.0"), "rights_basis": F.when(i % 7 == 3, "").otherwise("license"), "allowed_for_training": i % 2 == 0, "allowed_for_rag": i % 3 != 2,
        "eligibility_class": pick("training_and_retrieval", "retrieval_only", "neither"), "attribution_required": i % 4 == 0, "attribution_text": F.when(i % 8 == 0, "by us").otherwise(" "),
        "share_alike_required": i % 5 == 3, "review_status": F.when(i % 6 == 5, "odd").otherwise("approved"), "status": F.when(i % 5 == 1, "quarantined").otherwise("active"), "removal_required": i % 9 == 4, "license_url": F.when(i % 2 == 0, "http://l"),
    })


_CLASS = "CASE WHEN allowed_for_training AND allowed_for_rag THEN 'training_and_retrieval' WHEN NOT allowed_for_training AND allowed_for_rag THEN 'retrieval_only' WHEN NOT allowed_for_training AND NOT allowed_for_rag THEN 'neither' ELSE 'invalid' END"
_UNKNOWN = "(license IN ('', 'unknown') OR rights_basis IN ('', 'unknown'))"


def _errors(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules) + "], lambda e: e IS NOT NULL), ',')"


_MANIFEST_ERRORS = _errors(
    ("class", f"eligibility_class <> {_CLASS}"), ("review_status", f"NOT review_status IN ('approved', 'pending_review', 'rejected', 'quarantined')"), ("unknown_rights_class", f"{_UNKNOWN} AND eligibility_class <> 'neither'"), ("unknown_rights_status", f"{_UNKNOWN} AND status <> 'quarantined'"),
    ("license_url", f"license IN ('license-grants-training', 'license-grants-retrieval', 'cc0-1.0', 'cc-by-4.0', 'cc-by-sa-4.0', 'ogl-1.0a', 'public-domain') AND license_url IS NULL"), ("attribution_flag", f"license IN ('license-grants-training', 'license-grants-retrieval', 'cc-by-4.0', 'cc-by-sa-4.0', 'ogl-1.0a') AND NOT attribution_required"), ("attribution_text", "attribution_required AND trim(attribution_text) = ''"),
    ("share_alike", f"license = 'cc-by-sa-4.0' AND NOT share_alike_required"),
)


@query(f"WITH {_MANIFEST} SELECT source, {_MANIFEST_ERRORS} AS errors FROM m")
def manifest_validation(t: Tables) -> DataFrame:
    return _manifests(t).select("source", F.array_join(G.errors(G.manifest_rules()), ",").alias("errors"))


@query(f"WITH {_MANIFEST} SELECT source, review_status = 'approved' AND status = 'active' AND NOT removal_required AND NOT {_UNKNOWN} AS collectable FROM m")
def manifest_collectable(t: Tables) -> DataFrame:
    return _manifests(t).select("source", G.collectable().alias("collectable"))


_ELIGIBLE = _errors(("unknown_source", "m.source IS NULL"), ("training_escalation", "wants_training AND NOT allowed_for_training"), ("rag_escalation", "wants_rag AND NOT allowed_for_rag"), ("not_reviewed", "review_status <> 'approved'"), ("removal", "removal_required"))
_RECORDS = "r AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'nowhere' ELSE source END AS source, doc_id % 2 = 0 AS wants_training, doc_id % 3 = 0 AS wants_rag, text FROM documents)"


def _records(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.documents.select("doc_id", F.when(k % 11 == 0, "nowhere").otherwise(F.col("source")).alias("source"), (k % 2 == 0).alias("wants_training"), (k % 3 == 0).alias("wants_rag"), "text")


def _joined(t: Tables) -> DataFrame:
    # a manifest a source; the optimizer broadcasts them while they are few and shuffles them when they are not
    return _records(t).join(_manifests(t).withColumn("known", F.lit(True)), "source", "left")


def _eligibility() -> G.Rules:
    c = F.col
    return [("unknown_source", c("known").isNull()), ("training_escalation", c("wants_training") & ~c("allowed_for_training")), ("rag_escalation", c("wants_rag") & ~c("allowed_for_rag")), ("not_reviewed", c("review_status") != "approved"), ("removal", c("removal_required"))]


@query(f"WITH {_MANIFEST}, {_RECORDS} SELECT doc_id, {_ELIGIBLE} AS errors FROM r LEFT JOIN m USING (source)".replace("m.source IS NULL", "m.i IS NULL"))
def eligibility_join(t: Tables) -> DataFrame:
    return _joined(t).select("doc_id", F.array_join(G.errors(_eligibility()), ",").alias("errors"))


@query(f"WITH {_MANIFEST}, {_RECORDS}, e AS (SELECT {_ELIGIBLE} AS errors FROM r LEFT JOIN m USING (source)) SELECT CASE WHEN errors = '' THEN 'accepted' ELSE 'quarantined' END AS side, errors, count(*) AS n FROM e GROUP BY ALL".replace("m.source IS NULL", "m.i IS NULL"))
def quarantine_split(t: Tables) -> DataFrame:
    good, bad = G.split(_joined(t), _eligibility())
    sides = good.select(F.lit("accepted").alias("side"), F.lit("").alias("errors")).union(bad.select(F.lit("quarantined"), F.array_join("errors", ",")))
    return sides.groupBy("side", "errors").agg(F.count("*").alias("n"))


@query(f"WITH {_MANIFEST}, {_RECORDS} SELECT doc_id FROM r JOIN m USING (source) WHERE {_CLASS} = 'training_and_retrieval' AND NOT {_UNKNOWN} AND NOT removal_required AND review_status = 'approved'")
def export_gate(t: Tables) -> DataFrame:
    c = F.col
    ok = G.all_of(G.derived_class(c("allowed_for_training"), c("allowed_for_rag")) == "training_and_retrieval", ~G.unknown(c("license")), ~G.unknown(c("rights_basis")), ~c("removal_required"), c("review_status") == "approved")
    return _joined(t).filter(c("known")).filter(ok).select("doc_id")


@query(f"WITH {_MANIFEST}, x AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 50 = 0) SELECT doc_id, source IN (SELECT source FROM m WHERE removal_required) AS by_source, sha256(text) IN (SELECT h FROM x) AS by_hash FROM documents WHERE by_source OR by_hash")
def removal_propagation(t: Tables) -> DataFrame:
    gone = _manifests(t).filter("removal_required").select("source", F.lit(True).alias("s"))
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    hashes = d.filter("doc_id % 50 = 0").select("h").distinct().withColumn("x", F.lit(True))
    hit = d.join(gone, "source", "left").join(hashes, "h", "left")
    return hit.select("doc_id", F.coalesce("s", F.lit(False)).alias("by_source"), F.coalesce("x", F.lit(False)).alias("by_hash")).filter("by_source or by_hash")


@query("WITH d AS (SELECT doc_id % 40 AS id, source, sha256(text) AS h FROM documents) SELECT 'id' AS kind, id::VARCHAR AS key, count(DISTINCT h) AS n FROM d GROUP BY id HAVING count(DISTINCT h) > 1 UNION ALL SELECT 'hash', h, count(DISTINCT id) FROM d GROUP BY h HAVING count(DISTINCT id) > 1")
def source_conflicts(t: Tables) -> DataFrame:
    d = t.documents.select((F.col("doc_id") % 40).alias("id"), F.sha2("text", 256).alias("h")).distinct()
    by = lambda kind, key: d.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(kind).alias("kind"), "key", "n")
    return by("id", "id").union(by("hash", "h"))


@query(f"WITH {_MANIFEST} SELECT {_CLASS} AS eligibility_class, count(*) AS n_sources FROM m GROUP BY ALL")
def eligibility_summary(t: Tables) -> DataFrame:
    return _manifests(t).groupBy(G.derived_class(F.col("allowed_for_training"), F.col("allowed_for_rag")).alias("eligibility_class")).agg(F.count("*").alias("n_sources"))


_RECORD_ERRORS = _errors(
    ("url", f"regexp_matches(text, '{T.URL}')"), ("html", f"regexp_matches(text, '{T.TAG}')"), ("boilerplate", "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in T.BOILERPLATE) + ")"),
    ("heading", "heading IS NULL OR heading = ''"), ("char_count", "char_count <> length(text)"), ("oversized", "length(text) > 1800"),
)


@query(f"WITH n AS ({NOISY_SQL}), c AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'H' END AS heading, length(text) + (doc_id % 5 = 0)::INT AS char_count FROM n) SELECT doc_id, {_RECORD_ERRORS} AS errors FROM c")
def record_validation(t: Tables) -> DataFrame:
    k, c = F.col("doc_id"), F.col
    rows = noisy(t).select("doc_id", "text", F.when(k % 4 == 0, "").when(k % 4 > 1, "H").alias("heading"), (F.char_length("text") + (k % 5 == 0).cast("int")).alias("char_count"))
    rules = [("url", c("text").rlike(T.URL)), ("html", c("text").rlike(T.TAG)), ("boilerplate", T.has_boilerplate("text")), ("heading", c("heading").isNull() | (c("heading") == "")), ("char_count", c("char_count") != F.char_length("text")), ("oversized", F.char_length("text") > 1800)]
    return rows.select("doc_id", F.array_join(G.errors(rules), ",").alias("errors"))


_OUT = _errors(
    ("empty_output", "trim(text) = ''"), ("path_leakage", "(regexp_matches(text, '(?i)\\b[a-z]:[\\\\/][^\\s]+') OR regexp_matches(text, '(^|[^:/.\\w-])(?:/[^/\\s]+){2,}'))"), ("filename_leakage", f"regexp_matches(text, '{T.FILE_NAME}')"), ("url_leakage", "regexp_matches(text, '(?i)\\b(?:https?://|www\\.)\\S+\\b')"),
    ("tooling_leakage", "regexp_matches(text, '(?i)\\b(?:manifest|pipeline|watchdog)\\b')"), ("anachronism", "regexp_matches(text, '(?i)\\b(?:email|google|internet|laptop|podcast|smartphone|streaming|usb|wi-fi|wifi)\\b')"),
)


@query(f"WITH n AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' the wifi manifest ' WHEN 1 THEN ' in /var/data/run ' ELSE '' END AS text FROM ({NOISY_SQL})) SELECT doc_id, {_OUT} AS errors FROM n")
def output_validation(t: Tables) -> DataFrame:
    x = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " the wifi manifest ").when(F.col("doc_id") % 3 == 1, " in /var/data/run ").otherwise(""))
    rules = [
        ("empty_output", F.trim(x) == ""), ("path_leakage", x.rlike(r"(?i)\b[a-z]:[\\/][^\s]+|(?<![:/.\w-])(?:/[^/\s]+){2,}")), ("filename_leakage", x.rlike(T.FILE_NAME)), ("url_leakage", x.rlike(r"(?i)\b(?:https?://|www\.)\S+\b")),
        ("tooling_leakage", x.rlike(r"(?i)\b(?:manifest|pipeline|watchdog)\b")), ("anachronism", x.rlike(r"(?i)\b(?:email|google|internet|laptop|podcast|smartphone|streaming|usb|wi-fi|wifi)\b")),
    ]
    return noisy(t).select("doc_id", F.array_join(G.errors(rules), ",").alias("errors"))


@query("SELECT source, count(*) AS n, min(doc_id % 9) AS page_from, max(doc_id % 9) AS page_to, max(doc_id % 2) AS section_count, bool_or(doc_id % 13 = 0) AS exempt, max(doc_id % 9) > min(doc_id % 9) AND max(doc_id % 2) <= 1 AND NOT bool_or(doc_id % 13 = 0) AS collapsed FROM documents GROUP BY source")
def doc_aggregate_gates(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min(k % 9).alias("page_from"), F.max(k % 9).alias("page_to"), F.max(k % 2).alias("section_count"), F.bool_or(k % 13 == 0).alias("exempt"))
    return g.withColumn("collapsed", (F.col("page_to") > F.col("page_from")) & (F.col("section_count") <= 1) & ~F.col("exempt"))


@query("WITH a AS (SELECT doc_id, text AS x, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS email, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS y FROM documents), b AS (SELECT *, len(regexp_extract_all(y, '(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}')) AS secret, regexp_replace(y, '(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}', '[SECRET]', 'g') AS z FROM a) SELECT doc_id, email::BIGINT AS email, secret::BIGINT AS secret, len(regexp_extract_all(z, '\\+?[0-9][0-9() -]{8,}[0-9]'))::BIGINT AS phone, sha256(regexp_replace(z, '\\+?[0-9][0-9() -]{8,}[0-9]', '[PHONE]', 'g')) AS text_hash FROM b")
def redaction_counts(t: Tables) -> DataFrame:
    text, counts = G.redact(F.col("text"))
    return t.documents.select("doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(text, 256).alias("text_hash"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(text) < 40) AS short, count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) AS role FROM conversations)
SELECT name, bad, CASE WHEN bad = 0 THEN 'INFO' WHEN bad * 10 > n THEN 'ERROR' ELSE 'WARN' END AS level FROM (SELECT n, unnest(['empty_text', 'short_text', 'schema']) AS name, unnest([empty, short, role]) AS bad FROM c)""")
def watchdog_checks(t: Tables) -> DataFrame:
    one = t.conversations.agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("a"), F.count_if(F.char_length("text") < 40).alias("b"), F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("c"))
    rows = one.select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("bad")) for k, v in (("empty_text", "a"), ("short_text", "b"), ("schema", "c"))])))
    return rows.select("name", "bad", F.when(F.col("bad") == 0, "INFO").when(F.col("bad") * 10 > F.col("n"), "ERROR").otherwise("WARN").alias("level"))


@query("SELECT substr(sha1(lower(string_split(text, ' ')[1])), 1, 16) AS prompt_hash, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL HAVING count(*) >= 3")
def prompt_buckets(t: Tables) -> DataFrame:
    """Prompts that come back, by their opening: here the first word."""
    return t.conversations.filter("role = 'user'").groupBy(F.substring(F.sha1(F.lower(F.split("text", " ")[0])), 1, 16).alias("prompt_hash")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT doc_id, length(text) >= 20 AND lang IN ('en', 'de', 'fr') AND regexp_matches('sha256:' || sha256(text), '^sha256:[a-f0-9]{64}$') AS valid FROM documents")
def training_record_rules(t: Tables) -> DataFrame:
    ok = (F.char_length("text") >= 20) & F.col("lang").isin("en", "de", "fr") & F.concat(F.lit("sha256:"), F.sha2("text", 256)).rlike("^sha256:[a-f0-9]{64}$")
    return t.documents.select("doc_id", ok.alias("valid"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 > 3 THEN 'score_range' END, CASE WHEN p_size % 3 = 0 THEN 'notes' END, CASE WHEN p_brand = '' THEN 'brand' END], lambda e: e IS NOT NULL), ',') AS errors FROM part")
def candidate_validation(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", F.array_join(G.errors([("score_range", s % 5 > 3), ("notes", s % 3 == 0), ("brand", F.col("p_brand") == "")]), ",").alias("errors"))
