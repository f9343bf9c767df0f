"""Rules as data: a rule is (code, failing condition); a rule set is one array column; frames split on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Who runs this: the name in the rights basis of texts of one's own. A deployment sets its own.
OWNER = "operator"
# Licence, rights, source and review vocabularies.
LICENSE_URL_NEEDED = ("license-grants-training", "license-grants-retrieval", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "ogl-1.0a", "public-domain")
ATTRIBUTION_NEEDED = ("license-grants-training", "license-grants-retrieval", "cc-by-4.0", "cc-by-sa-4.0", "ogl-1.0a")
SHARE_ALIKE = ("cc-by-sa-4.0",)
TRAINING_LICENSES = ("owned", "license-grants-training", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "public-domain", "user-consent")
TRAINING_RIGHTS = (f"owned-by-{OWNER}", "explicit-training-license", "open-license", "public-domain", "user-opt-in")
RETRIEVAL_LICENSES = (*TRAINING_LICENSES, "license-grants-retrieval", "ogl-1.0a")
RETRIEVAL_RIGHTS = (*TRAINING_RIGHTS, "explicit-retrieval-license", "internal-use-only")
WEB_TYPES = ("website", "api", "html")
ARTIFACT_TYPES = ("pdf", "text", "jsonl", "internal_doc", "licensed_dataset")
CONSENT_TYPES = ("user_upload", "campaign_log")
PROPRIETARY_FAMILIES = ("dnd_official", "dnd_fan")
REVIEW = ("approved", "pending_review", "rejected", "quarantined")

Rules = list[tuple[str, Column]]


def errors(rules: Rules) -> Column:
    """Codes of the rules that fail, in the order of the rules. A condition that is null does not fail."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with the reasons): no row is lost between them."""
    checked = df.withColumn("errors", errors(rules))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def derived_class(training: Column, rag: Column) -> Column:
    return F.when(training & rag, "training_and_retrieval").when(~training & rag, "retrieval_only").when(~training & ~rag, "neither").otherwise("invalid")


def blank(x: Column) -> Column:
    """Null, empty or white space of any kind."""
    return F.coalesce(x, F.lit("")).rlike(r"^\s*$")


def unknown(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).isin("", "unknown")


def manifest_rules() -> Rules:
    """Licence, rights, attribution and review rules of a source manifest."""
    c = F.col
    return [
        ("class", c("eligibility_class") != derived_class(c("allowed_for_training"), c("allowed_for_rag"))),
        ("review_status", ~F.coalesce(c("review_status"), F.lit("")).isin(*REVIEW)),
        ("unknown_rights_class", (unknown(c("license")) | unknown(c("rights_basis"))) & (c("eligibility_class") != "neither")),
        ("unknown_rights_status", (unknown(c("license")) | unknown(c("rights_basis"))) & (c("status") != "quarantined")),
        ("license_url", c("license").isin(*LICENSE_URL_NEEDED) & blank(c("license_url"))),
        ("attribution_flag", c("license").isin(*ATTRIBUTION_NEEDED) & ~c("attribution_required")),
        ("attribution_text", c("attribution_required") & blank(c("attribution_text"))),
        ("share_alike", c("license").isin(*SHARE_ALIKE) & ~c("share_alike_required")),
    ]


def collectable() -> Column:
    c = F.col
    return (c("review_status") == "approved") & (c("status") == "active") & ~c("removal_required") & ~unknown(c("license")) & ~unknown(c("rights_basis"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """Text with typed markers for mail addresses, phone numbers and keys, and how many of each there were."""
    classes = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "secret": r"(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}",
        "phone": r"\+?[0-9][0-9() -]{8,}[0-9]",
    }
    counts, out = {}, text
    for name, pattern in classes.items():
        counts[name] = F.regexp_count(out, F.lit(pattern)).cast("long")
        out = F.regexp_replace(out, pattern, f"[{name.upper()}]")
    return out, counts
