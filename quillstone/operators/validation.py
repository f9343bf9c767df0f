"""Contracts of manifests, records, datasets and game state, as rule sets over columns.

A rule is (code, failing condition); :func:`quillstone.operators.governance.errors` turns a set into an array of the
codes that fail. A condition that is null does not fail, so every rule says itself what a missing value means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .governance import (
    ATTRIBUTION_NEEDED,
    CONSENT_TYPES,
    ARTIFACT_TYPES,
    LICENSE_URL_NEEDED,
    PROPRIETARY_FAMILIES,
    RETRIEVAL_LICENSES,
    RETRIEVAL_RIGHTS,
    REVIEW,
    SHARE_ALIKE,
    TRAINING_LICENSES,
    TRAINING_RIGHTS,
    WEB_TYPES,
    Rules,
    blank,
    derived_class,
    unknown,
)

# Fields that records have to have, by stage; names of discovery methods, metrics and policy values.
RECORD_FIELDS = (
    "record_id", "stage", "source_id", "source_type", "source", "license", "license_url", "rights_basis", "allowed_for_training", "allowed_for_rag", "eligibility_class",
    "attribution_required", "attribution_text", "share_alike_required", "removal_required", "collection_date", "owner", "content_hash", "version", "pipeline_version",
    "provenance_status", "run_id", "job_id",
)
CANDIDATE_FIELDS = (
    "record_id", "stage", "candidate_source_id", "candidate_domain", "seed_url", "discovered_at", "discovery_methods", "relevance_score", "risk_score", "review_status",
    "run_id", "job_id", "content_hash", "pipeline_version",
)
STAGE_FIELDS = {
    "discovery_candidate": ("candidate_source_id", "candidate_domain", "seed_url", "discovered_at", "discovery_methods", "relevance_score", "risk_score", "review_status"),
    "raw": ("acquisition",),
    "extracted": ("text", "extractor_name", "extractor_version", "page_from", "page_to", "page_errors", "fallback_flags"),
    "cleaned": ("text", "cleaning_metrics", "quality_posterior", "quality_flags", "rejection_flags"),
    "sectionized": ("text", "document_id", "section_id", "section_index", "section_count", "heading"),
    "chunked": ("text", "document_id", "section_id", "chunk_id", "chunk_index", "heading", "char_count", "chunk_size_ceiling"),
    "indexed": ("text", "document_id", "chunk_id", "dataset_id", "index_name", "embedding_model", "vector_store"),
}
CANDIDATE_SOURCE_FIELDS = ("candidate_source_id", "candidate_domain", "seed_url", "first_seen_at", "last_seen_at", "discovery_methods", "relevance_score", "risk_score", "review_status")
METHODS = ("approved_outbound_link", "sitemap", "feed", "query_seed", "search_snapshot", "manual")
METRICS = ("no_op_transform", "removed_urls", "removed_html_tags", "removed_boilerplate", "token_delta", "repeated_pass_delta")
#: Policy category -> (training, retrieval, rights bases, review statuses).
POLICIES = {
    "train_and_rag": (True, True, ("owned_original", "owned_or_public_domain", "licensed_for_training"), ("approved",)),
    "rag_only": (False, True, ("licensed_for_rag_only",), ("approved_rag_only",)),
    "reference_only": (False, False, ("internal_reference_only",), ("reference_only",)),
    "blocked": (False, False, ("unknown", "prohibited"), ("quarantined", "removed")),
}
WRAPPER = r"\A\s*[\[{]\s*(?:\{|\")"

c = F.col


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def missing(needed: tuple[str, ...], present: Column) -> Column:
    """The needed field names that are not among those present, sorted."""
    return F.array_except(F.array(*[F.lit(f) for f in sorted(needed)]), present)


def _within(x: Column, low: float, high: float) -> Column:
    """Fails: no number, or one outside."""
    return F.coalesce((x < low) | (x > high), F.lit(True))


def remote_rules(remote: Column) -> Rules:
    """What a source that is fetched from elsewhere has to declare; ``remote`` says which sources are."""
    host = lambda name: c("host_policy")[name]
    agent = F.coalesce(host("user_agent"), F.lit(""))
    none = lambda x: F.coalesce(x, F.lit(0)) == 0
    bad = {
        "allowed_domains": F.coalesce(F.size("allowed_domains"), F.lit(0)) == 0, "robots": ~true(host("fail_closed_on_robots")), "respect_delay": ~true(host("respect_crawl_delay")), "delay": host("crawl_delay_seconds").isNull(),
        "rate": none(host("requests_per_minute")), "parallel": none(host("max_parallel_requests")), "budget": none(host("daily_url_budget")), "user_agent": blank(agent) | F.contains(agent, F.lit("example.org")),
        "removal_path": F.coalesce(c("removal_path"), F.lit("")) == "",
    }
    return [(f"remote_{k}", remote & v) for k, v in bad.items()]


def manifest_rules() -> tuple[Rules, Rules]:
    """(errors, warnings) of a source manifest: rights, attribution, artefacts, quarantine, consent, remote access."""
    made = derived_class(true(c("allowed_for_training")), true(c("allowed_for_rag")))
    declared, lic, rights = F.coalesce(c("eligibility_class"), F.lit("")), F.coalesce(c("license"), F.lit("")), F.coalesce(c("rights_basis"), F.lit(""))
    no_rights, status, kind = unknown(lic) | unknown(rights), F.coalesce(c("status"), F.lit("")), F.coalesce(c("source_type"), F.lit(""))
    attributed, removal, training = true(c("attribution_required")), true(c("removal_required")), true(c("allowed_for_training"))
    path, urls = ~blank(c("artifact_path")), F.coalesce(F.size("artifact_urls"), F.lit(0)) > 0
    artifact, web, user = kind.isin(*ARTIFACT_TYPES), kind.isin(*WEB_TYPES), kind.isin(*CONSENT_TYPES)
    consent = lambda name: c("consent")[name]
    errors = [
        ("class", declared != made),
        ("review_status", ~F.coalesce(c("review_status"), F.lit("")).isin(*REVIEW)),
        ("unknown_rights_class", no_rights & (declared != "neither")),
        ("unknown_rights_status", no_rights & (status != "quarantined")),
        ("attribution_unset", c("attribution_required").isNull()),
        ("share_alike_unset", c("share_alike_required").isNull()),
        ("license_url", lic.isin(*LICENSE_URL_NEEDED) & blank(c("license_url"))),
        ("attribution_flag", lic.isin(*ATTRIBUTION_NEEDED) & ~attributed),
        ("attribution_text", attributed & blank(c("attribution_text"))),
        ("share_alike", lic.isin(*SHARE_ALIKE) & ~true(c("share_alike_required"))),
        ("no_artifact", artifact & ~path & ~urls),
        ("two_artifacts", artifact & path & urls),
        ("quarantine_reason", (status == "quarantined") & (F.coalesce(c("quarantine_reason"), F.lit("")) == "")),
        ("removal_class", removal & (declared != "neither")),
        ("removal_status", removal & (status != "quarantined")),
        ("not_training_safe", (declared == "training_and_retrieval") & ~(lic.isin(*TRAINING_LICENSES) & rights.isin(*TRAINING_RIGHTS))),
        ("provenance", (declared == "training_and_retrieval") & (F.coalesce(c("provenance_status"), F.lit("")) != "complete")),
        ("proprietary", F.coalesce(c("source_family"), F.lit("")).isin(*PROPRIETARY_FAMILIES) & training),
        ("no_opt_in", user & training & ~true(consent("explicit_opt_in"))),
        ("consent_by", user & training & ((F.coalesce(consent("granted_by"), F.lit("")) == "") | (F.coalesce(consent("granted_at"), F.lit("")) == ""))),
        ("seed_urls", web & (F.coalesce(F.size("seed_urls"), F.lit(0)) == 0)),
        *remote_rules(web | artifact & urls),
    ]
    only = declared == "retrieval_only"
    warnings = [
        ("odd_license", only & ~lic.isin(*RETRIEVAL_LICENSES, "all-rights-reserved", "contract-restricted")),
        ("odd_rights", only & ~rights.isin(*RETRIEVAL_RIGHTS, "contract-restricted")),
    ]
    return errors, warnings


def candidate_rules() -> Rules:
    """Of a candidate source under review; fields is the array of names that it has."""
    methods = F.coalesce(c("discovery_methods"), F.array().cast("array<string>"))
    return [
        ("missing_fields", F.size(missing(CANDIDATE_SOURCE_FIELDS, c("fields"))) > 0),
        ("review_status", ~F.coalesce(c("review_status"), F.lit("")).isin(*REVIEW)),
        ("methods", (F.size(methods) == 0) | (F.size(F.array_except(methods, F.array(*map(F.lit, METHODS)))) > 0)),
        ("relevance_score", _within(c("relevance_score"), 0, 1)),
        ("risk_score", _within(c("risk_score"), 0, 1)),
        ("review_notes", (c("review_status") == "approved") & (F.coalesce(c("review_notes"), F.lit("")) == "")),
    ]


def policy_rules() -> Rules:
    """A source's policy category against its flags, rights and review; only blocked sources may be of unknown owner or licence."""
    category, open_ = c("policy_category"), c("policy_category") != "blocked"
    rules: Rules = [
        ("category", ~F.coalesce(category, F.lit("")).isin(*POLICIES)),
        ("owner", open_ & (c("owner") == "unknown")),
        ("license", open_ & (c("license") == "unknown")),
        ("content_hash", ~F.coalesce(c("content_hash"), F.lit("")).rlike(r"\Asha256:[a-f0-9]{64}\z")),
        *[(f"blank_{name}", blank(c(name))) for name in ("title", "origin", "reviewed_by", "removal_contact", "notes")],
        ("source_id", F.char_length(F.trim(F.coalesce(c("source_id"), F.lit("")))) < 3),
    ]
    for name, (training, rag, rights, reviews) in POLICIES.items():
        mine = category == name
        rules += [
            (f"{name}_flags", mine & ((true(c("allowed_for_training")) != training) | (true(c("allowed_for_rag")) != rag))),
            (f"{name}_rights", mine & ~F.coalesce(c("rights_basis"), F.lit("")).isin(*rights)),
            (f"{name}_review", mine & ~F.coalesce(c("review_status"), F.lit("")).isin(*reviews)),
        ]
    return rules


def record_rules(stage: str, max_chars: int = 1800, training_export: bool = False) -> Rules:
    """Of a corpus record at a stage: its shape, leaks in its text, and the stage's own rules.

    fields is the array of names that the record has. A record of another stage fails that rule and no other.
    """
    candidate, text = stage == "discovery_candidate", F.coalesce(c("text"), F.lit(""))
    rules: Rules = [
        ("base_fields", F.size(missing(CANDIDATE_FIELDS if candidate else RECORD_FIELDS, c("fields"))) > 0),
        ("stage_fields", F.size(missing(STAGE_FIELDS.get(stage, ()), c("fields"))) > 0 if STAGE_FIELDS.get(stage) else F.lit(False)),
    ]
    if candidate:
        rules += [("relevance_score", _within(c("relevance_score"), 0, 1)), ("risk_score", _within(c("risk_score"), 0, 1)), ("review_status", ~F.coalesce(c("review_status"), F.lit("")).isin(*REVIEW))]
    else:
        made = derived_class(true(c("allowed_for_training")), true(c("allowed_for_rag")))
        rules += [
            ("class", F.coalesce(c("eligibility_class"), F.lit("")) != made),
            ("unknown_rights", unknown(c("license")) | unknown(c("rights_basis"))),
            ("attribution_text", true(c("attribution_required")) & blank(c("attribution_text"))),
        ]
    if stage in ("cleaned", "sectionized", "chunked", "indexed"):
        low = F.lower(text)
        boiler = F.lit(False)
        for phrase in ("not for resale", "permission granted to print", "copyright", "credits"):
            boiler = boiler | F.contains(low, F.lit(phrase))
        rules += [
            ("url", text.rlike(r"(?i)https?://\S+|www\.\S+")), ("html", text.rlike(r"<[a-zA-Z/][^>]*>")),
            ("json_wrapper", text.rlike(WRAPPER) & F.contains(F.substring(text, 1, 200), F.lit('"text"'))), ("boilerplate", boiler),
        ]
    if training_export and not candidate:
        rules += [
            ("export_class", F.coalesce(c("eligibility_class"), F.lit("")) != "training_and_retrieval"), ("export_provenance", F.coalesce(c("provenance_status"), F.lit("")) != "complete"),
            ("export_removal", true(c("removal_required"))),
        ]
    if stage == "cleaned":
        rules += [(f"metric_{m}", ~F.array_contains("metrics", m)) for m in METRICS]
    if stage in ("sectionized", "chunked"):
        rules.append(("heading", (F.coalesce(c("heading"), F.lit("")) == "") & ~true(c("allow_empty_heading"))))
    if stage == "sectionized":
        start = F.coalesce(F.nullif(c("page_from"), F.lit(0)), F.lit(1))
        rules.append(("collapsed", (F.coalesce(F.nullif(c("page_to"), F.lit(0)), start) > start) & (F.coalesce(c("section_count"), F.lit(0)) <= 1) & ~true(c("section_exempt"))))
    if stage == "chunked":
        size = F.char_length(text)
        ceiling = F.coalesce(F.nullif(c("chunk_size_ceiling"), F.lit(0)), F.lit(max_chars))
        rules += [("char_count", F.coalesce(c("char_count"), F.lit(0)) != size), ("oversized", size > F.least(ceiling, F.lit(max_chars)))]
    if stage == "extracted":
        rules.append(("page_errors", (F.coalesce(F.size("page_errors"), F.lit(0)) > 0) & (F.coalesce(F.size("fallback_flags"), F.lit(0)) == 0)))
    here = c("stage").eqNullSafe(F.lit(stage))
    return [("stage", ~here), *[(code, here & bad) for code, bad in rules]]


def combatant_rules() -> Rules:
    return [
        ("armor_class", _within(c("armor_class"), 1, 1e9)), ("max_hp", _within(c("max_hp"), 1, 1e9)), ("current_hp", _within(c("current_hp"), 0, 1e9)), ("attack_range", _within(c("attack_range"), 1, 1e9)),
        ("hp_over_max", c("current_hp") > c("max_hp")), ("movement_over_speed", c("movement_remaining") > c("speed")),
    ]


def combat_rules() -> Rules:
    """Of a combat: initiative and combatants are arrays of ids."""
    order, held = F.coalesce(c("initiative"), F.array().cast("array<string>")), F.coalesce(c("combatants"), F.array().cast("array<string>"))
    return [
        ("no_initiative", F.size(order) == 0), ("current_index", _within(c("current_index"), 0, 1e9) | (c("current_index") >= F.size(order))), ("round_number", _within(c("round_number"), 1, 1e9)),
        ("initiative_ids", (F.size(F.array_except(order, held)) > 0) | (F.size(F.array_except(held, order)) > 0)),
    ]


def session_rules() -> Rules:
    """Of a session: its campaign, party, scene, members and players have to fit together; characters is a map of id to controller."""
    inside = lambda some, all_: F.size(F.array_except(some, all_)) == 0
    return [
        ("campaign_id", ~c("campaign_id").eqNullSafe(c("campaign.campaign_id"))), ("party_id", ~c("campaign.party_id").eqNullSafe(c("party.party_id"))),
        ("current_scene", ~F.coalesce(F.array_contains("scenes", c("current_scene_id")), F.lit(False))), ("party_members", ~inside(c("party.member_ids"), F.map_keys("characters"))),
        ("players", ~inside(c("player_ids"), F.map_values("characters"))), ("action_counter", _within(c("action_counter"), 0, 1e18)),
    ]


def dataset_rules() -> Rules:
    """Of a dataset manifest: the contract of its fields, and which policy categories go with its flags."""
    cats, ids = c("policy_categories"), c("source_ids")
    pattern = lambda name, p: (f"pattern_{name}", ~F.coalesce(c(name), F.lit("")).rlike(p))
    one_of = lambda name, *xs: (f"enum_{name}", ~F.coalesce(c(name), F.lit("")).isin(*xs))
    return [
        pattern("dataset_id", r"\A[a-z0-9][a-z0-9._-]{2,}\z"), pattern("version", r"\Av[0-9]+(?:\.[0-9]+)*\z"), pattern("content_hash", r"\Asha256:[a-f0-9]{64}\z"),
        one_of("task_family", "narration", "teaching", "reasoning", "routing"), one_of("role", "narrator", "arbiter", "router"), ("enum_split", ~c("split").isin("train", "validation", "test", "mixed")),
        ("source_ids", (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists(ids, lambda x: F.char_length(x) < 3)),
        ("policy_categories", (F.size(cats) == 0) | (F.size(F.array_distinct(cats)) < F.size(cats)) | (F.size(F.array_except(cats, F.array(*map(F.lit, POLICIES)))) > 0)),
        ("record_count", _within(c("record_count"), 0, 1e18)), ("created_at", F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd")).isNull()),
        ("training_category", true(c("allowed_for_training")) & ~F.array_contains(cats, "train_and_rag")), ("blocked_training", F.array_contains(cats, "blocked") & true(c("allowed_for_training"))),
    ]


def keyed_json(content: Column, keys: Column) -> Column:
    """Whether a model's answer is a JSON object that has all the keys its contract names."""
    found = F.json_object_keys(content)
    return F.coalesce(F.size(F.array_except(keys, found)) == 0, F.lit(False))
