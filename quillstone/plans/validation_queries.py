"""Queries over the contracts of manifests, records, datasets and game state.

The rows are made from customer keys by expressions that both engines read alike; the rules stand twice, as columns in
``operators.validation`` and as SQL literals here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..operators import governance as G
from ..operators import rulebook
from ..operators import validation as V


def _pick(step: int, *values: str | None) -> str:
    """One of the literals, by key: the same SQL for both engines."""
    n = len(values)
    return f"CASE CAST(floor(k / {step}) AS INT) % {n} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v if v in ('true', 'false') or v.replace('.', '').lstrip('-').isdigit() else repr(v)}" for i, v in enumerate(values)) + " END"


def _rows(t: Tables, made: dict[str, str]) -> DataFrame:
    return t.customer.selectExpr("c_custkey AS k").selectExpr("k", *[f"{v} AS {n}" for n, v in made.items()])


def _cte(made: dict[str, str]) -> str:
    return "m AS (SELECT k, " + ", ".join(f"{v} AS {n}" for n, v in made.items()) + " FROM (SELECT c_custkey AS k FROM customer))"


def _sql(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules) + "], lambda e: e IS NOT NULL), ',')"


def _codes(rules: G.Rules, name: str = "errors"):
    return F.array_join(G.errors(rules), ",").alias(name)


_BOOL = ("true", "false", None)
_MANIFEST = {
    "license": _pick(1, "cc-by-4.0", "owned", "unknown", "ogl-1.0a", "cc-by-sa-4.0", "license-grants-retrieval", "odd-license", None, "public-domain"),
    "rights_basis": _pick(3, "open-license", "owned-by-operator", "internal-use-only", "", "odd-rights"),
    "allowed_for_training": _pick(1, *_BOOL), "allowed_for_rag": _pick(2, "true", "true", "false"), "eligibility_class": _pick(5, "training_and_retrieval", "retrieval_only", "neither", "invalid", None),
    "review_status": _pick(2, "approved", "pending_review", "late"), "status": _pick(7, "active", "quarantined", "quarantined"), "attribution_required": _pick(4, *_BOOL), "attribution_text": _pick(5, "by us", " ", None),
    "share_alike_required": _pick(6, *_BOOL), "license_url": _pick(3, "http://l", None), "source_type": _pick(1, "website", "pdf", "user_upload", "text", "book"), "artifact_path": _pick(4, "a.pdf", " ", None),
    "artifact_urls": f"CASE WHEN k % 7 < 3 THEN split({_pick(1, 'http://a,http://b', 'http://c')}, ',') END", "quarantine_reason": _pick(2, "rights", None), "removal_required": _pick(11, "false", "true"),
    "provenance_status": _pick(3, "complete", "partial"), "source_family": _pick(13, "own", "dnd_fan", "dnd_official"), "opt_in": _pick(2, *_BOOL), "granted_by": _pick(3, "me", None), "granted_at": _pick(5, "now", ""),
    "seed_urls": "CASE WHEN k % 3 > 0 THEN split('http://s', ',') END", "allowed_domains": "CASE WHEN k % 4 > 0 THEN split('s.test', ',') END", "fail_closed": _pick(5, *_BOOL), "respect_delay": _pick(7, *_BOOL),
    "delay": _pick(2, "0", "1", None), "rate": _pick(3, "10", "0", None), "parallel": _pick(5, "2", "0"), "budget": _pick(7, "50", None), "agent": _pick(3, "bot by me", "bot at example.org", " ", None), "removal_path": _pick(2, "/gone", "", None),
}
_KNOWN_NOT = "(coalesce(license, '') IN ('', 'unknown') OR coalesce(rights_basis, '') IN ('', 'unknown'))"
_DERIVED = "CASE WHEN coalesce(allowed_for_training, false) THEN CASE WHEN coalesce(allowed_for_rag, false) THEN 'training_and_retrieval' ELSE 'invalid' END WHEN coalesce(allowed_for_rag, false) THEN 'retrieval_only' ELSE 'neither' END"
_ARTIFACT, _WEB = "source_type IN ('pdf', 'text', 'jsonl', 'internal_doc', 'licensed_dataset')", "source_type IN ('website', 'api', 'html')"
_REMOTE = f"({_WEB} OR {_ARTIFACT} AND artifact_urls IS NOT NULL)"
_USER = "source_type IN ('user_upload', 'campaign_log') AND coalesce(allowed_for_training, false)"
_SAFE = "'owned', 'license-grants-training', 'cc0-1.0', 'cc-by-4.0', 'cc-by-sa-4.0', 'public-domain', 'user-consent'"
_SAFE_RIGHTS = "'owned-by-operator', 'explicit-training-license', 'open-license', 'public-domain', 'user-opt-in'"
_MANIFEST_SQL = _sql(
    ("class", f"coalesce(eligibility_class, '') <> {_DERIVED}"), ("review_status", "review_status NOT IN ('approved', 'pending_review', 'rejected', 'quarantined')"),
    ("unknown_rights_class", f"{_KNOWN_NOT} AND coalesce(eligibility_class, '') <> 'neither'"), ("unknown_rights_status", f"{_KNOWN_NOT} AND status <> 'quarantined'"),
    ("attribution_unset", "attribution_required IS NULL"), ("share_alike_unset", "share_alike_required IS NULL"),
    ("license_url", "license IN ('license-grants-training', 'license-grants-retrieval', 'cc0-1.0', 'cc-by-4.0', 'cc-by-sa-4.0', 'ogl-1.0a', 'public-domain') AND license_url IS NULL"),
    ("attribution_flag", "license IN ('license-grants-training', 'license-grants-retrieval', 'cc-by-4.0', 'cc-by-sa-4.0', 'ogl-1.0a') AND attribution_required IS NOT TRUE"),
    ("attribution_text", "attribution_required AND coalesce(trim(attribution_text), '') = ''"), ("share_alike", "license = 'cc-by-sa-4.0' AND share_alike_required IS NOT TRUE"),
    ("no_artifact", f"{_ARTIFACT} AND coalesce(trim(artifact_path), '') = '' AND artifact_urls IS NULL"), ("two_artifacts", f"{_ARTIFACT} AND trim(artifact_path) <> '' AND artifact_urls IS NOT NULL"),
    ("quarantine_reason", "status = 'quarantined' AND quarantine_reason IS NULL"), ("removal_class", "removal_required AND coalesce(eligibility_class, '') <> 'neither'"), ("removal_status", "removal_required AND status <> 'quarantined'"),
    ("not_training_safe", f"eligibility_class = 'training_and_retrieval' AND (coalesce(license, '') NOT IN ({_SAFE}) OR rights_basis NOT IN ({_SAFE_RIGHTS}))"),
    ("provenance", "eligibility_class = 'training_and_retrieval' AND provenance_status <> 'complete'"), ("proprietary", "source_family IN ('dnd_official', 'dnd_fan') AND allowed_for_training"),
    ("no_opt_in", f"{_USER} AND opt_in IS NOT TRUE"), ("consent_by", f"{_USER} AND (granted_by IS NULL OR granted_at = '')"), ("seed_urls", f"{_WEB} AND seed_urls IS NULL"),
    ("remote_allowed_domains", f"{_REMOTE} AND allowed_domains IS NULL"), ("remote_robots", f"{_REMOTE} AND fail_closed IS NOT TRUE"), ("remote_respect_delay", f"{_REMOTE} AND respect_delay IS NOT TRUE"), ("remote_delay", f"{_REMOTE} AND delay IS NULL"),
    ("remote_rate", f"{_REMOTE} AND coalesce(rate, 0) = 0"), ("remote_parallel", f"{_REMOTE} AND coalesce(parallel, 0) = 0"), ("remote_budget", f"{_REMOTE} AND budget IS NULL"),
    ("remote_user_agent", f"{_REMOTE} AND (trim(coalesce(agent, '')) = '' OR contains(agent, 'example.org'))"), ("remote_removal_path", f"{_REMOTE} AND coalesce(removal_path, '') = ''"),
)
_MANIFEST_WARNINGS = _sql(
    ("odd_license", f"eligibility_class = 'retrieval_only' AND coalesce(license, '') NOT IN ({_SAFE}, 'license-grants-retrieval', 'ogl-1.0a', 'all-rights-reserved', 'contract-restricted')"),
    ("odd_rights", f"eligibility_class = 'retrieval_only' AND rights_basis NOT IN ({_SAFE_RIGHTS}, 'explicit-retrieval-license', 'internal-use-only', 'contract-restricted')"),
)


@query(f"WITH {_cte(_MANIFEST)} SELECT k, {_MANIFEST_SQL} AS errors, {_MANIFEST_WARNINGS} AS warnings FROM m")
def manifest_contract(t: Tables) -> DataFrame:
    rows = _rows(t, _MANIFEST).withColumns({
        "consent": F.struct(F.col("opt_in").alias("explicit_opt_in"), "granted_by", "granted_at"),
        "host_policy": F.struct(
            F.col("fail_closed").alias("fail_closed_on_robots"), F.col("respect_delay").alias("respect_crawl_delay"), F.col("delay").alias("crawl_delay_seconds"), F.col("rate").alias("requests_per_minute"),
            F.col("parallel").alias("max_parallel_requests"), F.col("budget").alias("daily_url_budget"), F.col("agent").alias("user_agent"),
        ),
    })
    errors, warnings = V.manifest_rules()
    return rows.select("k", _codes(errors), _codes(warnings, "warnings"))


_CANDIDATE = {
    "review_status": _pick(1, "approved", "pending_review", "odd", None), "discovery_methods": f"split({_pick(2, 'manual', 'sitemap,feed', 'manual,guess', None)}, ',')", "relevance_score": _pick(3, "0.5", "1.5", "-0.1", None),
    "risk_score": _pick(5, "1.0", "0.0", "2.0"), "review_notes": _pick(4, "seen", "", None), "gone": _pick(1, "seed_url", "risk_score", "none", "first_seen_at", "other"),
}
_CANDIDATE_SQL = _sql(
    ("missing_fields", "gone IN ('seed_url', 'risk_score', 'first_seen_at')"), ("review_status", "coalesce(review_status, '') NOT IN ('approved', 'pending_review', 'rejected', 'quarantined')"),
    ("methods", "discovery_methods IS NULL OR list_contains(discovery_methods, 'guess')"), ("relevance_score", "relevance_score IS NULL OR relevance_score < 0 OR relevance_score > 1"),
    ("risk_score", "risk_score > 1"), ("review_notes", "review_status = 'approved' AND coalesce(review_notes, '') = ''"),
)


@query(f"WITH {_cte(_CANDIDATE)} SELECT k, {_CANDIDATE_SQL} AS errors FROM m")
def candidate_contract(t: Tables) -> DataFrame:
    fields = F.array_except(F.array(*map(F.lit, V.CANDIDATE_SOURCE_FIELDS)), F.array("gone"))
    return _rows(t, _CANDIDATE).withColumn("fields", fields).select("k", _codes(V.candidate_rules()))


_HASH = "sha256:" + "0a" * 32
_POLICY = {
    "policy_category": _pick(1, "train_and_rag", "rag_only", "reference_only", "blocked", "other"), "allowed_for_training": _pick(2, "true", "false", "false"), "allowed_for_rag": _pick(3, "true", "true", "false"),
    "rights_basis": _pick(1, "owned_original", "licensed_for_rag_only", "internal_reference_only", "prohibited", "licensed_for_training", "unknown"), "review_status": _pick(1, "approved", "approved_rag_only", "reference_only", "quarantined", "removed", "approved"),
    "owner": _pick(4, "public", "unknown"), "license": _pick(5, "cc0", "unknown", "own"), "content_hash": _pick(7, _HASH, "sha256:0A", None), "title": _pick(6, "t", " "), "origin": _pick(9, "o", None), "reviewed_by": _pick(1, "r"),
    "removal_contact": _pick(8, "c", ""), "notes": _pick(1, "n"), "source_id": _pick(3, "abc", " ab ", None),
}
_FLAGS = {"train_and_rag": "NOT (allowed_for_training AND allowed_for_rag)", "rag_only": "NOT (NOT allowed_for_training AND allowed_for_rag)", "reference_only": "allowed_for_training OR allowed_for_rag", "blocked": "allowed_for_training OR allowed_for_rag"}
_RIGHTS = {"train_and_rag": "'owned_original', 'owned_or_public_domain', 'licensed_for_training'", "rag_only": "'licensed_for_rag_only'", "reference_only": "'internal_reference_only'", "blocked": "'unknown', 'prohibited'"}
_REVIEWS = {"train_and_rag": "'approved'", "rag_only": "'approved_rag_only'", "reference_only": "'reference_only'", "blocked": "'quarantined', 'removed'"}
_POLICY_SQL = _sql(
    ("category", "policy_category = 'other'"), ("owner", "policy_category <> 'blocked' AND owner = 'unknown'"), ("license", "policy_category <> 'blocked' AND license = 'unknown'"),
    ("content_hash", "NOT coalesce(regexp_full_match(content_hash, 'sha256:[a-f0-9]{64}'), false)"), *[(f"blank_{n}", f"coalesce(trim({n}), '') = ''") for n in ("title", "origin", "reviewed_by", "removal_contact", "notes")], ("source_id", "length(trim(coalesce(source_id, ''))) < 3"),
    *[(f"{p}_{kind}", f"policy_category = '{p}' AND ({bad})") for p in _FLAGS for kind, bad in (("flags", _FLAGS[p]), ("rights", f"rights_basis NOT IN ({_RIGHTS[p]})"), ("review", f"review_status NOT IN ({_REVIEWS[p]})"))],
)


@query(f"WITH {_cte(_POLICY)} SELECT k, {_POLICY_SQL} AS errors FROM m")
def policy_matrix(t: Tables) -> DataFrame:
    return _rows(t, _POLICY).select("k", _codes(V.policy_rules()))


_STAGES = ("cleaned", "sectionized", "chunked", "extracted", "raw", "discovery_candidate")
_RECORD = {
    "stage": _pick(1, *_STAGES, None), "text": _pick(7, "plain prose", "see www.x.test now", "a <b>tag</b>", '[{"text": "wrapped"}]', "All Copyright kept", ""), "heading": _pick(11, "H", "", None), "allow_empty_heading": _pick(3, *_BOOL),
    "allowed_for_training": _pick(2, *_BOOL), "allowed_for_rag": _pick(5, "true", "true", "false"), "eligibility_class": _pick(4, "training_and_retrieval", "retrieval_only", "neither"), "license": _pick(13, "owned", "unknown", "cc0-1.0", None),
    "rights_basis": _pick(3, "open-license", "open-license", ""), "attribution_required": _pick(6, *_BOOL), "attribution_text": _pick(2, "by us", " ", None), "removal_required": _pick(9, "false", "true", None), "provenance_status": _pick(3, "complete", "partial"),
    "char_count": _pick(8, "11", "18", "0"), "chunk_size_ceiling": _pick(2, "900", "10", "0"), "page_from": _pick(3, "1", "2", "0"), "page_to": _pick(2, "1", "3", "0"), "section_count": _pick(5, "1", "4", None), "section_exempt": _pick(7, *_BOOL),
    "page_errors": "CASE WHEN k % 2 = 0 THEN split('p1', ',') END", "fallback_flags": "CASE WHEN k % 5 < 2 THEN split('ocr', ',') END", "metrics": f"split({_pick(3, 'no_op_transform,removed_urls,removed_html_tags,removed_boilerplate,token_delta,repeated_pass_delta', 'no_op_transform,token_delta')}, ',')",
    "relevance_score": _pick(2, "0.5", "1.5", None), "risk_score": _pick(3, "0.1", "-1"), "review_status": _pick(2, "approved", "odd"), "gone": _pick(1, "none", "run_id", "text", "license", "heading", "acquisition", "page_from", "candidate_domain", "metrics"),
}
_BASE_GONE = "'run_id', 'license'"
_TRUE = lambda x: f"coalesce({x}, false)"
_SIZE = "length(text)"
_BY_STAGE: dict[str, list[tuple[str, str]]] = {}
_LEAKS = [("url", "regexp_matches(text, '(?i)https?://\\S+|www\\.\\S+')"), ("html", "regexp_matches(text, '<[a-zA-Z/][^>]*>')"), ("json_wrapper", "text LIKE '[{\"text\"%'"), ("boilerplate", "contains(lower(text), 'copyright')")]
_EXPORT = [("export_class", "eligibility_class <> 'training_and_retrieval'"), ("export_provenance", "provenance_status <> 'complete'"), ("export_removal", _TRUE("removal_required"))]
_SHAPE = [("class", f"eligibility_class <> {_DERIVED}"), ("unknown_rights", _KNOWN_NOT), ("attribution_text", f"{_TRUE('attribution_required')} AND coalesce(trim(attribution_text), '') = ''")]
_HEADING = [("heading", f"coalesce(heading, '') = '' AND NOT {_TRUE('allow_empty_heading')}")]
_METRICS = ("no_op_transform", "removed_urls", "removed_html_tags", "removed_boilerplate", "token_delta", "repeated_pass_delta")
_BY_STAGE["cleaned"] = [("base_fields", f"gone IN ({_BASE_GONE})"), ("stage_fields", "gone = 'text'"), *_SHAPE, *_LEAKS, *_EXPORT, *[(f"metric_{m}", f"NOT list_contains(metrics, '{m}')") for m in _METRICS]]
_BY_STAGE["sectionized"] = [
    ("base_fields", f"gone IN ({_BASE_GONE})"), ("stage_fields", "gone IN ('text', 'heading')"), *_SHAPE, *_LEAKS, *_EXPORT, *_HEADING,
    ("collapsed", f"(CASE WHEN page_to = 0 THEN (CASE WHEN page_from = 0 THEN 1 ELSE page_from END) ELSE page_to END) > (CASE WHEN page_from = 0 THEN 1 ELSE page_from END) AND coalesce(section_count, 0) <= 1 AND NOT {_TRUE('section_exempt')}"),
]
_BY_STAGE["chunked"] = [
    ("base_fields", f"gone IN ({_BASE_GONE})"), ("stage_fields", "gone IN ('text', 'heading')"), *_SHAPE, *_LEAKS, *_EXPORT, *_HEADING, ("char_count", f"char_count <> {_SIZE}"),
    ("oversized", f"{_SIZE} > least(1800, CASE WHEN chunk_size_ceiling = 0 THEN 1800 ELSE chunk_size_ceiling END)"),
]
_BY_STAGE["extracted"] = [("base_fields", f"gone IN ({_BASE_GONE})"), ("stage_fields", "gone IN ('text', 'page_from')"), *_SHAPE, *_EXPORT, ("page_errors", "page_errors IS NOT NULL AND fallback_flags IS NULL")]
_BY_STAGE["raw"] = [("base_fields", f"gone IN ({_BASE_GONE})"), ("stage_fields", "gone = 'acquisition'"), *_SHAPE, *_EXPORT]
_BY_STAGE["discovery_candidate"] = [
    ("base_fields", "gone IN ('run_id', 'candidate_domain')"), ("stage_fields", "gone = 'candidate_domain'"), ("relevance_score", "relevance_score IS NULL OR relevance_score > 1"), ("risk_score", "risk_score < 0"), ("review_status", "review_status = 'odd'"),
]
_RECORD_SQL = " UNION ALL ".join(f"SELECT k, '{s}' AS expected, {_sql(('stage', f'stage IS DISTINCT FROM {s!r}'), *[(code, f'stage = {s!r} AND ({bad})') for code, bad in _BY_STAGE[s]])} AS errors FROM m" for s in _STAGES)


@query(f"WITH {_cte(_RECORD)} {_RECORD_SQL}")
def record_contract(t: Tables) -> DataFrame:
    """Every record held against each stage; one of another stage fails that alone."""
    names = dict.fromkeys([*V.RECORD_FIELDS, *V.CANDIDATE_FIELDS, *[f for fs in V.STAGE_FIELDS.values() for f in fs]])
    rows = _rows(t, _RECORD).withColumn("fields", F.array_except(F.array(*map(F.lit, names)), F.array("gone")))
    sides = F.array(*[F.struct(F.lit(s).alias("expected"), _codes(V.record_rules(s, training_export=True))) for s in _STAGES])
    return rows.select("k", F.inline(sides))


_GAME = {
    "armor_class": _pick(1, "12", "0", None), "max_hp": _pick(2, "20", "8"), "current_hp": _pick(3, "8", "12", "-1", "0"), "attack_range": _pick(5, "1", "0"), "movement_remaining": _pick(2, "6", "3", "9"), "speed": _pick(4, "6", None, "4"),
    "initiative": f"split({_pick(1, 'a,b', 'b,a', 'a', None)}, ',')", "combatants": f"split({_pick(2, 'a,b', 'a,b,c')}, ',')", "current_index": _pick(3, "0", "1", "2", "-1"), "round_number": _pick(7, "1", "0"),
    "campaign_id": _pick(2, "c1", "c2"), "inner_campaign": _pick(3, "c1", None), "campaign_party": _pick(1, "p1", "p2"), "party_id": _pick(5, "p1", "p2"), "scenes": f"split({_pick(2, 's1,s2', 's2')}, ',')", "current_scene_id": _pick(3, "s1", "s2", None),
    "member_ids": f"split({_pick(4, 'h1', 'h1,h2', 'h3')}, ',')", "player_ids": f"split({_pick(7, 'u1', 'u1,u2', 'u9')}, ',')", "action_counter": _pick(3, "0", "5", "-2"),
}
_GAME_SQL = [
    ("combatant", [("armor_class", "armor_class IS NULL OR armor_class < 1"), ("max_hp", "max_hp < 1"), ("current_hp", "current_hp < 0"), ("attack_range", "attack_range < 1"), ("hp_over_max", "current_hp > max_hp"), ("movement_over_speed", "movement_remaining > speed")]),
    ("combat", [("no_initiative", "initiative IS NULL"), ("current_index", "current_index < 0 OR current_index >= coalesce(len(initiative), 0)"), ("round_number", "round_number < 1"), ("initiative_ids", "initiative IS NULL OR list_sort(initiative) <> list_sort(combatants)")]),
    ("session", [
        ("campaign_id", "inner_campaign IS DISTINCT FROM campaign_id"), ("party_id", "campaign_party <> party_id"), ("current_scene", "current_scene_id IS NULL OR NOT list_contains(scenes, current_scene_id)"), ("party_members", "list_contains(member_ids, 'h3')"),
        ("players", "list_contains(player_ids, 'u9')"), ("action_counter", "action_counter < 0"),
    ]),
]


@query(f"WITH {_cte(_GAME)} " + " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {_sql(*rules)} AS errors FROM m" for kind, rules in _GAME_SQL))
def domain_invariants(t: Tables) -> DataFrame:
    rows = _rows(t, _GAME).withColumns({
        "campaign": F.struct(F.col("inner_campaign").alias("campaign_id"), F.col("campaign_party").alias("party_id")), "party": F.struct("party_id", "member_ids"),
        "characters": F.create_map(F.lit("h1"), F.lit("u1"), F.lit("h2"), F.lit("u2")),
    })
    kinds = {"combatant": V.combatant_rules(), "combat": V.combat_rules(), "session": V.session_rules()}
    return rows.select("k", F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), _codes(r)) for n, r in kinds.items()])))


_DATASET = {
    "dataset_id": _pick(1, "set-1", "Set1", "s", "a.b_c"), "version": _pick(2, "v1", "v1.20", "1v.0", "v1."), "content_hash": _pick(3, _HASH, "x"), "task_family": _pick(5, "narration", "dancing"), "role": _pick(4, "router", "actor", "narrator"),
    "split": _pick(3, None, "train", "half"), "source_ids": f"split({_pick(2, 'src-1,src-2', 'src-1,src-1', 'ab')}, ',')", "policy_categories": f"split({_pick(3, 'train_and_rag', 'rag_only,blocked', 'blocked,blocked', 'own')}, ',')",
    "record_count": _pick(7, "0", "10", "-1", None), "created_at": _pick(2, "2024-02-29", "2023-02-29", "soon"), "allowed_for_training": _pick(1, *_BOOL),
}
_DATASET_SQL = _sql(
    ("pattern_dataset_id", "dataset_id IN ('Set1', 's')"), ("pattern_version", "version IN ('1v.0', 'v1.')"), ("pattern_content_hash", "content_hash = 'x'"), ("enum_task_family", "task_family = 'dancing'"), ("enum_role", "role = 'actor'"), ("enum_split", "split = 'half'"),
    ("source_ids", "len(list_distinct(source_ids)) < len(source_ids) OR list_contains(source_ids, 'ab')"), ("policy_categories", "len(list_distinct(policy_categories)) < len(policy_categories) OR list_contains(policy_categories, 'own')"),
    ("record_count", "record_count IS NULL OR record_count < 0"), ("created_at", "try_cast(created_at AS DATE) IS NULL"), ("training_category", "allowed_for_training AND NOT list_contains(policy_categories, 'train_and_rag')"),
    ("blocked_training", "allowed_for_training AND list_contains(policy_categories, 'blocked')"),
)


@query(f"WITH {_cte(_DATASET)} SELECT k, {_DATASET_SQL} AS errors FROM m")
def dataset_contract(t: Tables) -> DataFrame:
    return _rows(t, _DATASET).select("k", _codes(V.dataset_rules()))


_CALLS = {"content": _pick(1, '{"mode": "play", "why": "x"}', '{"mode": "play"}', '["mode"]', "{broken", "A door opens.", "See the manifest.", " "), "expects_json": _pick(7, "true", "false")}


@query(f"""WITH {_cte(_CALLS)} SELECT k, CASE WHEN expects_json THEN coalesce(json_type(try_cast(content AS JSON)) = 'OBJECT' AND len(list_filter(['mode', 'why'], lambda x: NOT list_contains(json_keys(try_cast(content AS JSON)), x))) = 0, false)
 ELSE trim(content) <> '' AND NOT regexp_matches(content, '(?i)\\b(?:manifest|pipeline|watchdog)\\b') END AS passed FROM m""")
def eval_calls(t: Tables) -> DataFrame:
    """Answers of an evaluation: JSON ones by the keys of their contract, prose by the rules of output."""
    keyed = V.keyed_json(F.col("content"), F.array(F.lit("mode"), F.lit("why")))
    return rulebook.answers(F.col("content"), F.col("expects_json"), keyed, _rows(t, _CALLS)).select("k", "passed")
