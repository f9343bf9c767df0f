"""Queries over compiled JSON schemas: documents made from customer keys, and their violations listed by hand in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..operators import contracts, schema_rules


def _pick(step: int, *values: str | None) -> str:
    """One of some JSON fragments by key, null for a field that is left out: the same SQL for both engines."""
    return f"CASE CAST(floor(k / {step}) AS INT) % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def _spark(t: Tables, fields: dict[str, str], schema: dict) -> DataFrame:
    keys = t.customer.selectExpr("c_custkey AS k").repartition(2 * t.spark.sparkContext.defaultParallelism, "k")  # many rules a row: all cores, however the file is cut
    rows = keys.selectExpr("k", *[f"{v} AS `{n}`" for n, v in fields.items()])
    doc = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), F.col(f"`{n}`")) for n in fields]), F.lit("}"))
    return rows.select("k", F.array_join(schema_rules.violations(schema, doc), ",").alias("codes"))


def _by_hand(fields: dict[str, str], codes: list[tuple[str, str]]) -> str:
    made = ", ".join(f'{v} AS "{n}"' for n, v in fields.items())
    cases = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in codes)
    return f"WITH m AS (SELECT k, {made} FROM (SELECT c_custkey AS k FROM customer)) SELECT k, array_to_string(list_sort(list_filter([{cases}], lambda c: c IS NOT NULL)), ',') AS codes FROM m"


_SOURCE = '{"source_id": "s", "version": "1", "eligibility_class": "neither"}'
_CHECKS = ", ".join(f'"{n}": true' for n in contracts.CHECKS.split())
_DATASET = {
    "manifest_version": _pick(1, "1", "2", '"1"', None),
    "dataset_id": _pick(2, '"ds:a-1"', '"Bad Id"'),
    "dataset_name": _pick(3, '"n"', '""'),
    "dataset_type": _pick(1, '"raw_snapshot"', '"raw"', "7"),
    "stage": _pick(2, '"raw"', '"raw_snapshot"', '"raw"'),
    "version": '\'"v"\'',
    "created_at": _pick(5, '"2024-02-29T10:00:00Z"', '"2023-02-29T10:00:00Z"', '"soon"', '"2024-01-01T00:00:00.5+02:00"'),
    "pipeline_version": '\'"p"\'',
    "source_manifests": _pick(2, f"[{_SOURCE}]", "[]", f'[{_SOURCE}, {{"source_id": 1, "version": "1", "eligibility_class": "odd"}}]', f"[{_SOURCE}, {{}}]", "{}"),
    "record_count": _pick(3, "0", "-1", "1.5", "2.0"),
    "rejected_count": "'0'",
    "quarantined_count": "'0'",
    "eligibility_summary": _pick(4, '{"training_and_retrieval": 1, "retrieval_only": 0, "neither": 0}', '{"training_and_retrieval": 1, "neither": -2}'),
    "validation_summary": _pick(7, f"{{{_CHECKS}}}", f'{{{_CHECKS}, "notes": "n"}}', f'{{{_CHECKS}, "more": 1}}', "null"),
    "output_path": '\'"o"\'',
    "index_info": _pick(6, None, '{"embedding_dimensions": 0}', '{"index_name": "i"}'),
    "odd": _pick(8, None, "1"),
}
_is = lambda f, *v: f'"{f}" IN (' + ", ".join(f"'{x}'" for x in v) + ")"
_DATASET_CODES = [
    ("$.manifest_version:const", _is("manifest_version", "2", '"1"')), ("$.manifest_version:type", _is("manifest_version", '"1"')), ("$:required.manifest_version", "manifest_version IS NULL"),
    ("$.dataset_id:pattern", _is("dataset_id", '"Bad Id"')), ("$.dataset_name:minLength", _is("dataset_name", '""')), ("$.dataset_type:enum", _is("dataset_type", '"raw"', "7")), ("$.dataset_type:type", _is("dataset_type", "7")),
    ("$.stage:enum", _is("stage", '"raw_snapshot"')), ("$.created_at:format", _is("created_at", '"2023-02-29T10:00:00Z"', '"soon"')),
    ("$.source_manifests:minItems", "source_manifests = '[]'"), ("$.source_manifests:type", "source_manifests = '{}'"), ("$.source_manifests[].source_id:type", "source_manifests LIKE '%odd%'"), ("$.source_manifests[].eligibility_class:enum", "source_manifests LIKE '%odd%'"),
    *[(f"$.source_manifests[]:required.{n}", "source_manifests LIKE '%{}]'") for n in ("source_id", "version", "eligibility_class")],
    ("$.record_count:minimum", _is("record_count", "-1")), ("$.record_count:type", _is("record_count", "1.5")),
    ("$.eligibility_summary:required.retrieval_only", "eligibility_summary LIKE '%-2%'"), ("$.eligibility_summary.neither:minimum", "eligibility_summary LIKE '%-2%'"),
    ("$.validation_summary:additionalProperties", "validation_summary LIKE '%more%'"), ("$.validation_summary:type", "validation_summary = 'null'"),
    ("$.index_info.embedding_dimensions:minimum", "index_info LIKE '%: 0}'"), ("$:additionalProperties", "odd IS NOT NULL"),
]


@query(_by_hand(_DATASET, _DATASET_CODES))
def dataset_manifest_contract(t: Tables) -> DataFrame:
    return _spark(t, _DATASET, contracts.DATASET_MANIFEST)


_REQUEST = '{"required_fields": ["task_family", "role", "instruction", "context", "constraints"], "context_fields": [], "constraint_fields": ["c"]}'
_SAFE = ", ".join(f'"{n}": true' for n in contracts.SAFETY.split())
_MODEL = {
    "contract_id": _pick(1, '"abc"', '"ab"'),
    "contract_version": _pick(2, '"1.0"', '"1"', '"v1.0"'),
    "runtime_target": _pick(3, '"ollama"', '"other"', None),
    "supported_task_families": _pick(1, '["narration"]', '["reasoning", "routing"]', '["reasoning", "reasoning"]', '["cooking"]', "[]"),
    "supported_roles": _pick(5, '["router"]', '["router", 1]'),
    "request_envelope": _pick(2, _REQUEST, '{"required_fields": ["role", "task_family"], "context_fields": [], "constraint_fields": []}', "1"),
    "response_envelope": _pick(1, '{"required_fields": ["answer", "role", "task_family"], "optional_fields": []}', '{"required_fields": ["answer", "role", "task_family", "used_context_ids"], "optional_fields": []}', '{"required_fields": ["answer", "role"], "optional_fields": ["used_context_ids"]}'),
    "safety": _pick(4, f"{{{_SAFE}}}", '{"backend_validates_output": "yes"}'),
    "notes": '\'""\'',
}
_MODEL_CODES = [
    ("$.contract_id:minLength", _is("contract_id", '"ab"')), ("$.contract_version:pattern", _is("contract_version", '"1"', '"v1.0"')), ("$.runtime_target:enum", _is("runtime_target", '"other"')), ("$:required.runtime_target", "runtime_target IS NULL"),
    ("$.supported_task_families:uniqueItems", _is("supported_task_families", '["reasoning", "reasoning"]')), ("$.supported_task_families[]:enum", _is("supported_task_families", '["cooking"]')), ("$.supported_task_families:minItems", _is("supported_task_families", "[]")),
    ("$.supported_roles[]:enum", "supported_roles LIKE '%1]'"), ("$.supported_roles[]:type", "supported_roles LIKE '%1]'"), ("$.request_envelope:type", "request_envelope = '1'"), ("$.request_envelope.required_fields:contains", "request_envelope LIKE '%[\"role\", \"task_family\"]%'"),
    ("$.response_envelope.required_fields:contains", "response_envelope LIKE '%\"role\"]%'"), ("$.response_envelope:anyOf(then)", "supported_task_families LIKE '%reasoning%' AND response_envelope NOT LIKE '%used%'"),
    ("$.safety.backend_validates_output:type", "safety LIKE '%yes%'"), *[(f"$.safety:required.{n}", "safety LIKE '%yes%'") for n in contracts.SAFETY.split()[1:]],
]


@query(_by_hand(_MODEL, _MODEL_CODES))
def model_contract(t: Tables) -> DataFrame:
    return _spark(t, _MODEL, contracts.MODEL_CONTRACT)
