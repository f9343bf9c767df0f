"""The contracts of dataset manifests and local models, as JSON schemas that are compiled to column rules."""

from __future__ import annotations

_LINE, _STRINGS = {"type": "string", "minLength": 1}, {"type": "array", "items": {"type": "string"}}
_COUNT, _FLAG = {"type": "integer", "minimum": 0}, {"type": "boolean"}


def _enum(names: str) -> dict:
    return {"type": "string", "enum": names.split()}


def _object(properties: dict, required: str | None = None) -> dict:
    """An object of these properties alone, all of them required unless ``required`` names some."""
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties) if required is None else required.split()}


def _some(items: dict, unique: bool = True) -> dict:
    return {"type": "array", "minItems": 1, "items": items} | ({"uniqueItems": True} if unique else {})


# Names, vocabularies and patterns of the contracts.
ELIGIBILITY = "training_and_retrieval retrieval_only neither"
DATASET_TYPES = "discovery_candidates raw_snapshot extracted_corpus cleaned_corpus sectionized_corpus chunked_corpus retrieval_corpus training_corpus indexed_corpus quarantine"
STAGES = "discovery_candidate raw extracted cleaned sectionized chunked indexed training_export quarantine"
CHECKS = "schema_validation_passed qa_gates_passed provenance_complete idempotency_passed removal_sweep_complete"
DATASET_NEEDS = "manifest_version dataset_id dataset_name dataset_type stage version created_at pipeline_version source_manifests record_count rejected_count quarantined_count eligibility_summary validation_summary output_path"
TASK_FAMILIES, ROLES, RUNTIMES = "narration teaching reasoning routing", "narrator arbiter router", "provider_neutral ollama"
SAFETY = "backend_validates_output retrieval_is_backend_supplied model_is_non_authoritative_for_state"
REQUEST_NEEDS, RESPONSE_NEEDS, REASONING_NEEDS = "task_family role instruction context constraints", "answer role task_family", "used_context_ids"

DATASET_MANIFEST = _object(
    {
        "manifest_version": {"type": "integer", "const": 1},
        "dataset_id": {"type": "string", "pattern": r"^[a-z0-9_\-:.]+$"},
        "dataset_name": _LINE,
        "dataset_type": _enum(DATASET_TYPES),
        "stage": _enum(STAGES),
        "version": _LINE,
        "created_at": {"type": "string", "format": "date-time"},
        "pipeline_version": _LINE,
        "parent_dataset_ids": _STRINGS,
        "source_manifests": _some(_object({"source_id": {"type": "string"}, "version": {"type": "string"}, "content_hash": {"type": "string"}, "eligibility_class": _enum(ELIGIBILITY)}, "source_id version eligibility_class"), unique=False),
        "record_count": _COUNT,
        "rejected_count": _COUNT,
        "quarantined_count": _COUNT,
        "eligibility_summary": _object({name: _COUNT for name in ELIGIBILITY.split()}),
        "validation_summary": _object({name: _FLAG for name in CHECKS.split()} | {"notes": {"type": "string"}}, CHECKS),
        "output_path": _LINE,
        "quarantine_path": {"type": "string"},
        "index_info": _object({name: {"type": "string"} for name in ("index_name", "vector_store", "embedding_model")} | {"embedding_dimensions": {"type": "integer", "minimum": 1}}, ""),
        "notes": {"type": "string"},
    },
    DATASET_NEEDS,
)


def _holds(field: str, names: str) -> dict:
    """An object whose array ``field`` contains each of the names."""
    return {"properties": {field: {"allOf": [{"contains": {"const": n}} for n in names.split()]}}}


MODEL_CONTRACT = _object(
    {
        "contract_id": {"type": "string", "minLength": 3},
        "contract_version": {"type": "string", "pattern": r"^[0-9]+\.[0-9]+$"},
        "runtime_target": _enum(RUNTIMES),
        "supported_task_families": _some(_enum(TASK_FAMILIES)),
        "supported_roles": _some(_enum(ROLES)),
        "request_envelope": _object({"required_fields": _some({"type": "string"}), "context_fields": _STRINGS, "constraint_fields": _STRINGS}),
        "response_envelope": _object({"required_fields": _some({"type": "string"}), "optional_fields": _STRINGS}),
        "safety": _object({name: _FLAG for name in SAFETY.split()}),
        "notes": {"type": "string"},
    }
) | {
    "allOf": [
        {"properties": {"request_envelope": _holds("required_fields", REQUEST_NEEDS), "response_envelope": _holds("required_fields", RESPONSE_NEEDS)}},
        {
            "if": _holds("supported_task_families", "reasoning"),
            "then": {"properties": {"response_envelope": {"anyOf": [_holds("required_fields", REASONING_NEEDS), _holds("optional_fields", REASONING_NEEDS)]}}},
        },
    ]
}
