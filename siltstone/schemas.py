"""Declared schemas: no reader or writer infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType}


def _type(text: str) -> T.DataType:
    return T.ArrayType(_type(text[6:-1])) if text.startswith("array<") else _PLAIN[text]()


def ddl(text: str) -> T.StructType:
    """Columns of plain types and arrays of them; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (part.split() for part in text.split(","))])


#: Column names of the inputs and of every table that is written.
CAPTION_COLUMNS = ("caption_1", "caption_2", "caption_3", "caption_4", "caption_5")
METADATA_COLUMNS = ("file_name", "keywords", "sound_id", "sound_link", "start_end_samples", "manufacturer", "license")

MANIFEST = ddl("audio_id string, split string, original_file_name string, audio_file_name string, local_audio_path string, duration_seconds double, captions array<string>, caption_summary string, keywords array<string>, sound_id string")
UNIT = ddl("unit_id string, schema_version string, grounding_standard string, audio_count int, audio_ids array<string>, local_audio_paths array<string>, audio_file_names array<string>, audio_captions array<array<string>>")
CONDITION = ddl("condition_name string, claim_status string, evidence_sources array<string>, instruction string")
CLAIM = ddl("claim_text string, claim_status string, evidence_sources array<string>, supporting_caption_phrases array<string>, contradiction_basis string, forbidden_inferences array<string>, confidence double")
QA_GENERATED = ddl("question string, claim_evaluation_explanation string")
QA = ddl("question string, answer array<string>, answer_source array<string>, claim_evaluation_explanation string, required_evidence_sources array<string>")
VERIFIER = ddl("verifier_status string, validation_errors array<string>, validation_notes string, corrected_claim_status string, corrected_evidence_sources array<string>")
EXAMPLE = ddl("schema_version string, audio_count int, audio_ids array<string>, local_audio_paths array<string>, audio_file_names array<string>, claim_text string, claim_status string, evidence_sources array<string>, question string, answer array<string>")

#: The statuses, and the labels they give answers.
CLAIM_STATUSES = ["SUPPORTED", "CONTRADICTED"]
LABELS = {"SUPPORTED": "supported", "CONTRADICTED": "contradicted"}

_text, _texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_filled = {"type": "string", "minLength": 1}
_sources = {"type": "array", "items": {"type": "string", "pattern": "^AUDIO_[1-9][0-9]*$"}, "uniqueItems": True}


def closed(**properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


#: Payload schemas of the generation stages, and the pattern of source labels above.
CLAIM_JSON = closed(claim_text=_filled, claim_status={"type": "string", "enum": CLAIM_STATUSES}, evidence_sources=_sources, supporting_caption_phrases=_texts, contradiction_basis=_text, forbidden_inferences=_texts, confidence={"type": "number", "minimum": 0.0, "maximum": 1.0})
QA_GENERATED_JSON = closed(question=_filled, claim_evaluation_explanation=_filled)
QA_JSON = closed(question=_filled, answer={"type": "array", "minItems": 2, "maxItems": 2, "items": _filled}, answer_source=_sources, claim_evaluation_explanation=_filled, required_evidence_sources=_sources)
VERIFIER_JSON = closed(verifier_status={"type": "string", "enum": ["PASS", "FAIL"]}, validation_errors=_texts, validation_notes=_text, corrected_claim_status={"type": ["string", "null"], "enum": [*CLAIM_STATUSES, None]}, corrected_evidence_sources=_sources)
