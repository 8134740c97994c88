"""Validation as ordered rules (code, whether broken): the first broken one is a row's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsons import all_problems, first_problem, opened_problems
from ..schemas import CLAIM_JSON, LABELS, QA_GENERATED_JSON, QA_JSON, VERIFIER_JSON

Rules = list[tuple[str, Column]]


class ValidationFailed(ValueError):
    """A table breaks a rule that holds for all of its rows."""


def verdict(rows: DataFrame, rules: Rules, name: str = "problem") -> DataFrame:
    """rows with the first broken rule's code (null if none) and all of them."""
    return rows.withColumn(name, first_problem(rules)).withColumn(f"{name}s", all_problems(rules))


def _same_items(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def _unknown(sources: Column, count: Column) -> Column:
    return F.size(F.array_except(sources, X.source_labels(count))) > 0


def benchmark_answer(status: Column, sources: Column) -> Column:
    """[label, source]; null where the status has no label or there is not exactly one source."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[status]
    return F.when(label.isNotNull() & (F.size(sources) == 1), F.array(label, F.get(sources, F.lit(0))))


def manifest_rules() -> Rules:
    hints = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("audio_file_name", "local_audio_path", "original_file_name")]
    return [("no_path_hint", hints[0] & hints[1] & hints[2])]


def unit_rules() -> Rules:
    out: Rules = [("audio_count", F.coalesce(F.col("audio_count"), F.lit(0)) < 1)]
    for c in ("audio_ids", "audio_file_names", "audio_captions"):
        out.append((f"{c}:missing", F.col(c).isNull()))
        out.append((f"{c}:length", F.size(c) != F.col("audio_count")))
    return [*out, ("local_audio_paths:length", F.col("local_audio_paths").isNotNull() & (F.size("local_audio_paths") != F.col("audio_count")))]


def claim_rules(claim: Column, target: Column, captions: Column, count: Column, opened: Column | None = None, joined: bool = False) -> Rules:
    """claim and target: structs; captions: a list for each source; opened: the claim's JSON (see jsons.opened), where its schema is to be held. Of ``joined`` captions a source's list has all as one text (see text.as_one), or nothing."""
    sources, phrases = claim["evidence_sources"], claim["supporting_caption_phrases"]
    own = F.get(captions, F.regexp_extract(F.get(sources, F.lit(0)), r"(\d+)$", 1).cast("int") - 1)
    own = F.coalesce(own, F.array().cast("array<string>")) if joined else X.nonblank(own)
    held = (lambda p: X.is_said(F.get(own, F.lit(0)), p)) if joined else lambda p: X.is_grounded(own, p)
    basis = X.strip(F.coalesce(claim["contradiction_basis"], F.lit("")))
    against = claim["claim_status"] == "CONTRADICTED"
    return [
        *(opened_problems(opened, CLAIM_JSON) if opened is not None else []),
        ("status_differs", ~claim["claim_status"].eqNullSafe(target["claim_status"])),
        ("unknown_source", _unknown(sources, count)),
        ("sources_differ", ~_same_items(sources, target["evidence_sources"])),
        ("not_one_source", F.size(sources) != 1),
        ("claim_too_short", F.size(X.words(claim["claim_text"])) < 3),
        ("no_phrases", F.size(phrases) < 1),
        ("no_captions", F.size(own) < 1),
        ("not_grounded", F.exists(phrases, lambda p: ~held(p))),
        ("no_basis", against & (basis == "")),
        ("basis_is_absence", against & X.argues_from_absence(basis)),
    ]


def build_qa(generated: Column, claim: Column) -> Column:
    """The generated question and explanation with what follows from the claim."""
    sources = claim["evidence_sources"]
    return F.struct(generated["question"].alias("question"), benchmark_answer(claim["claim_status"], sources).alias("answer"), sources.alias("answer_source"), generated["claim_evaluation_explanation"].alias("claim_evaluation_explanation"), sources.alias("required_evidence_sources"))


def qa_rules(qa: Column, claim: Column, count: Column, opened: Column | None = None, opened_generated: Column | None = None) -> Rules:
    question, sources = X.strip(F.coalesce(qa["question"], F.lit(""))), claim["evidence_sources"]
    return [
        *(opened_problems(opened_generated, QA_GENERATED_JSON) if opened_generated is not None else []),
        *(opened_problems(opened, QA_JSON) if opened is not None else []),
        ("unknown_source", _unknown(qa["required_evidence_sources"], count)),
        ("sources_differ", ~_same_items(qa["required_evidence_sources"], sources)),
        ("question_form", (F.size(X.words(question)) < 6) | ~F.endswith(question, F.lit("?"))),
        ("question_not_relevant", ~X.is_relevant(question, X.strip(F.coalesce(claim["claim_text"], F.lit(""))))),
        ("answer_differs", ~qa["answer"].eqNullSafe(benchmark_answer(claim["claim_status"], sources))),
        ("answer_source_differs", ~qa["answer_source"].eqNullSafe(sources)),
    ]


def verifier_rules(verifier: Column, count: Column, opened: Column | None = None) -> Rules:
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return [
        *(opened_problems(opened, VERIFIER_JSON) if opened is not None else []),
        ("unknown_source", _unknown(verifier["corrected_evidence_sources"], count)),
        ("rejected", verifier["verifier_status"] == "FAIL"),
        ("pass_with_errors", ~none(verifier["validation_errors"])),
        ("pass_with_corrections", verifier["corrected_claim_status"].isNotNull() | ~none(verifier["corrected_evidence_sources"])),
    ]


def rejection_detail(verifier: Column) -> Column:
    said = F.nullif(F.array_join(verifier["validation_errors"], "; "), F.lit(""))
    notes = F.nullif(X.strip(F.coalesce(verifier["validation_notes"], F.lit(""))), F.lit(""))
    return F.substring(F.coalesce(said, notes, F.lit("no reason provided")), 1, 500)


def require(rows: DataFrame, columns: list[str], rules: Rules = ()) -> DataFrame:
    """rows, if it has the columns, at least one row, and none that breaks a rule; else an error that names the first."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValidationFailed(f"missing columns: {missing}")
    if rows.isEmpty():
        raise ValidationFailed("the table is empty")
    if rules:
        bad = rows.select(first_problem(list(rules)).alias("problem")).where("problem is not null").groupBy("problem").count().orderBy(F.desc("count")).first()
        if bad:
            raise ValidationFailed(f"{bad['count']} rows break {bad['problem']}")
    return rows


def strict(errors: DataFrame) -> None:
    """Strict mode: any recorded error ends the run (after the errors were written)."""
    if n := errors.count():
        raise ValidationFailed(f"strict mode: {n} recorded errors")
