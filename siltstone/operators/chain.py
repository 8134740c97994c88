"""The chain from a unit to an example: target, claim, question, verdict; every candidate ends as an example, a near-duplicate or an error."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.jsons import canonical_json
from ..sources.scratch import put_aside
from . import dedup, generate, select, validate
from .answers import AnswerLog
from .generate import Generator, Reasoning, Stage

#: Stages by the names that their feedback begins with, and how many captions of a source a prompt shows.
CLAIM, QA, VERIFIER = "ClaimAgent", "QAAgent", "VerifierAgent"
SHOWN_CAPTIONS = 3
#: Places of each stage's template.
PLACES = {
    CLAIM: ("audio_context", "target_condition_json", "validation_feedback", "reasoning_instruction"),
    QA: ("claim_record_json", "validation_feedback", "reasoning_instruction"),
    VERIFIER: ("audio_context", "target_condition_json", "claim_record_json", "qa_record_json", "validation_feedback", "reasoning_instruction"),
}
UNIT_COLUMNS = ["unit_id", "unit_index", "audio_count", "audio_ids", "local_audio_paths", "audio_file_names", "audio_captions"]


class GenerationFailed(RuntimeError):
    """A run that is to stop at its first error had one."""


@dataclass(frozen=True)
class Outcome:
    """Tables of a run: final examples, their audit rows, error rows, candidates left out as near-duplicates (without captions, which end at the first stage), counts."""

    examples: DataFrame
    audit: DataFrame
    errors: DataFrame
    duplicates: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class Chain:
    """How units become examples. ``templates`` has a text for each stage, with places as in PLACES.

    ``on_error`` "continue" keeps a candidate's error to itself; "abort" ends
    the run after the first wave of ``wave`` candidates in which one fails, and
    asks nothing for later ones. ``concurrency`` bounds the calls at a time over
    all tasks, ``pool`` those of one. ``log`` is a folder for answers: a run that
    was stopped and is started again with it asks only for what is missing.
    """

    templates: dict[str, str]
    generator: Generator
    reasoning: Reasoning = field(default_factory=Reasoning)
    each: int = 1
    attempts: int = 2
    threshold: float = 0.90
    conditions: str = "cycle"
    seed: int = 42
    pool: int = 8
    concurrency: int | None = None
    on_error: str = "continue"
    wave: int = 1024
    log: AnswerLog | None = None

    def __post_init__(self) -> None:
        if min(self.each, self.attempts, self.pool, self.wave, 1 if self.concurrency is None else self.concurrency) < 1:
            raise ValueError("candidates, attempts and concurrency must be 1 or more")
        if not 0 < self.threshold <= 1:
            raise ValueError("the similarity threshold must be over 0 and at most 1")
        if self.on_error not in ("continue", "abort") or self.conditions not in ("cycle", "random"):
            raise ValueError("on_error is continue or abort, conditions are taken by cycle or at random")
        for stage, places in PLACES.items():
            if stage not in self.templates:
                raise ValueError(f"there is no template for {stage}")
            if unknown := set(re.findall(r"\{\{\s*(\w+)\s*\}\}", self.templates[stage])) - set(places):
                raise ValueError(f"the template of {stage} has places without a value: {sorted(unknown)}")

    def stages(self) -> list[Stage]:
        target, claim, count = F.col("target"), F.col("claim"), F.col("audio_count")
        values = {
            "audio_context": F.col("audio_context"), "target_condition_json": _target_json(), "reasoning_instruction": F.lit(self.reasoning.prompt_text),
            "claim_record_json": _struct_json("claim", S.CLAIM), "qa_record_json": _struct_json("qa", S.QA),
        }

        def prompt(stage: str):
            return lambda feedback: X.render_template(self.templates[stage], **{p: feedback if p == "validation_feedback" else values[p] for p in PLACES[stage]})

        return [
            Stage(CLAIM, prompt(CLAIM), S.CLAIM_JSON, S.CLAIM, lambda r: validate.claim_rules(r, target, F.col("audio_captions"), count, joined=True), attempts=self.attempts),
            Stage(QA, prompt(QA), S.QA_GENERATED_JSON, S.QA_GENERATED, lambda r: validate.qa_rules(r, claim, count), lambda r: validate.build_qa(r, claim), self.attempts),
            Stage(VERIFIER, prompt(VERIFIER), S.VERIFIER_JSON, S.VERIFIER, lambda r: validate.verifier_rules(r, count), attempts=1),
        ]


def _context() -> Column:
    target = F.col("target")
    chosen = X.selected_labels(F.col("audio_count"), target["evidence_sources"], target["condition_name"], target["instruction"])
    return X.render_context(F.col("audio_captions"), X.source_labels(F.col("audio_count")), chosen, SHOWN_CAPTIONS, F.col("unit_index") + F.col("candidate_index"), clean=True)


def _target_json() -> Column:
    """The target without its name, which a prompt does not need."""
    return canonical_json(**{c: F.col(f"target.{c}") for c in ("claim_status", "evidence_sources", "instruction")})


def _struct_json(name: str, schema) -> Column:
    return canonical_json(**{f.name: F.col(f"{name}.{f.name}") for f in schema.fields})


def plan(units: DataFrame, chain: Chain) -> DataFrame:
    """The candidates of every unit with their target and what is wrong with the unit (``problem``).

    A unit's captions are cleaned and joined once, for all candidates and
    attempts: ``said`` has for each source all as one text.
    """
    validate.require(units, UNIT_COLUMNS)
    clean = units.select(*UNIT_COLUMNS).withColumn("audio_captions", F.transform("audio_captions", X.nonblank))
    clean = clean.withColumn("said", F.transform("audio_captions", lambda c: F.when(F.size(c) > 0, F.array(X.as_one(c))).otherwise(F.array().cast("array<string>"))))
    rows = select.fan_out(clean, chain.each).withColumn("problem", validate.first_problem(validate.unit_rules()))
    count = F.greatest(F.coalesce("audio_count", F.lit(0)), F.lit(1))
    return rows.withColumn("target", select.choose_condition(count, F.col("condition_index"), chain.conditions, chain.seed))


def dry_run(units: DataFrame, chain: Chain) -> DataFrame:
    """Everything is looked at as for a run, and no model is called: the counts of a run that is yet to come, with the units that break a rule as errors."""
    n = plan(units, chain).agg(F.count("*").alias("planned"), F.count_if(F.col("problem").isNotNull()).alias("broken")).first()
    return generate.generation_stats(units.sparkSession, n["planned"], chain.each, 0, n["broken"], 0, dry_run=True)


def run(units: DataFrame, chain: Chain) -> Outcome:
    """All units through the chain. Units: UNIT_COLUMNS, with unit_index numbering them. What is counted is counted as it is written."""
    shown = plan(units, chain).withColumn("audio_context", F.when(F.col("problem").isNull(), _context()))
    planned = put_aside(shown.withColumn("audio_captions", F.col("said")).drop("said"), "planned", {"n": F.count(F.lit(1)), "broken": F.count_if(F.col("problem").isNotNull())})
    n_errors = planned.siltstone_counts["broken"]
    none = F.array().cast("array<string>")
    start = planned.withColumn("errors", F.when(F.col("problem").isNotNull(), F.array(F.concat(F.lit("unit: "), "problem"))).otherwise(none)).drop("problem")
    start = start.withColumn("visible_reasoning_stripped", none)
    nothing = {"failure": generate.FAILURE, "raw": "string", "request": "struct<model:string,message_count:int,prompt_chars:bigint,response_format:string,extra_fields:array<string>>"}
    broken = start.where(F.size("errors") > 0).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    errors, rows = [generate.error_rows(broken, "unit")], start.where(F.size("errors") == 0)
    _stop_at(chain, errors)
    for stage, name in zip(chain.stages(), ("claim", "qa", "verifier")):
        asked = chain.generator.for_schema(f"{name}_output", stage.schema)
        number = F.floor(F.col("condition_index") / chain.wave)  # units in order
        stop = {"wave": number, "after_wave": lambda bad, at=stage.name: _stop_at(chain, [generate.error_rows(bad, at)])} if chain.on_error == "abort" else {}
        ok, failed = generate.with_retries(rows, stage, asked, chain.reasoning, chain.pool, chain.concurrency, chain.log, ("unit_id", "unit_index", "candidate_index"), **stop)
        errors.append(generate.error_rows(failed, stage.name))
        n_errors += failed.siltstone_counts["open"]
        seen = F.concat("visible_reasoning_stripped", F.when(F.col("stripped"), F.array(F.lit(stage.name))).otherwise(none))
        rows = ok.withColumns({"visible_reasoning_stripped": seen, name: F.col("record"), f"raw_{name}_text": F.col("text")}).drop("record", "text", "stripped", "attempt")
        if stage.name == CLAIM:  # from here on, what a prompt shows of the captions stands for them
            rows = rows.withColumn("audio_captions", F.lit(None).cast(rows.schema["audio_captions"].dataType))
    rows = rows.drop("audio_context")
    told = dedup.keep_distinct(
        rows.withColumns({"__claim": F.col("claim.claim_text"), "__question": F.col("qa.question")}), "unit_id", "condition_index", "__claim", "__question",
        F.concat_ws("|", "claim.claim_status", F.array_join("claim.evidence_sources", ",")), chain.threshold,
    ).drop("__claim", "__question")
    told = put_aside(told, "distinct", {"kept": F.count_if("kept"), "gone": F.count_if(~F.col("kept"))})
    kept, duplicates = told.where("kept").drop("kept"), told.where("not kept").drop("kept")
    failed = errors[0]
    for e in errors[1:]:
        failed = failed.unionByName(e)
    counts = told.siltstone_counts
    stats = generate.generation_stats(units.sparkSession, planned.siltstone_counts["n"], chain.each, counts["kept"], n_errors, counts["gone"])
    return Outcome(generate.final_examples(kept), generate.audit_rows(kept), failed, duplicates, stats)


def _stop_at(chain: Chain, errors: list[DataFrame]) -> None:
    if chain.on_error == "abort" and (first := errors[-1].first()) is not None:
        raise GenerationFailed(f"{first['stage']}, unit {first['unit_id']}: {first['error_type']}: {first['message']}")
