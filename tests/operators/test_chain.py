import json
import re

import pytest
from pyspark.sql import functions as F

from siltstone import config
from siltstone import schemas as S
from siltstone.operators import chain as C
from siltstone.operators import generate as G

CAPTIONS = [["a dog barks at a car", "", "a loud dog"], ["rain falls"]]
UNIT = "unit_id string, unit_index long, audio_count int, audio_ids array<string>, local_audio_paths array<string>, audio_file_names array<string>, audio_captions array<array<string>>"
TEMPLATES = {
    C.CLAIM: "CLAIM\n{{audio_context}}\n{{target_condition_json}}\nFB {{validation_feedback}}\n{{reasoning_instruction}}",
    C.QA: "QA\n{{claim_record_json}}\nFB {{validation_feedback}}\n{{reasoning_instruction}}",
    C.VERIFIER: "VERIFIER\n{{audio_context}}\n{{target_condition_json}}{{claim_record_json}}{{qa_record_json}}\nFB {{validation_feedback}}{{reasoning_instruction}}",
}


def units(spark, n=1, **change):
    row = {"audio_count": 2, "audio_ids": ["a", "b"], "local_audio_paths": ["p/a", "p/b"], "audio_file_names": ["a.wav", "b.wav"], "audio_captions": CAPTIONS} | change
    return spark.createDataFrame([tuple({"unit_id": f"unit-{i}", "unit_index": i, **row}.values()) for i in range(n)], UNIT)


def claim(prompt, **change):
    target = json.loads(re.search(r"^\{.*\}$", prompt, re.M)[0])
    said = {"AUDIO_1": ["dog barks", "a dog barks loudly"], "AUDIO_2": ["rain falls", "the rain falls here"]}[target["evidence_sources"][0]]
    return json.dumps({"claim_text": said[1] + (" not" if target["claim_status"] == "CONTRADICTED" else ""), "claim_status": target["claim_status"], "evidence_sources": target["evidence_sources"], "supporting_caption_phrases": said[:1], "contradiction_basis": "it does so", "forbidden_inferences": [], "confidence": 0.9} | change)


QUESTION = json.dumps({"question": "Is it right that the dog and the rain are heard?", "claim_evaluation_explanation": "yes"})
VERDICT = {"verifier_status": "PASS", "validation_errors": [], "validation_notes": "", "corrected_claim_status": None, "corrected_evidence_sources": []}


def good(prompt):
    return claim(prompt) if prompt.startswith("CLAIM") else QUESTION if prompt.startswith("QA") else json.dumps(VERDICT)


def chain(script, **settings):
    return C.Chain(TEMPLATES, G.ScriptedGenerator(script), **settings)


def test_an_example_and_its_audit(spark):
    def script(prompt):
        return "<think>hm</think>" + good(prompt) if prompt.startswith("CLAIM") else good(prompt)

    out = C.run(units(spark), chain(script))
    example, audit = out.examples.first(), out.audit.first()
    assert out.examples.columns == S.EXAMPLE.fieldNames()
    assert example.claim_status == "SUPPORTED" and example.answer == ["supported", "AUDIO_1"] and example.audio_ids == ["a", "b"]
    assert audit.example_id.startswith("synthetic_") and audit.unit_id == "unit-0" and audit.visible_reasoning_stripped == [C.CLAIM]
    assert "hm" not in audit.raw_claim_text and json.loads(audit.raw_qa_text) == json.loads(QUESTION) and audit.verifier_record.verifier_status == "PASS"
    assert out.errors.isEmpty() and out.duplicates.isEmpty()
    row = out.stats.first()
    assert (row.candidate_generations_planned, row.examples_written, row.candidate_generations_completed) == (1, 1, 1)


def test_feedback_reaches_its_stage_alone_and_a_verdict_is_not_asked_twice(spark):
    def script(prompt):
        if prompt.startswith("CLAIM"):
            assert "QAAgent" not in prompt
            return claim(prompt) if "ClaimAgent attempt 1: status_differs" in prompt else claim(prompt, claim_status="CONTRADICTED" if "AUDIO_1" in prompt and "SUPPORTED" in prompt else "SUPPORTED")
        assert "ClaimAgent" not in prompt
        return json.dumps(VERDICT | {"verifier_status": "FAIL", "validation_errors": ["no"]}) if prompt.startswith("VERIFIER") and "None." in prompt else good(prompt)

    out = C.run(units(spark), chain(script))
    error = out.errors.first()
    assert out.examples.isEmpty() and (error.stage, error.unit_id, error.candidate_index, error.error_type) == (C.VERIFIER, "unit-0", 0, "InvalidAnswer")
    assert "rejected" in error.message and error.request_summary.message_count == 1 and error.http_status is None


def test_errors_stay_with_their_candidates_or_end_the_run(spark):
    class Down(RuntimeError):
        status, body = 503, '{"error":{"message":"it is down","code":503}}'

    def script(prompt):
        if prompt.startswith("CLAIM") and '"AUDIO_2"' in prompt:
            raise Down("down")
        return good(prompt)

    rows = units(spark, 2).unionByName(units(spark, audio_count=3).withColumn("unit_id", F.lit("odd")))
    out = C.run(rows, chain(script, each=4))
    errors = out.errors.collect()
    assert {(e.stage, e.error_type) for e in errors} == {("unit", "InvalidAnswer"), (C.CLAIM, "Down")}
    http = next(e for e in errors if e.stage == C.CLAIM)
    assert (http.http_status, http.retryable, http.error_detail) == (503, True, "message='it is down', code=503")
    stats = out.stats.first()
    assert stats.candidate_generations_planned == 12 == stats.candidate_generations_completed and stats.errors_written == len(errors) == 8
    assert out.examples.count() + out.duplicates.count() == 4
    with pytest.raises(C.GenerationFailed, match="Down"):
        C.run(units(spark, 1), chain(script, each=4, on_error="abort", concurrency=3))


def test_a_dry_run_calls_no_model(spark):
    def script(prompt):
        raise AssertionError

    row = C.dry_run(units(spark, 3), chain(script, each=2)).first()
    assert row.dry_run and row.candidate_generations_planned == 6 and row.errors_written == 0
    for bad in ({"each": 0}, {"threshold": 0.0}, {"on_error": "x"}):
        with pytest.raises(ValueError):
            chain(script, **bad)
    with pytest.raises(ValueError, match="places"):
        C.Chain(TEMPLATES | {C.QA: "{{audio_context}}"}, G.ScriptedGenerator(script))
    with pytest.raises(ValueError, match="template"):
        C.Chain({C.QA: ""}, G.ScriptedGenerator(script))


def test_reasoning_is_taken_off_let_pass_or_refused(spark):
    row = spark.createDataFrame([("<think>a</think>{}",), ("{}",)], "t string")
    said = lambda r: [tuple(x.c) for x in row.select(r.cleaned(F.col("t")).alias("c")).collect()]
    assert said(G.Reasoning()) == [("{}", True, None), ("{}", False, None)]
    assert said(G.Reasoning(reject=True)) == [("{}", True, "visible_reasoning"), ("{}", False, None)]
    assert said(G.Reasoning(strip=False)) == [("<think>a</think>{}", False, None), ("{}", False, None)]
    texts = {G.Reasoning(mode=m).prompt_text for m in G.MODES} | {G.Reasoning(enabled=False).prompt_text, G.Reasoning(instruction=" own ").prompt_text}
    assert "own" in texts and len(texts) == 5


def test_request_fields():
    assert G.Reasoning(enabled=False).request_fields() == {"include_reasoning": False, "reasoning_effort": "none"}
    assert G.Reasoning(token_budget=9, include=True).request_fields() == {"include_reasoning": True, "reasoning_effort": "medium", "thinking_token_budget": 9}
    assert G.Reasoning(enabled=False, mode="qwen3_vllm", token_budget=9).request_fields() == {"include_reasoning": False, "chat_template_kwargs": {"enable_thinking": False, "preserve_thinking": False}}
    for bad in ({"effort": "most"}, {"token_budget": 0}):
        with pytest.raises(ValueError):
            G.Reasoning(**bad)
    http = G.HttpGenerator("u", "m", reasoning=G.Reasoning(mode="qwen3_vllm"), extra={"reasoning_effort": "low", "model": "other", "chat_template_kwargs": {"enable_thinking": False}})
    sent = http.for_schema("claim", S.CLAIM_JSON).payload("hi")
    assert sent["reasoning_effort"] == "low" and sent["model"] == "other" and sent["chat_template_kwargs"] == {"enable_thinking": False, "preserve_thinking": False}
    assert "uniqueItems" not in json.dumps(sent["response_format"]) and sent["messages"][0]["content"] == "hi"


def test_a_chat_answer_gives_its_text(spark):
    """An HTTP generator's raw answer is a response body; its record comes from the message in it."""
    body = lambda text, reason="stop": json.dumps({"choices": [{"message": {"content": text}, "finish_reason": reason}], "usage": {"completion_tokens": 3}})

    class Local(G.HttpGenerator):
        def open(self):
            return lambda prompt: body(QUESTION) if prompt == "1" else body("{", "length") if prompt == "2" else body("no")

    rows = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    ok, failed = G.with_retries(rows, G.Stage("QA", lambda fb: F.col("i").cast("string"), S.QA_GENERATED_JSON, S.QA_GENERATED), Local("u", "m"))
    assert [(r.i, r.record.question) for r in ok.collect()] == [(1, json.loads(QUESTION)["question"])]
    assert {(r.i, r.problem) for r in failed.collect()} == {(2, "length_partial"), (3, "invalid_json")}
    shown = failed.withColumns({"unit_index": F.lit(1), "unit_id": F.lit("u"), "candidate_index": F.lit(0)})
    error = next(e for e in G.error_rows(shown, "QA").collect() if "length" in e.message)
    assert (error.finish_reason, error.completion_tokens, error.message_field_states["content"], error.request_summary.model) == ("length", 3, "nonempty", "m")


def test_a_final_example_needs_its_claim(spark):
    row = units(spark).withColumns({"claim": F.lit(None).cast(S.CLAIM), "qa": F.lit(None).cast(S.QA)})
    with pytest.raises(Exception, match="needs its claim"):
        G.final_examples(row).collect()


CONFIG = {"sampling": {"unit_count": 7, "audio_count": 3, "random_seed": 7, "max_audio_reuse": None, "subset_size": 0}, "similarity": {"similarity_min": 0.2}, "client": {"base_url": "http://h/v1", "model": "m", "api_key": "k", "timeout_s": 5}, "generation": {"default": {"temperature": 0.5, "top_p": 0.9}, "qa_agent": {"temperature": 0.1}, "reasoning": {"effort": " LOW "}}, "retry": {"max_attempts": 2}}


def test_configuration(tmp_path, monkeypatch):
    plan = config.unit_plan(CONFIG)
    assert (plan.count, plan.members, plan.seed, plan.reuse, plan.similar_from, plan.similar_to) == (7, 3, 7, None, 0.2, 1.0)
    over = config.overridden(CONFIG, {"sampling.unit_count": 25, "sampling.audio_count": None, "run.dry_run": True})
    assert config.unit_plan(over).count == 25 and config.get(over, "run.dry_run") is True and config.get(CONFIG, "run.dry_run", "none") == "none" and CONFIG["sampling"]["unit_count"] == 7
    assert config.with_value({"a": 1}, "a.b", 2) == {"a": {"b": 2}}
    monkeypatch.setenv("SOME_PLACE", "here")
    assert config.expanded({"x": ["${cwd}/a", 1], "y": "$SOME_PLACE"}, "/w") == {"x": ["/w/a", 1], "y": "$SOME_PLACE"}
    assert config.expanded("$SOME_PLACE/b", "/w", environment=True) == "here/b"
    assert config.redacted(CONFIG)["client"]["api_key"] == "<redacted>" and config.redacted({"client": {"api_key": "EMPTY"}})["client"]["api_key"] == "EMPTY"
    http = config.http_generator(CONFIG, "qa_agent", max_tokens=5)
    assert (http.url, http.temperature, http.top_p, http.max_tokens, http.retry.attempts, http.reasoning.effort) == ("http://h/v1/chat/completions", 0.1, 0.9, 5, 2, "low")
    (tmp_path / "c.json").write_text(json.dumps(CONFIG)), (tmp_path / "l.json").write_text("[1]")
    assert config.load(str(tmp_path / "c.json")) == CONFIG
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "l.json"))


def test_captions_end_at_the_first_stage(spark, monkeypatch):
    """What later stages write holds what a prompt shows of the captions, not all of them; the prompts are the same."""
    from siltstone.plans import catalogue

    seen, plain = [], G.put_aside
    monkeypatch.setattr(G, "put_aside", lambda df, name="table", *args, **options: seen.append((name, plain(df, name, *args, **options))) or seen[-1][1])
    catalogue._run_chain(spark, "/root/testdata/sf0.001")
    judged = [df for name, df in seen if name == "judged"]
    assert judged[0].where("audio_captions is not null").count() > 0
    assert judged[-1].count() > 0 and judged[-1].where("audio_captions is not null or audio_context is null").isEmpty()


def test_captions_are_joined_once(spark, monkeypatch):
    """A source's captions go through the first stage as one text, and what later prompts show of them is not empty."""
    from siltstone.plans import catalogue

    seen, plain = [], G.put_aside
    monkeypatch.setattr(G, "put_aside", lambda df, name="table", *args, **options: seen.append((name, plain(df, name, *args, **options))) or seen[-1][1])
    catalogue._run_chain(spark, "/root/testdata/sf0.001")
    judged = [df for name, df in seen if name == "judged"]
    assert judged[0].where("size(audio_captions[0]) > 1").isEmpty()
    shown = judged[-1].agg(F.count("*").alias("n"), F.count_if(F.col("audio_context").rlike(r"^AUDIO_1 captions:\n- \S") & ~F.col("audio_context").endswith("- none")).alias("full")).first()
    assert shown["n"] == shown["full"] > 0
