import json

import pytest
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import jsons as J
from siltstone.operators import generate as G


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "v string").select(f(F.col("v")).alias("out")).first().out


GOOD = ['{"a":1}', '{"a":\n [1, {"b": null}]}', '```json\n{"a": 1}\n```', '  {"a":"}"} ', "{}"]
BAD = ['{"a":1} xyz', '{"a":1}}', '{"a":1}]', '{"a":1,"w":2', '{{"a":1}', "{'a':1}", '{"a":01}', '{"a":1,}', "{a:1}", '{"a":"\t"}', '{"a":1}//c', "", "  ", None, "[1]", "1", '"x"', '{"v":1},"v":{"x":2}']


@pytest.mark.parametrize("text", GOOD)
def test_objects(spark, text):
    assert one(spark, text, J.parse_object).problem is None


@pytest.mark.parametrize("text", BAD)
def test_not_objects(spark, text):
    got = one(spark, text, J.parse_object)
    assert got.problem is not None and got.json is None


@pytest.mark.parametrize(
    ("text", "want", "removed"),
    [("<think>a{}</think>{\"x\":1}", '{"x":1}', True), ("so it is </think> {\"x\":1}", '{"x":1}', True), ("so it is </think> no json", "so it is </think> no json", False), (" <|think|> {\"x\":1}", '{"x":1}', True), ("plain", "plain", False), ("a</think>```json\n{}\n```", "```json\n{}\n```", True)],
)
def test_reasoning(spark, text, want, removed):
    got = one(spark, text, J.strip_reasoning)
    assert (got.text, got.removed) == (want, removed)


CLAIM = {"claim_text": "a b c", "claim_status": "SUPPORTED", "evidence_sources": ["AUDIO_1"], "supporting_caption_phrases": ["a"], "contradiction_basis": "", "forbidden_inferences": [], "confidence": 0.5}


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, None), ({"confidence": 1}, None), ({"confidence": 1.5}, "confidence:maximum"), ({"confidence": True}, "confidence:type"), ({"claim_text": ""}, "claim_text:minLength"), ({"claim_text": 5}, "claim_text:type"), ({"claim_status": "X"}, "claim_status:enum"), ({"evidence_sources": ["AUDIO_0"]}, "evidence_sources[]:pattern"), ({"evidence_sources": ["AUDIO_1", "AUDIO_1"]}, "evidence_sources:uniqueItems"), ({"evidence_sources": "AUDIO_1"}, "evidence_sources:type"), ({"extra": 1}, "unexpected"), ({"forbidden_inferences": [1]}, "forbidden_inferences[]:type"), ({"claim_text": None}, "claim_text:type")],
)
def test_claim_schema(spark, change, want):
    assert one(spark, json.dumps(CLAIM | change), lambda c: J.first_problem(J.schema_problems(c, S.CLAIM_JSON))) == want


def test_missing_field(spark):
    short = {k: v for k, v in CLAIM.items() if k != "confidence"}
    assert one(spark, json.dumps(short), lambda c: J.first_problem(J.schema_problems(c, S.CLAIM_JSON))) == "confidence:required"


def test_nullable_enum(spark):
    base = {"verifier_status": "PASS", "validation_errors": [], "validation_notes": "", "corrected_claim_status": None, "corrected_evidence_sources": []}
    check = lambda x: one(spark, json.dumps(base | x), lambda c: J.first_problem(J.schema_problems(c, S.VERIFIER_JSON)))
    assert check({}) is None and check({"corrected_claim_status": "SUPPORTED"}) is None
    assert check({"corrected_claim_status": "X"}) == "corrected_claim_status:enum"


def test_grammar_schema_drops_one_keyword():
    out = J.schema_for_grammar(S.CLAIM_JSON)
    assert "uniqueItems" not in json.dumps(out) and out["required"] == S.CLAIM_JSON["required"]


def response(message, reason="stop"):
    return json.dumps({"choices": [{"finish_reason": reason, "message": message}]})


@pytest.mark.parametrize(
    ("body", "text", "problem"),
    [(response({"content": "x"}), "x", None), (response({"content": "x"}, "length"), None, "length_partial"), (response({"content": ""}, "length"), None, "length_empty"), (response({"content": None, "reasoning": "why"}), None, "reasoning_only"), (response({"content": None, "reasoning": ' {"a":1} '}), '{"a":1}', None), (response({}), None, "no_content"), ('{"choices":[]}', None, "no_choices")],
)
def test_message(spark, body, text, problem):
    got = one(spark, body, lambda c: J.message_text(c, structured=True))
    assert (got.text, got.problem) == (text, problem)


def test_retry_policy():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise G.HttpFailure(503, "busy")
        return "done"

    policy = G.RetryPolicy(initial=0.0, jitter=0.0)
    assert policy.run(call, lambda e: e.retryable) == "done" and len(calls) == 3
    with pytest.raises(G.HttpFailure):
        policy.run(lambda: (_ for _ in ()).throw(G.HttpFailure(400, "bad")), lambda e: e.retryable)
    assert [G.RetryPolicy(jitter=0.0).delay(n) for n in (1, 2, 3, 9)] == [1.0, 2.0, 4.0, 30.0]


def test_an_answer_is_taken_apart_once(spark):
    """Each field of a response is read in one place, whatever is asked of it."""
    df = spark.range(1).select(J.message_text(F.lit("{}"), structured=True).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().count("get_json_object(") == 5
