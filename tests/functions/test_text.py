import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as X

IGNORED = set(X.GROUNDING_IGNORED)


def py_grounding(text):
    return [t for t in "".join(c.casefold() if c.isalnum() else " " for c in text).split() if t not in IGNORED]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_strip_takes_unicode_white_space(spark):
    values = ["  a  ", "\t\r\n", "", "b c", "\x1cx\x1f"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


#: Letters and signs on which Spark's lower case and case folding part.
ALPHABET = "abcXYZßẞſςΣµÉéİıſtﬁ09 ,.-'’_½²"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(ALPHABET, max_size=30), min_size=20, max_size=40))
def test_tokens_follow_case_folding(spark, texts):
    assert column(spark, texts, X.grounding_tokens) == [py_grounding(t) for t in texts]
    want = [" ".join("".join(c.casefold() if c.isalnum() else " " for c in t).split()) for t in texts]
    assert column(spark, texts, X.normalized) == want


def test_sharp_s(spark):
    assert column(spark, ["Straße GROẞ"], X.normalized) == ["strasse gross"]


def test_jaccard_of_empty_sets_is_zero(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, pytest.approx(1 / 3)]


@pytest.mark.parametrize(("caption", "phrase", "found"), [("A dog barks loudly", "dog barks", True), ("a dog, the barks", "dog barks", True), ("dogs bark", "dog", False), ("x", "", False), ("x", "the", False), ("one two", "one two three", False)])
def test_phrase(spark, caption, phrase, found):
    rows = spark.createDataFrame([(caption, phrase)], "c string, p string")
    assert rows.select(X.holds_phrase(F.col("c"), F.col("p"))).first()[0] is found


@pytest.mark.parametrize(("a", "b", "want"), [("rain", "raining", True), ("rai", "raining", False), ("raining", "rain", True), ("cat", "cat", True), ("door", "floor", False)])
def test_related(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(X.related(F.col("a"), F.col("b"))).first()[0] is want


def test_keywords_and_captions(spark):
    assert column(spark, ["a; b,c ;;", "a, b,,c", "", None], X.split_keywords) == [["a", "b,c"], ["a", "b", "c"], [], []]
    assert column(spark, [[" a", None, " ", "b "], None, []], X.nonblank, "array<string>") == [["a", "b"], [], []]


@pytest.mark.parametrize(("n", "limit", "offset"), [(5, 3, 4), (5, 3, 12), (2, 3, 1), (3, 3, 2), (0, 3, 7), (4, 0, 1)])
def test_window(spark, n, limit, offset):
    items = [f"c{i}" for i in range(n)]
    want = items if limit < 1 or n <= limit else [items[(offset + i) % n] for i in range(limit)]
    assert column(spark, [items], lambda c: X.rotating_window(c, limit, F.lit(offset)), "array<string>") == [want]


def test_labels_below_one(spark):
    assert column(spark, [0, 2], X.source_labels, "int") == [[], ["AUDIO_1", "AUDIO_2"]]


def test_feedback(spark):
    errors = [["QA attempt 1: a  b"], ["Claim attempt 1: x"], [], ["QA attempt 1: a", "QA attempt 2: " + "y" * 400, "QA attempt 3: z"], None]
    long = "QA attempt 2: " + "y" * 400
    assert column(spark, errors, lambda c: X.render_feedback(c, F.lit("QA")), "array<string>") == ["- QA attempt 1: a b", "None.", "None.", f"- {long[:357]}...\n- QA attempt 3: z", "None."]


def test_template(spark):
    assert column(spark, ["v"], lambda c: X.render_template("a {{x}} {{ x }}", x=c)) == ["a v v"]
    with pytest.raises(KeyError):
        X.render_template("{{y}}", x=F.lit(1))


def test_ids(spark):
    import hashlib

    ids = column(spark, [["b", "a"], ["a", "b"]], H.unit_id, "array<string>")
    assert ids[0] == ids[1] == "unit_" + hashlib.sha1(b"a::b").hexdigest()[:16]
    got = spark.range(1).select(H.example_id(F.lit("u"), F.lit(None).cast("string"), F.lit("q"))).first()[0]
    assert got == "synthetic_" + hashlib.sha1(b"u\n\nq").hexdigest()[:16]
    draws = [r[0] for r in spark.range(3000).select(H.seeded_index(1, 10, F.col("id"))).collect()]
    assert set(draws) == set(range(10)) and max(draws.count(i) for i in range(10)) < 300 + 6 * math.sqrt(300)


def test_caption_groups(spark):
    def plain(value):
        if not isinstance(value, list):
            return []
        return [[] if g is None else [t for x in (g if isinstance(g, list) else [g]) if (t := str(x).strip())] for g in value]

    cases = [[[" a ", "", "b"], None, " c ", "", ["\u00a0"], []], "text", None, {"a": 1}, [], [["x"]], [None], ["plain [not a list]", 5, [7, "y"]]]
    rows = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=False)) for i, c in enumerate(cases)] + [(99, None), (98, "no json")], "i int, t string")
    got = {r.i: r.g for r in rows.select("i", X.caption_groups(F.col("t")).alias("g")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)} | {99: [], 98: []}


def test_phrases_are_found_as_they_stand_or_folded(spark):
    """What stands letter by letter needs no folding; half a letter, a mark and the end of a quotation are no short cut."""
    cases = [
        (["a dog barks", "at cars"], "dog barks", True), (["a dog barks", "at cars"], "barks at", False), (["a dog barks"], "og barks", False), (["a dog barks"], "DOG  barks!", True), (["the a is"], "the", False),
        (["x\U0001d4b3y"], "y", False), (["\U0001f600y z"], "y", True), (["a \x01 b"], "a \x01 b", True), (["x", "y"], "x \x01 y", False), (["dog\\E cat"], "dog\\E cat", True), (["stra\u00dfe"], "STRASSE", True), (["dog(s) [run"], "dog(s) [run", True), (["dog"], "", False), (["dog"], "-", False),
    ]
    rows = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(cases)], "i int, c array<string>, p string")
    got = {r.i: (r.one, r.other) for r in rows.select("i", X.is_grounded(F.col("c"), F.col("p")).alias("one"), X.is_said(X.as_one(F.col("c")), F.col("p")).alias("other")).collect()}
    assert [got[i] for i in range(len(cases))] == [(held, held) for _, _, held in cases]
