import io
import hashlib
import json
import wave
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.operators import assemble as A
from siltstone.operators import dedup as D
from siltstone.operators import generate as G
from siltstone.operators import select as U
from siltstone.operators import validate as V
from siltstone.sources import files, promote, sinks
from siltstone.sources.scratch import put_aside
from siltstone.streaming.resume import commit_stream


def test_classified_misses_in_order(spark):
    clips = spark.createDataFrame([("a",), (" b ",), ("",), ("c",), (None,)], "file_name string")
    meta = spark.createDataFrame([("a", 1), ("c", 2)], "file_name string, m int")
    audio = spark.createDataFrame([("a", "p/a"), ("b", "p/b")], "file_name string, path string")
    got = {(r.file_name, r.error_type) for r in A.classify(clips, "file_name", meta, audio).collect()}
    assert got == {("a", None), (" b ", "metadata_missing"), ("", "missing_file_name"), ("c", "audio_missing"), (None, "missing_file_name")}


def test_last_and_first_win(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in A.last_wins(rows, F.col("k"), F.col("o")).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in A.first_wins(rows, F.col("k"), F.col("o")).collect()} == {("a", "x"), ("b", "z")}


@pytest.mark.parametrize(("path", "want"), [("a/b.WAV", ".wav"), ("a.b/c", ".wav"), ("x\\y.Flac", ".flac"), (".hidden", ".wav"), ("", ".wav")])
def test_suffix(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(A.suffix_of(F.col("p"))).first()[0] == want


def test_normalize_and_lean(spark):
    row = {"split": "dev", "file_name": " f.wav ", "keywords": "x;y", "sound_id": None, "path": "/d/f.wav", "duration_seconds": 1.23456789} | {c: None for c in S.CAPTION_COLUMNS} | {"caption_1": " one ", "caption_3": "two"}
    schema = "split string, file_name string, keywords string, sound_id string, path string, duration_seconds double, " + ", ".join(f"{c} string" for c in S.CAPTION_COLUMNS)
    got = A.normalize(spark.createDataFrame([row], schema), "set", "audio").first()
    assert got.captions == ["one", "two"] and got.caption_summary == "one two" and got.keywords == ["x", "y"] and got.duration_seconds == 1.234568
    assert got.audio_id.startswith("set_dev_") and got.audio_file_name == f"audio/dev/{got.audio_id}.wav"
    lean = A.lean(spark.createDataFrame([("i", None, "s")], "audio_id string, captions array<string>, split string")).first()
    assert lean.captions == [] and lean.audio_file_name == "audio/s/i.wav" and lean.duration_seconds is None


def test_ordinals_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = sorted((r.row_ordinal, r.k) for r in A.with_ordinal(rows, F.col("k")).collect())
    assert [o for o, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


@pytest.mark.parametrize(("adaptive", "coalesce"), [("true", "true"), ("true", "false"), ("false", "true")])
def test_wide_rows_keep_their_ordinals(spark, adaptive, coalesce):
    """Ordinals and all columns equal a sequential numbering, whichever columns are read and however Spark deals the rows."""
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.shuffle.partitions": "37"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wide = spark.range(4000).select((F.col("id") * 7919 % 8009).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"), F.array("id").alias("__at"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("row_number"))
        out = A.with_ordinal(wide.repartition(16), F.col("k"))
        want = [(i, *r) for i, r in enumerate(sorted((tuple(r) for r in wide.collect()), key=lambda r: r[0]))]
        assert out.columns == [*wide.columns, "row_ordinal"]
        assert sorted((r.row_ordinal, r.k, r.text, r["__at"], r.row_number) for r in out.collect()) == want
        assert sorted(r.row_ordinal for r in out.select("row_ordinal").collect()) == list(range(4000))
        assert U.row_slice(out, 100, 7).count() == 7 and out.groupBy("row_ordinal").count().where("count > 1").isEmpty()
        spread = spark.createDataFrame([(None, "x")] * 5 + [(1, "y")] * 5, "k int, t string")
        assert sorted((r.row_ordinal, r.k is None) for r in A.with_ordinal(spread, F.col("k")).collect()) == [(i, i < 5) for i in range(10)]
        assert A.with_ordinal(spread.limit(0), F.col("k")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whole_shuffle_keeps_all_columns(spark):
    rows = spark.createDataFrame([(i, "t" * i) for i in range(50)], "id int, text string")
    assert sorted((r.ord, r.id, r.text) for r in U.seeded_subset(rows, 0, 1, "id").collect()) == [(i, r.id, r.text) for i, r in enumerate(sorted(rows.collect(), key=lambda r: __import__("hashlib").sha1(f"1:{r.id}".encode()).hexdigest()))]


def test_few_pairs_are_compared(spark):
    """Large sets that share a rare token each, beside half of their frequent ones: sketches are full, and a shared first token alone sends no pair to be compared."""
    sets = [(i, [f"own{i}-{k}" for k in range(250)] + [f"rare{i // 2}"] + [f"some{k}" for k in range(700) if (k * 7919 + i * 104729) % 13 < 7]) for i in range(40)]
    sets += [(100, sets[0][1][30:] + ["x"]), (101, sets[0][1][20:] + ["y"])]
    rows = [(i, len(t), sorted({w for w in t if sum(w in u for _, u in sets) > 1})) for i, t in sets]
    order = {w: k for k, w in enumerate(sorted({w for _, _, x in rows for w in x}, key=lambda w: (sum(w in u for _, u in sets), w)))}
    placed = spark.createDataFrame([(i, n, sorted(order[w] for w in x)) for i, n, x in rows], "rep long, n int, x array<long>").withColumns({c: F.lit(0).cast("long") for c in U._ODD})
    got = {(r.a, r.b) for r in U.candidate_pairs(placed, 0.7).collect()}
    assert got == {(0, 100), (0, 101), (100, 101)}
    frame = spark.createDataFrame(sets, "id long, tokens array<string>")
    assert {(r.a, r.b) for r in U.similar_pairs(frame, 0.7).collect()} == got


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_against_brute_force(spark, threshold):
    rng = np.random.default_rng(7)
    base = [set(rng.choice(40, rng.integers(0, 12), replace=False).tolist()) for _ in range(60)]
    base += [set(b) for b in base[:12]] + [set(list(b)[1:]) | {99} for b in base[:20]]
    rows = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(base)], "id int, tokens array<string>")
    rep = [base.index(b) for b in base]
    assert {(r.id, r.rep) for r in U.token_classes(rows).collect()} == set(enumerate(rep))
    assert {(r.id, r.rep) for r in U.token_classes(spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (4, None)], "id int, tokens array<string>")).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}
    want = {(a, b) for a, b in combinations(sorted(set(rep)), 2) if base[a] and base[b] and len(base[a] & base[b]) / len(base[a] | base[b]) >= threshold}
    got = [(r.a, r.b) for r in U.similar_pairs(rows, threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def greedy(units, cap):
    used, out = {}, []
    for uid, _, members in sorted(units, key=lambda u: u[1]):
        if all(used.get(m, 0) < cap for m in members):
            out.append(uid)
            for m in members:
                used[m] = used.get(m, 0) + 1
    return set(out)


@pytest.mark.parametrize("cap", [1, 2])
def test_capped_units_equal_a_sequential_walk(spark, cap):
    rng = np.random.default_rng(cap)
    units = [(f"u{i}", i, [str(x) for x in rng.choice(14, 2, replace=False)]) for i in range(50)]
    got = U.capped_units(spark.createDataFrame(units, "unit_id string, priority int, members array<string>"), cap, put_aside)
    assert {r.unit_id for r in got.collect()} == greedy(units, cap)


def test_capped_units_with_a_member_in_a_third_of_all(spark):
    rng = np.random.default_rng(9)
    units = [(f"u{i:04}", int(rng.integers(50)), ["hot", f"m{rng.integers(400)}"] if i % 3 == 0 else [f"m{x}" for x in rng.choice(400, 2, replace=False)]) for i in range(900)]
    got = U.capped_units(spark.createDataFrame(units, "unit_id string, priority int, members array<string>"), 3, put_aside)
    assert {r.unit_id for r in got.collect()} == greedy([(u, (p, u), m) for u, p, m in units], 3)


def plain_walk(sets, k, seed, ok, count, cap=None):
    """Units in the order of the walk, as a plain loop over all choices makes them."""
    sha = lambda t: __import__("hashlib").sha1(t.encode()).hexdigest()
    place = {x: i for i, x in enumerate(sorted(sets, key=lambda x: (sha(f"{seed}:{x}"), x)))}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0.0
    found = []
    for c in combinations(sorted(sets, key=place.get), k):
        pairs = list(combinations(c, 2))
        if ok(sum(jaccard(*p) for p in pairs) / len(pairs)):
            uid = "unit_" + sha("::".join(sorted(c)))[:16]
            found.append((place[c[-1]] - place[c[0]], sha(f"{seed}:{uid}"), uid, c))
    found.sort()
    if cap:
        good = greedy([(f[2], f[:3], f[3]) for f in found], cap)
        found = [f for f in found if f[2] in good]
    return [(f[2], f[3]) for f in found[:count]]


@pytest.mark.parametrize(("k", "strategy", "join_from", "count", "cap"), [
    (2, "similar", 64, 15, None), (2, "similar", 0, 10_000, None), (2, "similar", 0, 10_000, 2), (2, "dissimilar", 64, 12, None), (2, "dissimilar", 64, 10_000, 3),
    (3, "similar", 64, 40, None), (3, "dissimilar", 64, 10_000, 1), (2, "random", 64, 30, None), (2, "random", 64, 10_000, None),
])
def test_units_come_in_the_order_of_the_walk(spark, monkeypatch, k, strategy, join_from, count, cap):
    """Rounds of a few candidates, also with the join for what is left; sets that are null, empty or copies of each other."""
    monkeypatch.setattr(U, "FIRST_ROUND", 20)
    monkeypatch.setattr(U, "JOIN_FROM", join_from)
    monkeypatch.setattr(U.UnitPlan, "attempts", lambda self, asked: 10**9)
    rng = np.random.default_rng(k)
    sets = {f"a{i}": set(map(str, rng.choice(25, rng.integers(1, 9), replace=False).tolist())) for i in range(22)}
    sets |= {f"c{i}": set(sets["a1"]) for i in range(6)} | {"e1": set(), "e2": set()}
    rows = spark.createDataFrame([(i, None if i == "e1" else sorted(v), i.upper()) for i, v in sets.items()], "audio_id string, tokens array<string>, name string")
    low = 0.5 if k == 2 else 0.3
    plan = U.UnitPlan(members=k, count=count, strategy=strategy, reuse=cap, most=1, beyond="walk", similar_from=low, dissimilar_to=0.1)
    units, _, stats = U.create_units(rows, plan, tokens="tokens", columns=("name",))
    ok = {"random": lambda j: True, "similar": lambda j: j >= low, "dissimilar": lambda j: j <= 0.1}[strategy]
    want = plain_walk(sets, k, 42, ok, count, cap)
    got = [(r.unit_id, tuple(r[f"m{i}"].audio_id for i in range(k))) for r in sorted(units.collect(), key=lambda r: (r.priority, r.unit_id))]
    assert got == want and want
    assert all(r.m0.name == r.m0.audio_id.upper() for r in units.collect())
    if count < 100 and strategy == "random":
        assert stats.first().candidate_units_considered < 200 < stats.first().possible_unordered_units


def test_a_seeded_order_is_one_over_all_choices(spark):
    """No pair is left out because its records lie far apart in the shuffle."""
    rows = spark.createDataFrame([(i, ["x", f"t{i % 3}"]) for i in range(60)], "id int, tokens array<string>")
    chosen, _, stats = U.create_units(rows, U.UnitPlan(members=2, count=20, strategy="similar", similar_from=0.9, order="seeded"), "id", "tokens")
    name = lambda a, b: "unit_" + hashlib.sha1("::".join(sorted([str(a), str(b)])).encode()).hexdigest()[:16]
    every = [name(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3]
    want = sorted(every, key=lambda u: (hashlib.sha1(f"42:{u}".encode()).hexdigest(), u))[:20]
    assert [r.unit_id for r in chosen.orderBy("priority", "unit_id").collect()] == want
    assert stats.first().candidate_units_considered == 60 * 59 // 2


@pytest.mark.parametrize("strategy", ["similar", "dissimilar"])
def test_a_walk_keeps_keys_and_as_many_units_as_asked(spark, monkeypatch, strategy):
    """Token sets are not carried from a walk's comparison into what it puts aside."""
    seen, plain = [], U.put_aside
    monkeypatch.setattr(U, "put_aside", lambda df, name="table", *args, **options: seen.append((name, plain(df, name, *args, **options))) or seen[-1][1])
    rows = spark.createDataFrame([(i, [f"t{i % 2}", f"u{i % 2}"]) for i in range(40)], "id int, tokens array<string>")
    chosen, _, _ = U.create_units(rows, U.UnitPlan(members=2, count=5, strategy=strategy), "id", "tokens")
    walked = [df for name, df in seen if name == "allowed-units"]
    assert walked and all(df.schema["m0"].dataType.fieldNames() == ["ord", "id"] and df.count() <= 5 for df in walked)
    assert chosen.count() == 5 and all(r.m1.tokens == [f"t{r.m1.id % 2}", f"u{r.m1.id % 2}"] for r in chosen.collect())


def test_pairs_are_ruled_out_inside_the_join(spark):
    """Of many sets that share one rare token and little else, none leaves the join to be compared."""
    rows = spark.createDataFrame([(i, ["rare", *(f"t{i}-{j}" for j in range(20))]) for i in range(30)], "id int, tokens array<string>")
    joins = U.similar_pairs(rows, 0.5)
    assert "bit_count" in joins._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count() == 0


def test_plan_choice():
    assert U.choose_plan(10, 2, "similar", 100) == "walk" and U.choose_plan(1000, 2, "random", 100) == "sample"
    for bad in ((1000, 2, "similar", 100), (1, 2, "random", 100), (5, 0, "random", 100)):
        with pytest.raises(ValueError):
            U.choose_plan(*bad)
    for wrong in ({"members": 0}, {"strategy": "best"}, {"similar_from": 0.9, "similar_to": 0.1}, {"reuse": 0}):
        with pytest.raises(ValueError):
            U.UnitPlan(**wrong)


@pytest.mark.parametrize(("n", "k"), [(0, 2), (2, 3), (5, 1), (7, 3)])
def test_combinations_are_all_choices(spark, n, k):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(n)], "ord int, id string")
    got = [tuple(r[f"m{i}"].id for i in range(k)) for r in U.combinations(rows, n, k, ["id"]).collect()]
    assert sorted(got) == [tuple(f"r{i}" for i in c) for c in combinations(range(n), k)]


@pytest.mark.parametrize(("reuse", "most", "strategy"), [(None, 1000, "similar"), (1, 1000, "dissimilar"), (1, 1, "random"), (None, 1, "similar")])
def test_units_hold_their_plan(spark, reuse, most, strategy):
    rng = np.random.default_rng(3)
    sets = {f"a{i}": set(rng.choice(9, rng.integers(1, 6), replace=False).tolist()) for i in range(12)}
    rows = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()], "audio_id string, tokens array<string>")
    plan = U.UnitPlan(count=500, strategy=strategy, reuse=reuse, most=most, beyond="walk", similar_from=0.3, dissimilar_to=0.2)
    units, short, stats = U.create_units(rows, plan, tokens="tokens")
    got = [tuple(r.members) for r in units.collect()]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ok = {"random": lambda j: True, "similar": lambda j: j >= 0.3, "dissimilar": lambda j: j <= 0.2}[strategy]
    allowed = {frozenset(p) for p in combinations(sets, 2) if ok(alike(*p))}
    made = {frozenset(p) for p in got}
    assert len(made) == len(got) and made <= allowed
    used = [m for p in got for m in p]
    if reuse is None:
        assert made == allowed
    else:
        assert max(used.count(m) for m in used) == 1 and not [p for p in allowed if not p & set(used)]
    assert {r.error_type for r in short.collect()} == {"unit_count_exceeds_possible", "unit_count_not_satisfied"}
    row = stats.first()
    assert row.units_generated == len(got) and row.distinct_members_used == len(set(used)) and row.possible_unordered_units == 66
    if strategy != "random" and most == 1:
        with pytest.raises(ValueError):
            U.create_units(rows, U.UnitPlan(strategy=strategy, most=1), tokens="tokens")


@pytest.mark.parametrize("name", ["raw", "request", "text", "problem"])
def test_names_that_are_added_are_taken(spark, name):
    from siltstone import schemas as S
    from siltstone.operators import dedup as D
    from siltstone.operators import generate as G

    stage = G.Stage("QA", lambda said: said, S.QA_GENERATED_JSON, S.QA_GENERATED)
    with pytest.raises(ValueError, match=name):
        G.with_retries(spark.createDataFrame([(1, "x")], f"id int, {name} string"), stage, G.ScriptedGenerator(str))
    with pytest.raises(ValueError, match="kept"):
        D.keep_distinct_exact(spark.createDataFrame([(1, 1, "c", "q", True)], "u int, o int, c string, q string, kept boolean"), "u", "o", "c", "q")


def test_shortfall_and_slices(spark):
    assert [r.error_type for r in U.shortfall(spark, 10, 5, 4).collect()] == ["unit_count_exceeds_possible", "unit_count_not_satisfied"]
    assert U.shortfall(spark, 2, 5, 2).count() == 0
    rows = spark.range(10).withColumnRenamed("id", "row_ordinal")
    assert U.row_slice(rows, 20, 3).count() == 0 and U.row_slice(rows, 8, None).count() == 2
    with pytest.raises(ValueError):
        U.batch_of(F.lit(1), 0)


def test_conditions_cycle(spark):
    rows = U.fan_out(spark.createDataFrame([(5,), (6,)], "unit_index int"), 2)
    got = [(r.condition_index, r.c.condition_name) for r in rows.withColumn("c", U.choose_condition(F.lit(2), F.col("condition_index"))).orderBy("condition_index").collect()]
    assert [i for i, _ in got] == [10, 11, 12, 13]
    assert [n for _, n in got] == ["supported_by_AUDIO_2", "contradicted_by_AUDIO_2", "supported_by_AUDIO_1", "contradicted_by_AUDIO_1"]


UNIT = (2, [["a dog barks at a car"], ["rain falls"]])


@pytest.mark.parametrize(
    ("change", "target", "want"),
    [
        ({}, "SUPPORTED", None), ({}, "CONTRADICTED", "status_differs"), ({"evidence_sources": ["AUDIO_3"]}, "SUPPORTED", "unknown_source"), ({"evidence_sources": ["AUDIO_2"]}, "SUPPORTED", "sources_differ"),
        ({"claim_text": "dog barks"}, "SUPPORTED", "claim_too_short"), ({"supporting_caption_phrases": []}, "SUPPORTED", "no_phrases"), ({"supporting_caption_phrases": ["cat"]}, "SUPPORTED", "not_grounded"),
        ({"claim_status": "CONTRADICTED"}, "CONTRADICTED", "no_basis"), ({"claim_status": "CONTRADICTED", "contradiction_basis": "It is Not Mentioned"}, "CONTRADICTED", "basis_is_absence"), ({"claim_status": "CONTRADICTED", "contradiction_basis": "it barks"}, "CONTRADICTED", None),
    ],
)
def test_claims(spark, change, target, want):
    claim = {"claim_text": "the dog barks loudly", "claim_status": "SUPPORTED", "evidence_sources": ["AUDIO_1"], "supporting_caption_phrases": ["dog barks"], "contradiction_basis": "", "forbidden_inferences": [], "confidence": 1.0} | change
    row = (*UNIT, {"condition_name": "", "claim_status": target, "evidence_sources": change.get("evidence_sources", ["AUDIO_1"]) if want == "unknown_source" else ["AUDIO_1"], "instruction": ""}, claim)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("audio_count", T.IntegerType()), T.StructField("captions", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("target", S.CONDITION), T.StructField("claim", S.CLAIM)])
    rules = V.claim_rules(F.col("claim"), F.col("target"), F.col("captions"), F.col("audio_count"))
    assert V.verdict(spark.createDataFrame([row], schema), rules).first().problem == want


def test_unit_rules(spark):
    rows = spark.createDataFrame([(2, ["a", "b"], ["x", "y"], [["c"], []], None), (0, [], [], [], None), (1, ["a"], ["x", "y"], [["c"]], None), (1, ["a"], ["x"], None, ["p"])], "audio_count int, audio_ids array<string>, audio_file_names array<string>, audio_captions array<array<string>>, local_audio_paths array<string>")
    assert [r.problem for r in V.verdict(rows, V.unit_rules()).collect()] == [None, "audio_count", "audio_file_names:length", "audio_captions:missing"]
    with pytest.raises(V.ValidationFailed):
        V.require(rows, ["audio_ids"], V.unit_rules())
    with pytest.raises(V.ValidationFailed):
        V.require(rows.limit(0), ["audio_ids"])
    with pytest.raises(V.ValidationFailed):
        V.strict(rows)


def test_near_dedup_keeps_the_first_and_contrasts(spark):
    rows = [(1, 0, "a dog barks", "is it so?", "S"), (1, 1, "A dog, barks!", "Is it so?", "C"), (1, 2, "a dog barks", "is it so then?", "C"), (1, 3, "a dog barked", "is it so?", "S"), (2, 0, "a dog barks", "is it so?", "S"), (None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "unit int, n int, claim string, question string, sig string")
    got = {(r.unit, r.n): r.kept for r in D.keep_distinct(df, "unit", "n", "claim", "question", F.col("sig"), 0.9).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): False, (2, 0): True, (None, 1): True}
    assert D.ratio("", "a") == 0.0 and D.ratio("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio()
    with pytest.raises(ValueError):
        D.keep_distinct(df, "unit", "n", "claim", "question", F.col("sig"), 0.0)


def walked(rows, threshold):
    """Which rows a walk in order keeps; rows: unit, ordinal, claim, question, signature."""
    kept, out = {}, []
    for unit, _, *x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        new = tuple(v or "" for v in x)
        seen = kept.setdefault(unit, [])
        out.append((unit, _, *x, not any(D.similar(new, k, threshold) for k in seen)))
        if out[-1][-1]:
            seen.append(new)
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9])
def test_near_dedup_equals_a_walk(spark, threshold):
    """Every row once, with a walk's verdict: short and empty texts, equal texts under other signatures, null units, rows twice."""
    rng = np.random.default_rng(int(threshold * 100))
    words = ["a", "bb", "dog", "dogs", "barks", "loudly", "rain", "x"]
    rows = []
    for n in range(90):
        claim = " ".join(rng.choice(words, rng.integers(0, 5)))
        rows.append((None if n % 11 == 0 else int(rng.integers(0, 3)), n, claim, str(rng.choice(["q", "q q", ""])), str(rng.choice(["S", "C"]))))
    df = spark.createDataFrame([*rows, (9, None, None, None, None), (9, None, "", "", ""), (9, 5, "z", None, "S")], "unit int, n int, claim string, question string, sig string").repartition(5)
    got = D.keep_distinct(df, "unit", "n", "claim", "question", F.col("sig"), threshold).collect()
    assert len(got) == 93
    assert sorted(map(str, ((r.unit, r.n, r.claim, r.question, r.sig, r.kept) for r in got if r.unit != 9))) == sorted(map(str, walked(rows, threshold)))
    assert sorted(r.kept for r in got if r.unit == 9) == [False, True, True]


@pytest.mark.parametrize(("pairwise", "part"), [(2048, 64), (2048, 7), (40, 7), (1, 1)])
def test_near_dedup_of_large_units_equals_a_walk(spark, monkeypatch, pairwise, part):
    """Pairs come by units, in parts, up to a number of candidates, and by runs of characters beyond it; only then are runs written."""
    monkeypatch.setattr(D, "PAIRWISE", pairwise)
    monkeypatch.setattr(D, "PART", part)
    rng = np.random.default_rng(7)
    words = ["dog", "dogs", "barks", "loudly", "rain", "falls", "on", "the", "roof", "x", "\U0001f415"]
    rows = [(None if n % 5 == 0 else n % 2, n, " ".join(rng.choice(words, rng.integers(3, 9))), str(rng.choice(["q", "is it"])), str(rng.choice(["S", "C"], p=[0.8, 0.2]))) for n in range(240)]
    rows += [(u, n + 240, claim.replace("the", "teh"), q, sig) for u, n, claim, q, sig in rows[::6]]
    df = spark.createDataFrame(rows, "unit int, n int, claim string, question string, sig string").repartition(5)
    written, put_aside = [], D.put_aside
    monkeypatch.setattr(D, "put_aside", lambda df, name="table", *a: written.append(name) or put_aside(df, name, *a))
    got = D.keep_distinct(df, "unit", "n", "claim", "question", F.col("sig"), 0.9).collect()
    folded = [(u, n, c.replace("\U0001f415", "").split(), q, sig) for u, n, c, q, sig in rows]  # what is no letter and no digit goes
    want = {n: kept for _, n, *_, kept in walked([(u, n, " ".join(c), q, sig) for u, n, c, q, sig in folded], 0.9)}
    assert {r.n: r.kept for r in got} == want and 40 <= sum(not k for k in want.values()) < 200
    assert ("runs" in written) == (pairwise < 2048)


def test_common_subsequences_bound_the_ratio(monkeypatch):
    """Texts of one vocabulary that are not alike are told apart without the slow ratio; those that are alike are not."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 100)) for _ in range(6)]
    for a in texts:
        near = a[:200] + a[215:]
        assert D.close(a, "q", near, "q", 0.9) and D.close(near, "q", a, "q", 0.9)
        assert D.longest_common(a, near) == len(near)
    for a, b in [("abcde", "ace"), ("", "a"), ("a", ""), ("ab" * 40, "ba" * 40), ("\U0001f415x", "x\U0001f415"), ("xa", "ay")]:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a):
            for j, d in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        assert D.longest_common(a, b) == table[-1][-1]
        assert D.longest_common(a, b) >= sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: pytest.fail("the slow ratio of texts that are not alike"))
    assert not any(D.close(a, "q", b, "q", 0.9) for a in texts for b in texts if a is not b)


def test_exact_dedup_of_candidates_takes_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 4, "a", "q"), (1, 4, "A!", "q"), (1, None, "a", "q"), (None, None, "a", "q"), (1, 5, "b", None), (None, 2, "a", "q")], "unit int, n int, claim string, question string")
    got = D.keep_distinct_exact(df, "unit", "n", "claim", "question").collect()
    assert sorted((str(r.unit), str(r.n), r.kept) for r in got if r.claim != "A!" and r.n != 4) == [("1", "5", True), ("1", "None", False), ("None", "2", True), ("None", "None", False)]
    assert len(got) == 6 and sum(r.kept for r in got if r.n == 4) == 1


def test_retries_reach_only_open_rows_of_their_stage(spark):
    seen = "Errors: {{e}}\nrow {{i}}"
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "i int")

    def script(prompt):
        i = int(prompt.rsplit(" ", 1)[1] or 1)
        if i == 3:
            raise RuntimeError("down")
        return json.dumps({"question": "q", "claim_evaluation_explanation": "None." if "None." in prompt else "told"}) if i == 1 or "QA attempt 1: invalid_json" in prompt else "no"

    from siltstone.functions import text as X

    stage = G.Stage("QA", lambda fb: X.render_template(seen, e=fb, i=F.col("i")), S.QA_GENERATED_JSON, S.QA_GENERATED)
    ok, failed = G.with_retries(rows, stage, G.ScriptedGenerator(script))
    good = sorted((str(r.i), r.attempt, r.record.claim_evaluation_explanation) for r in ok.collect())
    assert good == [("1", 1, "None."), ("2", 2, "told"), ("2", 2, "told"), ("None", 1, "None.")]
    bad = failed.collect()
    assert [r.i for r in bad] == [3] and len(bad[0].errors) == 2 and "RuntimeError: down" in bad[0].errors[0]


def test_csv_encodings_and_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿file_name,x\n a , é\nb\n".encode())
    (tmp_path / "b.csv").write_bytes("file_name,x\nc,café\u0099\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"file_name,x\nd,\x81\xe9,surplus\n")
    got = {(r.file_name, r.x) for r in files.read_csv(spark, str(tmp_path), ("file_name", "x")).collect()}
    assert got == {("a", "é"), ("b", ""), ("c", "café™"), ("d", "\x81é")}
    (tmp_path / "d.csv").write_bytes(b"other\n1\n")
    with pytest.raises(Exception, match="missing required columns"):
        files.read_csv(spark, str(tmp_path / "d.csv"), ("file_name",)).collect()
    (tmp_path / "e.csv").write_bytes(b"file_name\n")
    with pytest.raises(Exception, match="is empty"):
        files.read_csv(spark, str(tmp_path / "e.csv"), ("file_name",)).collect()


def test_csv_records_are_put_together_where_they_are_read(spark, tmp_path, monkeypatch):
    """Of records over many lines only those that go on in another task's lines are joined, and no row is sorted to meet its file's encoding and head."""
    tables, aside = {}, files.put_aside
    monkeypatch.setattr(files, "put_aside", lambda df, name, *a: tables.setdefault(name, aside(df, name, *a)))
    (tmp_path / "a.csv").write_text("id,x\n" + "".join(f'{i},"one\ntwo, {i}\n\nthree"\n' for i in range(500)))
    (tmp_path / "b.csv").write_text('id,x\n7,"never\nclosed')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_csv(spark, str(tmp_path), ("id", "x"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.ordinal, r.id, r.x) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([(2 + 4 * i, str(i), f"one\ntwo, {i}\n\nthree") for i in range(500)] + [(2, "7", "never\nclosed")])
    assert "SortMergeJoin" not in plan
    assert 0 < tables["csv-pieces"].where("not (opened and closed)").count() <= 60  # of 2,000 lines


@pytest.mark.parametrize("seed", range(3))
def test_csv_in_splits_equals_a_reader_of_whole_files(spark, tmp_path, seed):
    """Quoted fields over lines and splits, quotes inside plain fields, all encodings with one late odd byte, blank lines, both kinds of line ends."""
    import csv
    import random

    rng, want = random.Random(seed), set()
    for name, encoding in (("a", "utf-8-sig"), ("b", "utf-8"), ("c", "cp1252"), ("d", "latin-1")):
        end = rng.choice(["\n", "\r\n"])
        field = lambda: rng.choice(["x", "", " pad ", "a,b", 'say ""hi""', f"two{end}lines", f"{end}{end}three, ", "plain" * rng.randrange(8), "é" if name != "a" else "漢é"])
        rows = [",".join([f"{name}{i}", f'5" {i}' if rng.random() < 0.1 else f'"{field()}"' if rng.random() < 0.6 else rng.choice(["p", "q r", ""])]) for i in range(150)]
        rows = [r for x in rows for r in ([x, ""] if rng.random() < 0.05 else [x])]
        data = (end.join(["file_name,x", *rows, f"{name}-last,é"]) + end).encode(encoding)
        (tmp_path / f"{name}.csv").write_bytes(data + {"c": b"z,\x80\n", "d": b"z,\x81\n"}.get(name, b""))
        data = (tmp_path / f"{name}.csv").read_bytes()
        want |= {(r["file_name"].strip(), (r["x"] or "").strip()) for r in csv.DictReader(io.StringIO(data.decode(encoding if name != "c" else "cp1252"), newline=""))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.read_csv(spark, str(tmp_path), ("file_name", "x")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file_name, r.x) for r in rows} == want and len(rows) == len(want)
    for name in "abcd":
        own = [r.file_name for r in sorted((r for r in rows if r.path.endswith(f"{name}.csv")), key=lambda r: r.ordinal)]
        assert own == sorted((x for x in own if x[1:].isdigit()), key=lambda x: int(x[1:])) + [f"{name}-last"] + (["z"] if name in "cd" else [])


def test_audio_and_discovery(spark, tmp_path):
    for at, seconds in (("x/a.wav", 0.5), ("y/a.wav", 1.0), ("y/b.wav", None)):
        (tmp_path / at).parent.mkdir(exist_ok=True)
        data = io.BytesIO()
        if seconds:
            with wave.open(data, "wb") as w:
                w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
                w.writeframes(bytes(int(8000 * seconds)))
        (tmp_path / at).write_bytes(data.getvalue() or b"no audio")
    index = {r.file_name: r.path for r in files.audio_index(spark, str(tmp_path)).collect()}
    assert index["a.wav"].endswith("x/a.wav") and set(index) == {"a.wav", "b.wav"}
    assert sorted((r.path[-7:], r.duration_seconds) for r in files.audio_durations(spark, str(tmp_path)).collect()) == [("x/a.wav", 0.5), ("y/a.wav", 1.0), ("y/b.wav", None)]
    assert files.find_file(spark, str(tmp_path), ["none.wav", "b.wav"]).endswith("y/b.wav") and files.find_file(spark, str(tmp_path), ["z"]) is None


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, ["é"])], "z string, a int, l array<string>")
    sinks.write_jsonl(rows, str(tmp_path / "o"))
    line = "".join(p.read_text() for p in (tmp_path / "o").glob("part*")).strip()
    assert line == '{"a":null,"l":["é"],"z":"b"}'
    (tmp_path / "i.jsonl").write_text('{"a":1}\n\n{"a":2} x\n')
    bad = files.bad_json_lines(spark, str(tmp_path / "i.jsonl")).collect()
    assert [(r.line, r.text) for r in bad] == [(3, '{"a":2} x')]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.txt", S.MANIFEST)


def test_line_numbers_over_several_splits(spark, tmp_path):
    """Files of many splits of 2,000 bytes and one packed with others; every seventh line is bad, some are blank."""
    lines = {f"f{k}.jsonl": ["" if i % 5 == 4 else f'{{"a": {i}}}' + (" x" if i % 7 == 3 else " " * (i % 90)) for i in range(n)] for k, n in enumerate((400, 3, 90))}
    for name, own in lines.items():
        (tmp_path / name).write_bytes(("\r\n" if name == "f2.jsonl" else "\n").join(own).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r.path.rpartition("/")[2], r.line, r.text) for r in files.bad_json_lines(spark, str(tmp_path)).collect()}
        every = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert every.count() == sum(len(own) - (not own[-1]) for own in lines.values())  # an empty line at the end of a file is none
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i + 1, t) for name, own in lines.items() for i, t in enumerate(own) if t.endswith("x")}


def in_order(spark, path):
    """Rows in the order of the files' names and of the rows in them."""
    rows = spark.read.parquet(path)
    return [tuple(r)[:-2] for r in rows.select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]


def test_guard_batches_and_finalize(spark, tmp_path):
    old, new = S.ddl("id long, tags array<string>"), S.ddl("id long, tags array<string>, note string")
    writer = sinks.BatchWriter(spark, str(tmp_path / "batches"))
    assert writer.commit(1, spark.createDataFrame([(3, ["x"], "n")], new), new)
    assert writer.commit(0, spark.createDataFrame([(1, []), (2, [])], old), old)
    assert not writer.commit(0, spark.createDataFrame([(9, [])], old), old)
    assert writer.batches() == [0, 1]
    assert [r.id for r in writer.review(new, ["id"], 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        writer.review(new, ["id"], -1)
    writer.finalize(str(tmp_path / "all"), new)
    assert in_order(spark, str(tmp_path / "all")) == [(1, [], None), (2, [], None), (3, ["x"], "n")]
    assert writer.batches() == []
    with pytest.raises(FileExistsError):
        sinks.guard(spark, [str(tmp_path / "all")])
    sinks.guard(spark, [str(tmp_path / "all")], overwrite=True)
    assert not sinks.exists(spark, str(tmp_path / "all"))
    log = sinks.EventLog(spark, str(tmp_path / "log"), "run")
    log.add("start", a=1), log.add("end")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_document(spark, {"a": "é"}, str(tmp_path / "doc.json"))
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": "é"}


def test_commits_of_all_batches(spark, tmp_path):
    schema = S.ddl("id long, tags array<string>")
    writer = sinks.BatchWriter(spark, str(tmp_path / "batches"))
    rows = spark.createDataFrame([(i, [str(i)]) for i in (-5, 0, 3, 7, 8, 8)] + [(None, [])], schema)
    assert len(writer.commit_all(rows, F.floor(F.col("id") / 4), schema)) == 5
    assert writer.commit_all(rows, F.floor(F.col("id") / 4), schema) == []
    assert len(writer.commit_all(rows.unionByName(spark.createDataFrame([(99, [])], schema)), F.floor(F.col("id") / 4), schema)) == 1
    assert writer.batches() == [-2, 0, 1, 2, 24] and writer.read(schema).count() == 8
    target = str(tmp_path / "all")
    writer.finalize(target, schema, keep=True)
    assert [r[0] for r in in_order(spark, target)] == [None, -5, 0, 3, 7, 8, 8, 99]
    with pytest.raises(FileExistsError):
        writer.finalize(target, schema)
    assert writer.read(schema).count() == 8 and not sinks.exists(spark, target + "._staged")


@pytest.mark.parametrize("keep", [False, True])
def test_batches_whose_schema_grows(spark, tmp_path, keep):
    """Columns that come later, wider numbers, lists without a type, structs with more fields; files keep the order of the commits."""
    writer = sinks.BatchWriter(spark, str(tmp_path / "batches"))
    empty = spark.sql("select * from values (1, array(), null, named_struct('x', 1)), (2, null, null, null) t(id, tags, late, s)")
    assert writer.commit(10, empty)
    assert writer.commit(2, spark.createDataFrame([(9, ["a"], (1, "y"), 5)], "id long, tags array<string>, s struct<x:int,y:string>, more int"))
    assert writer.commit(11, spark.createDataFrame([(0.5, None, "z", None, 7)], "id double, tags array<string>, late string, s struct<x:int>, more long"))
    assert writer.commit_all(spark.createDataFrame([(i, 40 - i % 3) for i in range(30)], "id int, b long"), F.col("b"), order=["id"])
    target = str(tmp_path / "all")
    schema = writer.finalize(target, keep=keep)
    assert schema.simpleString() == "struct<id:double,tags:array<string>,s:struct<x:int,y:string>,more:bigint,late:string,b:bigint>"
    rows = [(*r[:2], r[2] and tuple(r[2]), *r[3:]) for r in in_order(spark, target)]
    assert rows[:4] == [(9.0, ["a"], (1, "y"), 5, None, None), (1.0, [], (1, None), None, None, None), (2.0, None, None, None, None, None), (0.5, None, None, 7, "z", None)]
    assert [(r[0], r[5]) for r in rows[4:]] == [(float(i), b) for b in (38, 39, 40) for i in range(30) if 40 - i % 3 == b]
    assert writer.batches() == ([2, 10, 11, 38, 39, 40] if keep else [])
    other = sinks.BatchWriter(spark, str(tmp_path / "others"))
    other.commit(0, spark.createDataFrame([(1,)], "id long")), other.commit(1, spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(promote.SchemaConflict, match="id"):
        other.finalize(str(tmp_path / "whole"))
    assert other.batches() == [0, 1]


def test_finalize_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    writer, target = sinks.BatchWriter(spark, str(tmp_path / "batches")), str(tmp_path / "all")
    for b in range(4):
        writer.commit(b, spark.createDataFrame([(b, i) for i in range(3)], "b long, i int" if b < 3 else "b long, i long"))
    times, plain = [], promote.promoted

    def stops(*args):
        times.append(1)
        if len(times) == 2:
            raise OSError("stopped")
        return plain(*args)

    monkeypatch.setattr(promote, "promoted", stops)
    with pytest.raises(OSError):
        writer.finalize(target)
    assert not sinks.exists(spark, target)
    writer.finalize(target)
    assert in_order(spark, target) == [(b, i) for b in range(4) for i in range(3)]


def test_finalize_sorts_nothing(spark, tmp_path):
    """No job reads files that have the table's schema."""
    writer, target = sinks.BatchWriter(spark, str(tmp_path / "batches")), str(tmp_path / "all")
    writer.commit_all(spark.range(1_000).select(F.col("id"), (F.col("id") % 7).alias("x")), F.col("x"), order=["id"])
    before = {n for b in writer.batches() for n in writer._files(writer.path(b))}
    writer.finalize(target)
    assert all(any(n.endswith(b) for b in before) for n in writer._files(target))
    assert in_order(spark, target) == [(i, x) for x in range(7) for i in range(1_000) if i % 7 == x]


def test_finalize_reads_a_footer_a_write(spark, tmp_path, monkeypatch):
    writer, target = sinks.BatchWriter(spark, str(tmp_path / "batches")), str(tmp_path / "all")
    writer.commit_all(spark.range(400).select(F.col("id"), (F.col("id") % 40).alias("x")), F.col("x"), order=["id"])
    writer.commit(40, spark.createDataFrame([(1, 40, "n")], "id long, x long, note string"))
    read, plain = [], promote.as_written
    monkeypatch.setattr(promote, "as_written", lambda s: read.append(s) or plain(s))
    assert [f.name for f in writer.schema().fields] == ["id", "x", "note"]
    assert len({id(s) for s in read}) == 2
    monkeypatch.undo()
    writer.finalize(target)
    assert in_order(spark, target) == [(i, x, None) for x in range(40) for i in range(400) if i % 40 == x] + [(1, 40, "n")]


def test_event_log_errors_and_stats(spark, tmp_path):
    log = sinks.EventLog(spark, str(tmp_path / "log"), "run")
    log.error("claim", ValueError("bad"), unit="u1")
    row = spark.read.json(str(tmp_path / "log")).first()
    assert (row.stage, row.error_type, row.message, json.loads(row.payload)) == ("claim", "ValueError", "bad", {"unit": "u1"})
    log.stats(str(tmp_path / "stats.json"), examples=1), log.stats(str(tmp_path / "stats.json"), examples=2)
    assert json.loads((tmp_path / "stats.json").read_text())["examples"] == 2


def test_totals_and_splits(spark):
    a, b = spark.createDataFrame([("x", 1)], "file_name string, n int"), spark.createDataFrame([("y",), (None,)], "file_name string")
    whole = A.append_splits({"dev": a, "val": b})
    assert sorted(map(str, ((r.split, r.file_name, r.n) for r in whole.collect()))) == sorted(map(str, [("dev", "x", 1), ("val", "y", None), ("val", None, None)]))
    with pytest.raises(ValueError):
        A.append_splits({})
    row = A.run_totals(whole, whole, a, b.limit(0)).first()
    assert (row.split_names, row.total_records_written, row.total_provenance_records_written, row.total_errors) == (["dev", "val"], 3, 1, 0)
    assert A.audio_of_split(a.limit(0), b).count() == 2 and A.audio_of_split(a, b).count() == 1
    paths = spark.createDataFrame([(["a", "", None],), (None,), ([],)], "local_audio_paths array<string>")
    assert U.missing_paths(paths).first()[0] == 2
    assert {(r.member, r.units) for r in U.member_reuse(spark.createDataFrame([(["a", "b"],), (["a"],)], "members array<string>")).collect()} == {("a", 2), ("b", 1)}


def test_stream_resumes(spark, tmp_path):
    schema = S.ddl("id long")
    for part in (0, 1):
        spark.range(part * 10, part * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        commit_stream(stream, sinks.BatchWriter(spark, str(tmp_path / "out")), schema, str(tmp_path / "cp"))
    assert sorted(r.id for r in sinks.BatchWriter(spark, str(tmp_path / "out")).read(schema).collect()) == list(range(20))
