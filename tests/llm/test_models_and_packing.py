"""Token files and packing as exact round trips; toxicity and quality by held-out accuracy; odd rows for all."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import _shared
from siltstone.llm._blobs import pack_sorted, unpack_sorted
from siltstone.llm.packing import class_counts, cuts, pack, size_class
from siltstone.llm import quality as Q
from siltstone.llm.quality import META_SIZE, TEXT_SIZE, co_train, meta_features, score_quality, taught, text_features
from siltstone.llm.queries import tokenizer_path
from siltstone.llm.tokens import read_tokens, token_index, write_tokens
from siltstone.llm.toxicity import DEPTH, DISCOUNT, END, SIGNS, _sums_by_join, drop_toxic, fold, labelled, score_toxicity, train, unit_counts, unit_evidence, word_evidence


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma-ray", "delta!", "it's", "naïve", "Übung", "x1", "…", "東京"]
    out = [(i, " ".join(rng.choice(words) for _ in range(int(10 ** rng.uniform(0, 3))))) for i in range(150)]
    return out + [(None, "no id here"), (7, out[7][1]), (7, "other text"), (900, None), (901, ""), (902, " \n"), (-5, "minus " * 9000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, ids int, part int, length int, class int").repartition(4)


@pytest.fixture(scope="module")
def ids(rows):
    t = Tokenizer.from_file(tokenizer_path())
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files(spark, rows, ids):
    path = _shared.new_path(spark, "test-tokens")
    write_tokens(frame(spark, rows), path, tokenizer_path())
    got = token_index(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    one = read_tokens(spark, path, "doc_id", "ids").where("doc_id = 3").first()
    assert one.ids == dict(ids)[3]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in read_tokens(spark, path, "doc_id", "n_tokens").where("doc_id = 3")._jdf.queryExecution().toString()


def test_token_files_of_nothing(spark, rows):
    path = _shared.new_path(spark, "test-tokens")
    write_tokens(frame(spark, rows).limit(0), path, tokenizer_path())
    assert token_index(spark, path).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole(spark, rows, ids, capacity):
    got = pack(frame(spark, rows), tokenizer_path(), capacity, with_ids=True).collect()
    docs = defaultdict(list)
    for r in got:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length > 0
        docs[str(r.doc_id), r.doc_tokens].append((r.start, r.ids))
    want = defaultdict(list)
    for i, x in ids:
        want[str(i), len(x)] += [(x, 1)]
    assert set(docs) == set(want)
    for k, parts in docs.items():
        if len(want[k]) == 1:
            joined = []
            for start, x in sorted(parts):
                assert start == len(joined)
                joined += x
            assert joined == want[k][0][0]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert pack(frame(spark, rows).limit(0), tokenizer_path(), capacity).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000, 2048])
def test_cuts_cover_every_length(capacity):
    for n in range(1, 3 * capacity + 2):
        at = 0
        for start, length, k in cuts(n, capacity):
            assert start == at and length > 0 and k == size_class(length, capacity) and k * length <= capacity
            at += length
        assert at == n
    assert len(class_counts(capacity)) < 100


def test_number_lists():
    for values in ([], [0], [5, 65_539, 65_540, 10**12], list(range(0, 10**6, 50_000))):
        assert unpack_sorted(pack_sorted(np.array(values, np.int64))).tolist() == values


def toxic_table(spark, n=700):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("the", "ran", "mol", "ten", "sar", "vi") for b in ("a", "os", "ing", "er", "un", "ti", "plo")]
    bad = ["vilegit", "vilegon", "slurp", "Vilegax!"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randrange(20, 80))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), f"s{i % 3}"))
        if i % 5:
            labels.append((i, toxic))
    docs += [(None, "the ran", None), (9000, None, None), (9001, "", "s"), (9002, " !! \n", "s"), (9003, "thea " * 40_000, "s"), (3, docs[3][1], "again")]
    labels += [(None, 1), (4, None), (6, 0), (77777, 1), (1, labels[0][1])]
    truth = [sum(w in x for w in bad) > 0 for _, x, _ in docs[:n]]
    return spark.createDataFrame([(*d, 5, 6.0) for d in docs], "doc_id long, text string, source string, label int, score double").repartition(3), spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, text int"), truth


def test_toxicity(spark):
    docs, labels, truth = toxic_table(spark)
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.id is not None and r.id < len(truth) and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got if r.id is not None)
    assert np.mean([r.predicted == truth[r.id] for r in held]) > 0.95
    empties = [r.score for r in got if r.id in (9000, 9001, 9002)]
    assert len(set(empties)) == 1 and empties[0] < 0.5
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = toxic_table(spark)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: sorted((str(r.id), round(r.score, 9)) for r in score_toxicity(docs, x).collect())
    assert scores(labels) == scores(flipped)


def counted_by_hand(rows):
    """The evidence of a word, from (text, label) rows, step by step."""
    seen = defaultdict(lambda: [0, 0])
    for text, label in rows:
        for w in text.split():
            if bare := w.strip(SIGNS).lower():
                seen[bare][label] += 1
    chain = lambda w: [w[:k] for k in range(min(len(w), DEPTH) + 1)] + [w + END]
    n, distinct, held, parts = defaultdict(lambda: [0, 0]), defaultdict(int), defaultdict(lambda: [0, 0]), {}
    for w, c in seen.items():
        for up, unit in zip([None, *chain(w)], chain(w)):
            parts[unit] = up
            distinct[unit] += 1
            n[unit] = [a + b for a, b in zip(n[unit], c)]
    for unit, up in parts.items():
        if up is not None:
            held[up] = [h + min(c, DISCOUNT) for h, c in zip(held[up], n[unit])]
    known = {u for u, c in n.items() if max(c) > DISCOUNT}

    def likely(unit, up, k):
        shared = ((distinct[unit] if unit in known else 0) + 0.5) / (distinct[up] + 32)
        return (max(n[unit][k] - DISCOUNT, 0) + held[up][k] * shared) / n[up][k] if n[up][k] else shared

    return lambda w: sum(np.log(likely(u, up, 1) / likely(u, up, 0)) for up, u in zip(chain(w), chain(w)[1:]) if up in known)


def test_toxicity_counts_by_hand_and_both_ways(spark):
    docs, labels, _ = toxic_table(spark)
    docs = docs.unionByName(docs.limit(0).unionByName(spark.createDataFrame([(5000, None, "x", 5, 6.0), (5001, "", "x", 5, 6.0), (5002, "neverseen w\u00f6rter theab", "x", 5, 6.0), (None, "vilegit " * 3000, "x", 5, 6.0)], docs.schema)))
    sent, joined = train(docs, labels), train(docs, labels, most_sent=0)
    assert sent.sent is not None and joined.sent is None
    rows = [(r.text, r.toxic) for r in docs.join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where(fold("doc_id").isin(1, 2, 3)).select(docs.text, "toxic").collect()]
    by_hand = counted_by_hand(rows)
    words = ["the", "thea", "vilegit", "vilegax", "slurp", "v", "zzz", "vilegitimately", "theosunknown", "w\u00f6rter"]
    assert np.allclose(word_evidence(pa.array(words), sent.sent, sent.root), [by_hand(w) for w in words], atol=1e-9)
    assert np.allclose(sent.weights, joined.weights, atol=1e-6)
    scores = [sorted((str(r.id), round(r.score, 6)) for r in score_toxicity(docs, labels, most_sent=m).collect()) for m in (2_000_000, 0)]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()


def test_toxicity_broadcasts_no_counts(spark):
    """Tables that grow with the text are small files and large in memory: none goes through the driver by what Spark takes its size for."""
    docs, labels, _ = toxic_table(spark)
    model = train(docs, labels, most_sent=0)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    planned = [unit_evidence(unit_counts(rows.withColumn("label", F.lit(1)))), _sums_by_join(rows, model), labelled(docs, labels, "doc_id", "text", "toxic")]
    for df in planned:
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "__bucket" not in x]  # filter bits are sent, and bounded
        assert "SortMergeJoin" in plan and not sent


@pytest.mark.parametrize("some", [None, 0, 1])
def test_toxicity_without_both_labels(spark, some):
    docs, labels, _ = toxic_table(spark, 60)
    given = labels.limit(0) if some is None else labels.where(F.col("toxic") == some).where("doc_id < 60")
    assert {r.score for r in score_toxicity(docs, given).collect()} == {float(some or 0)}


def quality_table(spark, n=500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["some", "plain", "words", "stand", "here", "now"]) for _ in range(40)]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"s{i % 4 if good else 9}", len(text)))
        if i % 3:
            labels.append((i, int(good)))
    docs += [(None, "x", "en", "s1", 1), (900, None, None, None, None), (901, "", "", "", 0), (902, "a " * 50_000, "en", "s1", -4), (3, docs[3][1], "en", "s1", 5)]
    return spark.createDataFrame([(*d, 1, b"") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, label int, text_view binary").repartition(3), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int"), n


def test_quality(spark):
    docs, labels, n = quality_table(spark)
    truth = {r.doc_id: r.text is not None and "!!" not in r.text for r in docs.collect()}
    got = score_quality(docs, labels, max_labelled=300).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.id is not None and r.id < n]
    assert np.mean([r.predicted == truth[r.id] for r in held]) > 0.95
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_features_have_fixed_sizes():
    for data in (b"", b"a", b" \n", "é x".encode()):
        assert text_features(data).shape == (TEXT_SIZE,) and np.isfinite(text_features(data)).all()
    assert meta_features(None, None, None).shape == (META_SIZE,) and meta_features("x", "y", 10**12).shape == (META_SIZE,)


def test_views_share_no_input():
    """A text of the same make has the same text view whatever its length; the metadata view sees no text."""
    one, long = text_features(b"Some plain words, and 7 more."), text_features(b"Some plain words, and 7 more. " * 40)
    at = [i for i in range(TEXT_SIZE) if i != Q.BUCKETS + 32]  # but for the blank between
    assert np.abs(one[at] - long[at]).max() < 0.02
    assert (text_features(b"alpha beta")[: Q.BUCKETS] != text_features(b"gamma delta")[: Q.BUCKETS]).any()


def test_co_training_uses_the_other_view():
    """A view without signal of its own for most rows gets better by what the other view teaches it."""
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.5
    strong = np.stack([y + rng.normal(0, 0.2, 2000), rng.normal(size=2000)], axis=1).astype(np.float32)
    weak = np.concatenate([y[:, None] * 1.0 + rng.normal(0, 1.2, (2000, 1)), rng.normal(size=(2000, 30))], axis=1).astype(np.float32)
    few, rest = slice(0, 40), slice(40, None)
    sums = lambda models: taught(models, [strong[rest], weak[rest]], 0.7)
    alone = co_train([strong[few], weak[few]], y[few], sums, rounds=0)
    after = co_train([strong[few], weak[few]], y[few], sums, rounds=5)
    right = lambda m: ((m[1].odds(weak) > 0) == y).mean()
    assert right(after) > right(alone)


def test_sums_over_a_table_are_those_of_its_rows(spark):
    """Brute force: what Spark gathers over all unlabelled rows equals one pass in memory, however the rows are dealt."""
    docs, _, _ = quality_table(spark, 120)
    rows = docs.select(F.col("doc_id").alias("id"), _shared.text_of("text").alias("text"), "lang", "source", "n_chars")
    table = _shared.materialize(Q._featured(rows), "test-views")
    views = Q._views(table.orderBy("id").toArrow())
    y = np.arange(len(views[0])) % 3 == 0
    models = [Q.fitted(v, y.astype(float), 1.0) for v in views]
    want, got = taught(models, views, 0.6), Q._sums(table.repartition(7), 0.6)(models)
    assert [n for _, n in got] == [n for _, n in want] and sum(n for _, n in got) > 0
    assert all(np.allclose(a, b) for (a, _), (b, _) in zip(got, want))
    assert [n for _, n in Q._sums(table.limit(0), 0.6)(models)] == [0, 0]
