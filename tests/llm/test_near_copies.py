import numpy as np
import pytest

from siltstone.llm import near_copies
from siltstone.llm.near_copies import drop_similar, shingles_of, similar_rows
from siltstone.llm.simhash import fingerprint_of


def jaccard(a: str, b: str) -> float:
    x, y = (set(shingles_of(t.encode())[2].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[int(rng.integers(len(out)))] = f"new{rng.integers(10**6)}"
    return out


def texts():
    rng = np.random.default_rng(5)
    out = []
    for i in range(30):
        words = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(8, 150)))]
        out += [" ".join(edited(rng, words, k)) for k in (0, 1, 2, 3, 5)]
    head = " ".join(f"same{i}" for i in range(60))  # shingles that many texts have
    out += [f"{head} " + " ".join(f"own{i}x{k}" for k in range(int(rng.integers(5, 25)))) for i in range(60)]
    return out


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_groups_are_those_of_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    all_ = texts()
    label = list(range(len(all_)))
    for i in range(len(all_)):
        for j in range(i):
            if jaccard(all_[i], all_[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = similar_rows(spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string"))
    assert {r.id: r.component_id for r in got.collect()} == dict(enumerate(label))
    assert 30 < len(set(label)) < len(all_) - 20


def test_similar_texts_beyond_four_bits_go_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (1, 2926)")
    a, b = (r.text for r in docs.collect())
    assert (fingerprint_of(a.encode()) ^ fingerprint_of(b.encode())).bit_count() > 4 and jaccard(a, b) >= 0.8
    assert [r.doc_id for r in drop_similar(docs).collect()] == [1]


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, " \n", 2), (3, "A b", 3), (4, "a  B", 4), (5, "a b c", 5), (7, "same id and text", 6), (7, "same id and text", 7), (None, "a b c", 8), (None, "no id", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(1, None), (3, "A b"), (5, "a b c"), (7, "same id and text")]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id"]
    assert drop_similar(docs.limit(0)).count() == 0
