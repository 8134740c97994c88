"""The pipeline's stages over the smallest tables: decisions take effect and columns stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siltstone.llm import _shared
from siltstone.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(_shared.materialize(stage(spark, out[-1], SF), name))
    return out


def test_stage_names_and_columns(steps):
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_toxicity(steps[0], labels).where("predicted = 0")
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(r.id for r in scored.collect())


def test_lines_change_texts_alone(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[1:3])
    assert set(before) == set(after)
    assert all(r.n_chars == len(r.text) and r.lang == before[i].lang for i, r in after.items())
    assert all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) for i, r in after.items())


def test_one_of_each_group_stays(steps):
    """Brute force by the rule of the stage: five words a shingle, a Jaccard similarity of 0.8 or more."""
    texts = {r.doc_id: r.text.lower().split() for r in steps[2].collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert {r.doc_id for r in steps[3].collect()} == {i for i in sets if find(i) == i}


def test_packed_pieces_are_of_the_documents_left(spark, steps):
    left = steps[4]
    assert left.count() <= steps[3].count()
    pieces = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert pieces.where("n <> m").count() == 0 and pieces.count() == left.count()


def test_run_is_the_stages_in_a_row(spark, steps):
    assert P.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").exceptAll(steps[5].select("doc_id", "start", "length", "ids_crc32")).count() == 0
