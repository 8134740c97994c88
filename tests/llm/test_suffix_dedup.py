"""Repeated byte strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import suffix_dedup as S
from siltstone.llm.queries import op11_suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(texts, threshold):
    """For each text its bytes, the removed spans and what is left."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + threshold] for d in data for i in range(len(d) - threshold + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - threshold + 1):
            if times[d[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\x01" * threshold
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.int8)))
        out.append((len(d), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    letters = "abcdefgé 漢"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared, border = word(90), word(14)
    out = [(i, word(rng.randrange(0, 120))) for i in range(60)]
    out += [(100 + i, word(rng.randrange(0, 40)) + shared[rng.randrange(0, 30) :] + word(rng.randrange(0, 40))) for i in range(40)]
    out += [(200 + i, word(20) + border + word(20)) for i in range(40)]  # a string too short to count, in many texts
    base = word(300)
    out += [(300 + i, base[:k] + rng.choice(letters) + base[k + 1 :]) for i, k in enumerate(rng.sample(range(300), 20))]
    out += [(400 + i, base) for i in range(30)] + [(500, out[0][1]), (500, out[0][1]), (None, out[1][1]), (None, None), (501, None), (502, ""), (503, "a" * 400), (504, "ab" * 300), (505, "x" + shared)]
    return out


EXTRA = "id string, k1 int, k2 int, rank int, s int, at int, before int, whole int, x int, kept int, n_bytes int, spans int"


@pytest.mark.parametrize("threshold, few, piece", [(16, 2048, 1 << 20), (16, 3, 1 << 20), (12, 5, 256), (1, 2, 1 << 20), (40, 2, 64)])
def test_dedup(spark, rows, threshold, few, piece):
    """Also with ranks of more positions than one task takes, and texts longer than a piece."""
    df = spark.createDataFrame([(*r, *[None] * 12) for r in rows], "doc_id long, text string, " + EXTRA).repartition(3)
    got = S.suffix_dedup(df, threshold, few=few, piece=piece).collect()
    want = [(str(i), *x) for (i, _), x in zip(rows, plain([t for _, t in rows], threshold))]
    assert sorted((str(r.id), r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in got) == sorted(want)


def test_nothing(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = S.suffix_dedup(spark.createDataFrame([(1, "short"), (2, "short"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_bytes, bytes(r.kept)) for r in got) == [(1, 5, b"short"), (2, 5, b"short"), (3, 0, b"")]
    with pytest.raises(ValueError):
        S.span_of(0)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: x for d, x in zip(docs, plain([d.text for d in docs], 200))}
    got = op11_suffix_dedup(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got) > 1_000
