"""Periodic runs against a walk over all periods, on words and through Spark."""

import hashlib
import random
import zlib

import pytest

from siltstone.llm.periodic_runs import Ends, collapse_runs, kept_words, text_runs
from siltstone.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(w, exponent=4, least=6):
    """Every maximal stretch of each period that has no smaller one."""
    out, n = set(), len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i and not any(all(w[t] == w[t + r] for t in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out)


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 3), (3, 4), (6, 3), (7, 8)])
def test_runs(exponent, least):
    rng = random.Random(exponent)
    for _ in range(1500):
        n, k = rng.randrange(0, 60), rng.randrange(1, 5)
        w = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert text_runs(w, exponent, least) == plain_runs(w, exponent, least)


def test_long_runs():
    assert text_runs(["a"] * 30_000) == [(0, 30_000, 1)]
    w = [f"w{i}" for i in range(3_000)]
    assert text_runs(w + w[1_000:] * 4 + ["end"]) == [(1_000, 10_000, 2_000)]


def test_ends_in_order():
    rng, own = random.Random(3), Ends(5)
    numbers = [5]
    for x in rng.sample(range(10, 40_000), 5_000):
        before, after = own.add(x)
        assert before == max((y for y in numbers[-50:] if y < x), default=before) or before > max(y for y in numbers[-50:] if y < x)
        numbers.append(x)
    numbers.sort()
    assert list(own) == numbers and own.size == len(numbers)
    assert [own.after(a) for a in numbers] == [*numbers[1:], None]


def odd_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.randrange(3)) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(None, "x y " * 9), (100, None), (101, ""), (102, " \n\t\r\x0b\f "), (103, "big " * 20_000), (7, "tie tie tie tie tie tie a b a b a b a b"), (7, "tie tie tie tie tie tie a b a b a b a b")]
    return [*rows, (104, "             "), (105, "é è " * 5)]


def test_operator(spark):
    schema = "doc_id long, text string, id string, runs int, n_words int, kept_text int, start int"
    got = collapse_runs(spark.createDataFrame([(*r, *[None] * 5) for r in odd_rows()], schema).repartition(3)).collect()
    want = []
    for i, t in odd_rows():
        w = (t or "").encode().split()
        runs = plain_runs(w) if len(w) < 1_000 else [(0, len(w), 1)]
        want.append((str(i), len(w), runs, b" ".join(kept_words(w, runs)).decode()))
    assert sorted((str(r.id), r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got) == sorted(want)
    assert collapse_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        text_runs(["a"], exponent=1)


def test_query(spark):
    rows = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = 0
    for d in docs:
        w, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, got = text_runs(w), rows[d.doc_id]
        if n <= 400:
            assert runs == plain_runs(w)
        planted += bool(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(b" ".join(kept_words(w, runs))).hexdigest()
    assert planted > 3
