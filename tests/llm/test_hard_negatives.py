"""Hard negatives against a plain walk over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import hard_negatives as H


def plain(rows, positives, negatives, low, high):
    kept = {}
    for i, label, x, *_ in rows:
        if i is not None and label is not None and x is not None and None not in x:
            kept[i] = min(kept.get(i, (label, x)), (label, x))
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, x) in kept.items():
        if a % 5:
            continue
        ranked = sorted((-score(x, y), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            good = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(good[:negatives])]
    return sorted(out)


def mined(df, **how):
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 5 == 0, **how).collect()))


SCHEMA = "vec_id long, label int, embedding array<long>, id string, x int, cell int, score double, rank int"


def make(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("spread", [3, 60, 1 << 29])
def test_mining(spark, spread, monkeypatch):
    """Near and far vectors, one vector in a third of all rows, ties, repeats and odd rows; small groups and blocks."""
    monkeypatch.setattr(H, "GROUP", 16)
    rng = random.Random(spread)
    centres = [[rng.randrange(-spread, spread + 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(300):
        c = centres[0] if i % 3 == 0 else [v + rng.randrange(-2, 3) for v in rng.choice(centres)]
        rows.append((i, rng.randrange(4), c))
    rows += [(300, None, centres[1]), (305, 1, None), (310, 1, [1, None, 2, 3, 4, 5]), (None, 1, centres[2]), (10, 0, centres[3]), (10, 0, centres[3]), (315, 2, []), (320, 2, [7]), (325, 9, centres[4]), (-5, 1, centres[5])]
    got = mined(make(spark, rows), positives=4, negatives=3, low=50, high=95)
    assert got == plain(rows, 4, 3, 50, 95) and len(got) > 100
    assert mined(make(spark, rows), positives=1, negatives=7, low=0, high=200) == plain(rows, 1, 7, 0, 200)


def test_nothing(spark):
    assert mined(make(spark, [])) == []
    assert mined(make(spark, [(1, 1, [1]), (2, 2, [1])])) == []
    assert mined(make(spark, [(5, 1, [1])])) == []
    with pytest.raises(ValueError):
        mined(make(spark, []), low=9, high=1)
