import numpy as np
import pytest

from siltstone.llm.components import components
from siltstone.llm.simhash import blocks, drop_near_copies, fingerprint_of, links, near_groups, stars


def groups(pairs, nodes):
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {x: find(x) for x in nodes}


def brute_links(values, radius):
    v = np.array(values, np.int64).view(np.uint64)
    return [(values[i], values[j]) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= radius) if i < j]


def clustered(rng, centres=6, members=120, scattered=300):
    out = set(rng.integers(0, 1 << 64, scattered, dtype=np.uint64).tolist())
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(members):
            x = c
            for bit in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out), np.uint64).view(np.int64).tolist()


@pytest.mark.parametrize(("most", "radius"), [(8192, 4), (24, 4), (6, 2)])
def test_links_connect_what_brute_force_connects(spark, most, radius):
    values = clustered(np.random.default_rng(most + radius))
    found = [(r.u, r.v) for r in links(spark.createDataFrame([(x,) for x in values], "fp long"), radius, most).collect()]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in brute_links(values, radius)} or groups(found, values) == groups(brute_links(values, radius), values)
    assert groups(found, values) == groups(brute_links(values, radius), values)


def test_blocks_cover_64_bits():
    for radius in range(8):
        assert [a + w for a, w in blocks(radius)] == [*(a for a, _ in blocks(radius)[1:]), 64]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)]
    want = groups(pairs, {x for p in pairs for x in p})
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars():
    m, r = stars(np.array([5, 3, 9]), np.array([3, 1, 8]), 10)
    assert dict(zip(m.tolist(), r.tolist())) == {5: 1, 3: 1, 9: 8}


def test_fingerprint_edges():
    assert fingerprint_of(b" \t\n") == 0
    assert fingerprint_of(b"A b") == fingerprint_of(b"a\x0b\x0cB")
    assert fingerprint_of("É b c d".encode()) != fingerprint_of("é b c d".encode())
    assert fingerprint_of(b"a b c d") != fingerprint_of(b"a b c d e")


SCHEMA = "doc_id long, text string, fp string, row int"


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(50_000)) + " "
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, long, None, 3), (4, long + "end", None, 4), (None, long, None, 5), (7, "same id and text", None, 6), (7, "same id and text", None, 7), (8, "alone here now then", None, 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.id, r.component_id) for r in near_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (7, 7), (7, 7), (8, 8)], key=str)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8]
    assert near_groups(docs.limit(0)).count() == 0
    assert drop_near_copies(docs.limit(0)).count() == 0
