"""Exact, line and substring dedup, sharding, decontamination: brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import _shared
from siltstone.llm import line_dedup as L
from siltstone.llm.decontam import contaminated, drop_contaminated, find_contamination, windows_of
from siltstone.llm.exact_dedup import LsmIndex, exact_dedup
from siltstone.llm.sharding import assign_shards, jump_hash, write_shards
from siltstone.llm.substring_dedup import _deltas, _undeltas, substring_dedup

#: Columns whose names the operators use inside, and a null row of everything.
EXTRA = ", id int, row int, n int, key string, digest string, text_key int, shard int, label int, score double, n_words int, n_removed int, spans int, kept int, fp int, __no2 int"
N_EXTRA = EXTRA.count(",")


def make(spark, rows, extra=True):
    schema = "doc_id long, text string, source string" + (EXTRA if extra else "")
    return spark.createDataFrame([(*r, *([None] * N_EXTRA if extra else [])) for r in rows], schema).repartition(3)


PASSAGE = " ".join(f"p{i}" for i in range(30))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    out = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))), f"s{i % 7}") for i in range(120)]
    out += [(200 + i, out[i % 9][1], f"s{i % 5}") for i in range(40)]
    out += [(300 + i, f"x{i} y{i}\n{PASSAGE}\nmenu home\t\n\n z{i}", f"t{i % 12}") for i in range(30)]
    out += [(400, None, "s1"), (401, "", None), (402, "  \n\t ", "s1"), (403, "big " * 30_000 + PASSAGE, "s2"), (404, PASSAGE.upper(), "s3"), (405, "one two", "s1")]
    out += [(None, out[3][1], "s1"), (None, "menu home\nnull id", "s9"), (300, out[-5][1] or "", "s1"), (5, out[5][1], "s5"), (5, out[5][1], "s5"), (-7, out[20][1], "s0")]
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, rows, keep, weak):
    digest = {"digest": lambda t: F.crc32(t.cast("binary")).cast("string").cast("binary").substr(1, 1)} if weak else {}
    got = exact_dedup(make(spark, rows), keep=keep, **digest).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = min if keep == "smallest" else max
    want = sorted((str(i), str(best((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""])) for i, t, _ in rows)
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(spark, rows):
    assert exact_dedup(make(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_index_of_many_batches(spark, keep):
    """Levels, lookups by filters and reopening by the manifest, against a plain dictionary."""
    rng = np.random.default_rng(4)
    path = _shared.new_path(spark, "test")
    long = spark.createDataFrame([], "i long").schema["i"].dataType
    open_ = lambda: LsmIndex(spark, path, long, keep, fanout=2)
    frame_of = lambda pairs: spark.createDataFrame([(bytes([d]), i) for d, i in pairs], "digest binary, id long").repartition(3)
    index, known, best = open_(), {}, min if keep == "smallest" else max
    for turn in range(5):
        batch = [(int(d), None if rng.random() < 0.1 else int(i)) for d, i in zip(rng.integers(0, 60, 40), rng.integers(0, 10**6, 40))]
        if turn == 2:
            index = open_()  # another process goes on
        found = {r.digest[0]: (r.id, r.n) for r in index.lookup(frame_of([*batch, (200, 1)])).collect()}
        assert found == {d: known[d] for d, _ in batch if d in known}
        assert index.hits(frame_of(batch)).count() == sum(d in known for d, _ in batch)
        index.flush(frame_of(batch))
        for d, i in batch:
            old, n = known.get(d, (None, 0))
            known[d] = (best((x for x in (old, i) if x is not None), default=None), n + 1)
        assert all(len(level) < 2 for level in index.state["levels"])
    assert len(index.state["levels"]) > 2
    whole = index.compact().collect()
    assert {r.digest[0]: (r.id, r.n) for r in whole} == known and len(whole) == len(known) and len(open_().runs()) == 1
    with pytest.raises(ValueError):
        LsmIndex(spark, path, long, "largest" if keep == "smallest" else "smallest")


def jump(key, n):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(10**6, 10**6 + 200)]
    for n in (1, 2, 24, 25, 1000):
        assert jump_hash(np.array(keys), n).tolist() == [jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        jump_hash(np.array([1]), 0)


def test_shards(spark, rows, tmp_path):
    got = assign_shards(make(spark, rows), 24).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(i or 0, 24), jump(i or 0, 25)) for i, t, _ in rows)
    assert sorted((str(r.id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(make(spark, rows).limit(0), 24).count() == 0
    write_shards(make(spark, rows, extra=False), str(tmp_path / "out"), 4, pieces=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and all(r.shard == jump(r.doc_id or 0, 4) for r in back.collect())


@pytest.mark.parametrize("min_sites", [1, 3, 8])
@pytest.mark.parametrize("near", [0.25, 1.0])
def test_line_dedup(spark, rows, min_sites, near, monkeypatch):
    monkeypatch.setattr(L, "NEAR", near)
    sites, first = defaultdict(set), {}
    bare = lambda line: line.strip(" \t\r")
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            sites[bare(line)].add(s)
            if i is not None:
                first[bare(line)] = min(i, first.get(bare(line), i))
    want = []
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not bare(x) or len(sites[bare(x)] - {None}) < min_sites or i == first.get(bare(x))]
        want.append((str(i), None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept), str(s)))
    docs = make(spark, rows).drop("n_removed").withColumns({c: F.lit(7) for c in ("__doc", "__text_key", "__maybe", "__bucket", "__bits", "removed", "doc")})
    got = L.line_dedup(docs, min_sites)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed, str(r.source)) for r in got.collect() if r.text is not None) == sorted(w for w in want if w[1] is not None)
    assert got.count() == len(rows) and {r["__doc"] for r in got.collect()} == {7}
    assert L.line_dedup(docs.limit(0), min_sites).count() == 0
    with pytest.raises(ValueError):
        L.line_dedup(make(spark, rows), min_sites)


@pytest.mark.parametrize("cells", [4, 29])
def test_substring_dedup(spark, rows, cells):
    width, first = 13, {}
    split = {t: re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, _ in rows}
    for i, t, _ in rows:
        if i is not None:
            for k in range(len(split[t]) - width + 1):
                w = tuple(split[t][k : k + width])
                first[w] = min(i, first.get(w, i))
    want = []
    for i, t, _ in rows:
        w = split[t]
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = True
        want.append((str(i), len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring_dedup(make(spark, rows), width, max_cell_bits=max(cells, 13)).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert all(r.n_removed == sum(s.end - s.begin for s in r.spans) for r in got)
    assert substring_dedup(make(spark, rows).limit(0), width).count() == 0


def test_deltas():
    for values in ([], [1], [0, 254, 255, 600, 2**32 + 5], list(range(5, 4000, 7))):
        assert _undeltas(_deltas(np.array(values, np.int64))).tolist() == values


ITEMS = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short Item!"), (3, None), (4, "..."), (None, " ".join(f"r{i}" for i in range(14))), (5, " ".join(f"q{i}" for i in range(5, 25)))]
TEXTS = [
    (1, "before " + " ".join(f"Q{i}," for i in range(20)) + " after", "s"), (2, "a short-item here", "s"), (3, None, "s"), (4, "", "s"), (5, "... !!", "s"), (6, " ".join(f"q{i}" for i in range(12)), "s"),
    (7, "é " + " ".join(f"r{i}" for i in range(13)) + " short item short item", None), (7, "shortitem short items", "s"), (None, "short\nitem", "s"), (8, "pad " * 5000 + "short item", "s"), (9, "Kelvin K short item", "s"),
]


def brute(text):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in ITEMS:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])] |= {str(i)} if i is not None else set()
    w, hit, names = words(text), set(), set()
    for k in range(len(w)):
        for n in {len(x) for x in windows}:
            if (x := tuple(w[k : k + n])) in windows and len(x) == n:
                hit.update(range(k, k + n))
                names |= windows[x]
    return len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = make(spark, TEXTS)
    got = find_contamination(docs, items).withColumn("bad", contaminated()).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.bad) for r in got) == sorted((str(i), *brute(t)) for i, t, _ in TEXTS)
    for r in got:
        text = dict((i, t) for i, t, _ in TEXTS if i == r.doc_id).get(r.doc_id)
        for s in r.spans if r.doc_id not in (7,) else []:
            assert brute(text[s.begin : s.end])[1] == brute(text[s.begin : s.end])[0] > 0
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t, _ in TEXTS if not brute(t)[3])
    assert find_contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in find_contamination(docs, items.limit(0)).collect()} == {0}
    blocks = find_contamination(docs, items, block_bytes=300).withColumn("bad", contaminated()).collect()  # several automata
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, items, block_bytes=300).collect()) == sorted(str(r.doc_id) for r in clean.collect())
    assert all(r.spans == [] for r in find_contamination(docs, items, with_spans=False).collect())
    odd = docs.withColumns({"__row": F.lit(7), "__id": F.col("doc_id"), "__text": F.lit("x"), "__0": F.lit(1)})
    for block_bytes in (300, 1 << 20):  # kept columns of any name, with one automaton and with several
        kept = find_contamination(odd, items, keep=("source", "__row", "__id", "__text", "__0"), block_bytes=block_bytes)
        rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, str(r.source)) for r in kept.collect())
        assert rows == sorted((str(i), *brute(t)[:3], str(s)) for i, t, s in TEXTS)
        assert {(r["__row"], r["__text"], r["__0"], r["__id"] == r.doc_id) for r in kept.where("doc_id is not null").collect()} == {(7, "x", 1, True)}
    with pytest.raises(ValueError, match="n_hit"):
        find_contamination(docs.withColumn("n_hit", F.lit(1)), items, keep=("n_hit",))


def test_patterns_overlap_at_a_shared_space():
    assert windows_of("a b") == [" a b "] and windows_of("...") == windows_of(None) == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
