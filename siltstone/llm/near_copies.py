"""Near copies by the Jaccard similarity of word shingles, exactly: every pair that similar is linked.

Fingerprints (see simhash) of the same shingles propose a spanning star for each
group of close texts; links that the exact similarity confirms are joined first,
so that a large group costs no more than its members.

A prefix-filter join finds the rest. With all shingles in one fixed order, two
sets with a similarity of the threshold or more share one of the first
n - ceil(threshold * n) + 1 of either; only those are joined, and only between
groups. First each text is compared with one that shares the shingle, so that a
large group of close texts becomes one group without all its pairs. Then all that
share one are, between groups. A pair leaves the join only if both texts' parity
sketches allow it: of so many cells, those in which a text has an odd number of
shingles. Each cell that differs stands for a shingle that only one of the two has,
at least, so texts that differ in more cells than similar ones can differ in
shingles are none, whatever passage they share. A pair is read again and compared
only if it also shares enough of its prefixes, in places that leave room for the
rest (see _sharing). The order is by hash, with shingles that occur often in a
sample of the texts last. The sample decides how much is compared, not what is found.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared
from .components import components
from .simhash import keep_first, links

#: Texts sampled for frequent shingles (one of so many), the count from which one is frequent, and how many are put last at most.
SAMPLED = 8
FREQUENT = 16
MOST_FREQUENT = 1_000_000
#: How often the texts that share a shingle are compared with one of them, before all that are left are with each other.
STAR_ROUNDS = 2
#: Words of 64 cells in a parity sketch.
SKETCH = 4
_CELLS = [f"odd{i}" for i in range(SKETCH)]


def shingles_of(text: bytes, width: int = 5, seed: int = 42):
    """A hash of all words, a 64-bit fingerprint, and the distinct shingle hashes in order (empty without words)."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    joined = b" ".join(words)
    whole = xxhash.xxh3_64_intdigest(joined, seed)
    if not words:
        return whole, 0, np.empty(0, np.uint64)
    if len(words) <= width:
        one = xxhash.xxh64_intdigest(joined, seed)
        return whole, one, np.array([one], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps[: len(words) - width] + 1).tolist()], [*gaps[width - 1 :].tolist(), len(joined)]
    n, ones, digest, found = len(starts), np.zeros(64, np.int64), xxhash.xxh64_digest, []
    for at in range(0, n, 1 << 16):
        raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        found.append(raw.view(">u8").astype(np.uint64))
    return whole, int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"), np.unique(np.concatenate(found))


def parity_of(shingles):
    """Whether an odd number of the shingles falls in each cell, as SKETCH longs."""
    import numpy as np

    return np.packbits(np.bincount(shingles.astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1).view(np.int64)


def _lists(arrays):
    """An Arrow list array of unsigned arrays, as longs."""
    import numpy as np
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _frequent(texts: DataFrame, width: int) -> list:
    """The most frequent shingle hashes of the sampled texts, rarest first; their number is bounded."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shingles_of(t.as_py(), width)[2] for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([_lists(found).flatten()], ["shingle"])

    sampled = texts.where(F.pmod("text_key", F.lit(SAMPLED)) == 0).select("text_key", "text").dropDuplicates(["text_key"]).select("text")
    counted = sampled.transform(_shared.in_arrow, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return [r["shingle"] for r in counted.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toLocalIterator()][::-1]


def _described(rows: DataFrame, last: list, threshold: float, width: int) -> DataFrame:
    """id, text_key, words (a hash of all), fp, n (distinct shingles), prefix and parity sketch of each row."""
    import numpy as np

    frequent = np.array(last, np.int64).view(np.uint64)
    by = np.argsort(frequent)
    sent = rows.sparkSession.sparkContext.broadcast((frequent[by], by))  # MOST_FREQUENT numbers at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, place = sent.value
        for batch in batches:
            whole, fps, sizes, heads, odd = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                w, fp, found = shingles_of(text.as_py(), width)
                whole.append(w), fps.append(fp), sizes.append(len(found)), odd.append(parity_of(found))
                most = len(found) - math.ceil(threshold * len(found) - 1e-9) + 1 if len(found) else 0
                if len(known) and len(found):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = known[at] == found
                    rare, common = found[~often], found[often]
                    found = np.concatenate([rare, common[np.argsort(place[at[often]])]]) if len(rare) < most else rare
                heads.append(found[:most])
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), *longs, pa.array(sizes, pa.int32()), _lists(heads), *map(pa.array, np.stack(odd).T if odd else np.empty((SKETCH, 0), np.int64))], ["id", "text_key", "words", "fp", "n", "prefix", *_CELLS])

    schema = T.StructType([rows.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("words", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in _CELLS]])
    return rows.transform(_shared.in_arrow, run, schema)


def _sharing(rows: DataFrame, threshold: float, starred: bool = False) -> DataFrame:
    """rows: a shared shingle of a pair each. The pairs that may be similar: u, v.

    Similar texts have ``needed`` shingles in common, of which at least ``needed``
    less what lies behind the longer prefix are in both prefixes. The first half of
    these is asked for: the k-th in common is followed by all later ones, so rows
    that leave too little room behind them are none of these. With one text a
    shingle (``starred``) a pair's rows are seen in part only, and no place is asked for.
    """
    needed = F.ceil((F.col("n_u") + F.col("n_v")) * (threshold / (1 + threshold)) - 1e-6)
    behind = lambda n: F.ceil(F.col(n) * threshold - 1e-9) - 1
    half = F.ceil((needed - F.greatest(behind("n_u"), behind("n_v"))) / 2)
    room = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    rows = rows.where((F.col("root_u") != F.col("root_v")) & (F.least("n_u", "n_v") >= needed))
    if not starred:
        differ = [F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in _CELLS]
        rows = rows.where((room > needed - half) & (sum(differ[1:], differ[0]) <= F.col("n_u") + F.col("n_v") - 2 * needed))
    counted = rows.groupBy(F.col("words_u").alias("u"), F.col("words_v").alias("v"), "n_u", "n_v").agg(F.count("*").alias("n"), F.min("at_u").alias("at_u"), F.min("at_v").alias("at_v"))
    return counted.where((room >= needed) & (F.col("n") >= half)).select("u", "v")


def _confirmed(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """pairs: u, v (hashes of all words). Those whose shingle sets have the similarity; only texts in pairs are read again."""
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = _shared.materialize(pairs, "candidate-pairs")
    asked = pairs.select(F.col("u").alias("words")).union(pairs.select("v")).distinct()
    keys = _shared.materialize(firsts.select("words", "text_key").join(asked, "words"), "asked")
    schema = "words long, shingles array<long>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [shingles_of(t.as_py(), width) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64)), _lists([f[2] for f in found])], ["words", "shingles"])

    near = _shared.matching(rows.select("text_key", "text"), "text_key", keys.select("text_key"))
    texts = near.join(keys.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text")
    sets = _shared.materialize(texts.transform(_shared.in_arrow, run, schema).dropDuplicates(["words"]), "shingle-sets")
    both = pairs.join(sets.select(F.col("words").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("words").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    whole = F.size("su") + F.size("sv") - common
    out = _shared.materialize(both.where((whole > 0) & (common >= whole * threshold - 1e-9)).select("u", "v"), "links")
    _shared.drop(sets, keys, pairs)
    return out


def _shared_heads(firsts: DataFrame) -> DataFrame:
    """The shingles in the prefixes that several texts share: words, n, at, shingle."""
    every = firsts.where("n > 0").select("words", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = every.groupBy("shingle").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low <> high").select("shingle")
    return _shared.materialize(every.join(shared, "shingle", "left_semi"), "shared-heads")


def _between(heads: DataFrame, group: DataFrame) -> DataFrame:
    """Those of the heads that texts of several groups share, with root. Groups only merge, so the next round needs no others; heads are deleted."""
    placed = heads.select("words", "n", "at", "shingle").join(group.select(F.col("node").alias("words"), "root"), "words", "left").withColumn("root", F.coalesce("root", "words"))
    shared = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    out = _shared.materialize(placed.join(shared, "shingle", "left_semi"), "heads-between")
    _shared.drop(heads)
    return out


def similar_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row per input row: id, text_key, words, component_id (the smallest id reachable by links), row, keep_row.

    Rows with the same words are linked, wordless and null texts among
    themselves; texts shorter than a shingle are one shingle. See
    simhash.near_groups for ids that are null or repeated.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    text = _shared.text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = _shared.materialize(_described(rows, _frequent(rows, width), threshold, width).withColumn("row", F.monotonically_increasing_id()), "described")
    nodes = _shared.materialize(known.groupBy("words").agg(F.min("id").alias("id"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row")), "nodes")
    firsts = _shared.materialize(known.join(nodes.select("words", F.col("keep_row").alias("row")), ["words", "row"]).select("words", "text_key", "fp", "n", "prefix", *_CELLS), "firsts")
    # groups of close texts, as far as the similarity confirms them
    with_fp = firsts.where("n > 0").groupBy("fp").agg(F.min("words").alias("first"))
    near = links(with_fp.select("fp"))
    ends = with_fp.select(F.col("fp").alias("u"), F.col("first").alias("a")), with_fp.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    proposed = near.join(ends[0], "u").join(ends[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = firsts.where("n > 0").join(with_fp, "fp").select(F.col("words").alias("u"), F.col("first").alias("v"))
    sure = _confirmed(proposed.unionByName(same), firsts, rows, threshold, width)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("words", "n", "root", "at")]
    group, heads = components(sure), _shared_heads(firsts)
    merged = lambda links: components(group.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
    for turn in range(STAR_ROUNDS):  # each text with one that has the shingle
        heads = _between(heads, group)
        one = heads.groupBy("shingle").agg(F.min_by(F.struct(*side("v")), F.xxhash64("words", F.lit(turn))).alias("one"))
        found = heads.select("shingle", *side("u")).join(one.select("shingle", "one.*"), "shingle")
        group = merged(_confirmed(_sharing(found, threshold, starred=True), firsts, rows, threshold, width))
    # the rest: all pairs between groups
    heads = _between(heads, group)
    sketched = _shared.materialize(heads.join(firsts.select("words", *_CELLS), "words"), "sketched-heads")
    both = lambda s: [*side(s), *[F.col(c).alias(f"{c}_{s}") for c in _CELLS]]
    found = sketched.select("shingle", *both("u")).join(sketched.select("shingle", *both("v")), "shingle").where("words_u < words_v")
    root = merged(_confirmed(_sharing(found, threshold), firsts, rows, threshold, width))
    _shared.drop(heads, sketched)
    labelled = _shared.materialize(nodes.join(root.select(F.col("node").alias("words"), "root"), "words", "left").withColumn("root", F.coalesce("root", "words")), "labelled")
    whole = labelled.groupBy("root").agg(F.min("id").alias("component_id"), F.coalesce(F.min_by("keep_row", "id"), F.min("keep_row")).alias("keep_row"))
    of = _shared.materialize(labelled.select("words", "root").join(whole, "root").select("words", "component_id", "keep_row"), "group-of")
    return known.select("id", "text_key", "words", "row").join(of, "words").select("id", "text_key", "words", "component_id", "row", "keep_row")


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id (see similar_rows)."""
    return keep_first(docs, similar_rows(docs, id_column, text_column, threshold, width), id_column, text_column)
