"""SimHash near-dedup: a self-join of a binary trie of fingerprints.

A fingerprint sums up the shingle hashes of a whole text. Fingerprints that
differ in at most ``radius`` bits are linked; linked documents form groups.

The join walks pairs of trie nodes from the root down, adds up the bits in
which their paths differ and drops a pair once that exceeds the radius. To deal
the walk out, the 64 bits are cut into radius + 1 blocks: two fingerprints
within the radius agree in one block at least, so with each block rotated to
the top in turn it is enough to start at the pairs (node, same node) below that
block. A start node with many fingerprints is split further, pair by pair,
with the same pruning, until every pair of nodes fits one task.

Tasks hand back spanning stars, not all pairs, so that a large group of close
fingerprints gives as many rows as it has members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared
from .components import components

#: Levels by which a crowded pair of nodes is split at a time.
SPLIT = 6


def fingerprint_of(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, unsigned; bit i is set if it is in over half of the shingle hashes, repeats included."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps[: len(words) - shingle] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    n, ones, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """id, text_key, fp (signed long) of every row; null text counts as empty (fingerprint zero)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(fps)], ["id", "text_key", "fp"])

    text = _shared.text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.transform(_shared.in_arrow, run, schema)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of radius + 1 blocks that cover 64 bits."""
    width, longer = divmod(64, radius + 1)
    out, at = [], 0
    for i in range(radius + 1):
        out.append((at, width + (i < longer)))
        at += out[-1][1]
    return out


def _top(column: str, bits: Column | int) -> Column:
    """The top bits of a long, as a number."""
    return F.expr(f"shiftrightunsigned({column}, 64 - {bits})")


def _rotated(distinct: DataFrame, radius: int) -> DataFrame:
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(at).alias("by"), F.lit(width).alias("width")) for i, (at, width) in enumerate(blocks(radius))])
    out = distinct.select("fp", F.explode(turns).alias("x")).select("fp", "x.turn", "x.by", "x.width")
    turned = F.expr("case when `by` = 0 then fp else shiftleft(fp, `by`) | shiftrightunsigned(fp, 64 - `by`) end")
    return out.select("turn", "width", turned.alias("rot"))


def _tasks(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """turn, depth, a, b, side, rot: the fingerprints of every pair of trie nodes (a, b at that depth) to be walked in one task."""
    rows = _rotated(distinct, radius).withColumn("node", F.expr("shiftrightunsigned(rot, 64 - width)"))
    crowded = _shared.materialize(rows.groupBy("turn", "width", "node").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    easy = rows.select("turn", F.col("width").alias("depth"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("side"), "rot")
    if crowded.isEmpty():
        return easy
    easy = easy.join(crowded.select("turn", F.col("node").alias("a")), ["turn", "a"], "left_anti").select(easy.columns)
    inside = _shared.materialize(rows.join(crowded.select("turn", "node"), ["turn", "node"], "left_semi").select("turn", "width", "rot"), "crowded-rows")
    pairs = crowded.select("turn", F.col("width").alias("depth"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("err"))
    found = [easy]
    while not pairs.isEmpty():
        deeper = F.expr(f"least(64, depth + {SPLIT})")
        depths = pairs.select("turn", "depth").distinct()
        step = inside.join(F.broadcast(depths), "turn").withColumn("deeper", deeper)  # a row a turn
        children = step.groupBy("turn", "depth", "deeper", F.expr("shiftrightunsigned(rot, 64 - deeper)").alias("child")).agg(F.count("*").alias("n"))
        children = _shared.materialize(children.withColumn("parent", F.expr("shiftrightunsigned(child, deeper - depth)")), "children")
        left = children.select("turn", F.col("parent").alias("a"), F.col("child").alias("ca"), F.col("n").alias("na"), "deeper")
        right = children.select("turn", F.col("parent").alias("b"), F.col("child").alias("cb"), F.col("n").alias("nb"))
        grown = pairs.join(left, ["turn", "a"]).join(right, ["turn", "b"]).where("a < b or ca <= cb")
        grown = grown.withColumn("err", F.col("err") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) - F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
        grown = grown.where(F.col("err") <= radius).select("turn", F.col("deeper").alias("depth"), F.col("ca").alias("a"), F.col("cb").alias("b"), "err", "na", "nb")
        grown = _shared.materialize(grown, "node-pairs")
        done = (F.col("na") + F.col("nb") <= most) | (F.col("depth") >= 64)
        ends = F.expr("case when a = b then array(struct(a as node, 0 as side)) else array(struct(a as node, 0 as side), struct(b as node, 1 as side)) end")
        ready = grown.where(done).select("turn", "depth", "a", "b", F.explode(ends).alias("x")).select("turn", "depth", "a", "b", "x.node", "x.side")
        level = grown.select("turn", "depth").distinct()
        placed = inside.join(F.broadcast(level), "turn").withColumn("node", F.expr("shiftrightunsigned(rot, 64 - depth)"))
        found.append(placed.join(ready, ["turn", "depth", "node"]).select(easy.columns))
        pairs = grown.where(~done).drop("na", "nb")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def walk(rot, starts, depths, sides, radius: int):
    """Joins trie nodes in memory. rot: unsigned fingerprints, each start's sorted by side and value.

    starts: bounds of the starts in rot; depths: of each start; sides: 0 or 1
    of each fingerprint. Yields index arrays (i, j) of linked fingerprints.
    """
    import numpy as np

    n = len(rot)
    cut = np.add.reduceat((sides == 0).astype(np.int64), starts[:-1]) + starts[:-1] if n else starts[:-1]
    alone = cut == starts[1:]  # a node with itself
    a_lo, a_hi = starts[:-1].astype(np.int64), cut.astype(np.int64)
    b_lo, b_hi = np.where(alone, a_lo, cut).astype(np.int64), starts[1:].astype(np.int64)
    order = np.argsort(depths, kind="stable")
    fresh = [(int(d), order[depths[order] == d]) for d in np.unique(depths)]
    empty = np.empty(0, np.int64)
    front = (empty, empty, empty, empty)
    for level in range(65):
        new = [x for d, x in fresh if d == level]
        if new:
            front = tuple(np.concatenate([f, x[new[0]]]) for f, x in zip(front, (a_lo, a_hi, b_lo, b_hi)))
        if not len(front[0]):
            continue
        al, ah, bl, bh = front
        pairs = (ah - al) * (bh - bl)
        small = (pairs <= 256) | (level == 64)
        yield from _leaves(rot, al[small], ah[small], bl[small], bh[small], radius)
        al, ah, bl, bh = (x[~small] for x in front)
        if not len(al) or level == 64:
            front = (al[:0], ah[:0], bl[:0], bh[:0])
            continue
        ones = np.concatenate([[0], np.cumsum((rot >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = al == bl
        parts = [(al, am, bl, bm), (am, ah, bm, bh), (al, am, bm, bh), (am[~own], ah[~own], bl[~own], bm[~own])]
        al, ah, bl, bh = (np.concatenate(x) for x in zip(*parts))
        live = (ah > al) & (bh > bl)
        al, ah, bl, bh = al[live], ah[live], bl[live], bh[live]
        shift = np.uint64(63 - level)
        near = np.bitwise_count((rot[al] ^ rot[bl]) >> shift) <= radius  # both paths are fixed down to this level
        front = (al[near], ah[near], bl[near], bh[near])


def _leaves(rot, al, ah, bl, bh, radius, most=1 << 22):
    import numpy as np

    sizes = (ah - al) * (bh - bl)
    cuts, total = [0], 0
    for i, s in enumerate(sizes.tolist()) if sizes.sum() > most else ():
        total += s
        if total > most:
            cuts.append(i + 1)
            total = 0
    cuts.append(len(sizes))
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        size, width = sizes[lo:hi], (bh - bl)[lo:hi]
        which = np.repeat(np.arange(hi - lo), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        i, j = al[lo:hi][which] + k // width[which], bl[lo:hi][which] + k % width[which]
        near = (i != j) & (np.bitwise_count(rot[i] ^ rot[j]) <= radius)
        if near.any():
            yield i[near], j[near]


def stars(i, j, n: int):
    """(member, root) indices of a spanning star of each component of the links i-j among n nodes."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def links(distinct: DataFrame, radius: int = 4, most: int = 8192) -> DataFrame:
    """distinct: fp. Returns u, v: linked fingerprints, enough of them to connect all that are linked."""
    turned = blocks(radius)

    def join(batches):
        import numpy as np
        import pyarrow as pa

        def one(table):
            rot = table["rot"].to_numpy().view(np.uint64)
            keys = [table[c].to_numpy() for c in ("turn", "depth", "a", "b")]
            new = np.zeros(len(rot), bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.append(np.flatnonzero(new), len(rot))
            sides = table["side"].to_numpy()
            nth = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            order = np.lexsort((rot, sides, nth))
            rot, sides = rot[order], sides[order]
            by = np.array([at for at, _ in turned], np.uint64)[keys[0]]
            back = np.uint64(64) - by
            fp = np.where(by == 0, rot, (rot >> by) | (rot << (back & np.uint64(63)))).view(np.int64)
            held_i, held_j, held = [], [], 0

            def settled():
                return stars(np.concatenate(held_i), np.concatenate(held_j), len(rot))

            for i, j in walk(rot, starts, keys[1][starts[:-1]] if len(rot) else keys[1], sides, radius):
                held_i.append(i), held_j.append(j)
                held += len(i)
                if held > 4_000_000:
                    m, r = settled()
                    held_i, held_j, held = [m], [r], 0
            if held_i:
                m, r = settled()
                yield pa.RecordBatch.from_arrays([pa.array(fp[m]), pa.array(fp[r])], ["u", "v"])

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            if kept.num_rows < 100_000:
                continue
            same = np.ones(kept.num_rows, bool)
            for c in ("turn", "depth", "a", "b"):
                x = kept[c].to_numpy()
                same &= x == x[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last start may go on
            if last:
                yield from one(kept.slice(0, last))
                kept = kept.slice(last).combine_chunks()
        if kept is not None and kept.num_rows:
            yield from one(kept)

    key = ["turn", "depth", "a", "b"]
    return _tasks(distinct, radius, most).repartition(*key).sortWithinPartitions(*key).transform(_shared.in_arrow, join, "u long, v long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, shingle: int = 4, most: int = 8192) -> DataFrame:
    """One row per input row: id, text_key, fp, component_id (the smallest id reachable by links), row, keep_row.

    Wordless and null texts have fingerprint zero and are linked like any other.
    A component whose ids are all null has a null component_id. ``row`` numbers
    the rows, and keep_row is that of the component's first (smallest id, one
    row of several with that id). Other columns are not looked at. An empty
    table gives no rows.
    """
    rows = _shared.materialize(fingerprints(docs, id_column, text_column, shingle).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    first = [F.min("id").alias("id"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row")]
    nodes = _shared.materialize(rows.groupBy("fp").agg(*first), "nodes")
    root = components(links(nodes.select("fp"), radius, most))
    labelled = nodes.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = _shared.materialize(labelled, "labelled")
    whole = labelled.groupBy("root").agg(F.min("id").alias("component_id"), F.coalesce(F.min_by("keep_row", "id"), F.min("keep_row")).alias("keep_row"))
    by_fp = _shared.materialize(labelled.select("fp", "root").join(_shared.materialize(whole, "groups"), "root").select("fp", "component_id", "keep_row"), "group-of")
    return rows.join(by_fp, "fp").select("id", "text_key", "fp", "component_id", "row", "keep_row")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id (see near_groups). Rows alike in id and text count as one."""
    return keep_first(docs, near_groups(docs, id_column, text_column, radius, shingle), id_column, text_column)


def keep_first(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs with the rows that found (id, text_key, row, keep_row) keeps, all columns as they were. Rows alike in id and text count as one."""
    key = lambda i, t: F.xxhash64(i, t).alias("key")
    kept = found.where("row = keep_row").select(key(F.col("id"), F.col("text_key")), "id", "text_key")
    gone = found.where("row <> keep_row").select(key(F.col("id"), F.col("text_key")), "id", "text_key")
    both = _shared.materialize(gone.join(kept, "key", "left_semi").distinct(), "kept-and-dropped")  # the same id and text on both sides
    names = docs.columns
    mark = F.xxhash64(F.col(id_column), F.xxhash64(_shared.text_of(text_column)))
    out = _shared.without(docs, mark, _shared.materialize(gone.join(both, "key", "left_anti").select("key").distinct(), "dropped"), "key")
    if both.isEmpty():
        return out
    k = _shared.unused(out, "__key")
    marked = out.withColumn(k, mark)
    single = marked.join(both.select(F.col("key").alias(k)), k, "left_anti")
    repeated = marked.join(both.select(F.col("key").alias(k)), k, "left_semi").dropDuplicates([k])
    return single.unionByName(repeated.select(single.columns)).select(names)
