"""Hard-negative mining: a Voronoi-partitioned kNN join, made exact by bounds.

Inner products become distances: with M the greatest norm, each vector x gets
one more component, the root of M^2 - |x|^2, and an anchor q a zero; then
|x - q|^2 = M^2 + |q|^2 - 2 x.q, so the nearest vectors are those of the
highest score. A bounded sample of vectors serves as pivots. Every vector goes
to the cell of its nearest pivot, in blocks that a task packs; anchors go to
groups of near cells, of some 2,000 anchors each.

Of each label and cell three figures are kept: least and greatest distance from
the pivot, and a distance within which there are enough vectors to serve an
anchor. The triangle inequality turns them into a bound on an anchor's farthest
wanted neighbour, and into the cells that may hold a nearer one. Only those
cells' blocks are sent to the anchor's group. There, the join is exact: integer
inner products, one block after another, with the best so far per anchor. A
group is joined in parts, so no task holds more than one group and one block,
whatever a cell's size.

Two such joins run: positives are the nearest vectors of the anchor's label;
negatives are the nearest of other labels in a band below each positive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared

#: Pivots are this many at most, a sample by hash of the identifier; they bound cells, never rows.
MOST_PIVOTS = 256
#: Anchors a group and vectors a block aim at these sizes.
GROUP, BLOCK = 2048, 2048
_BLOCK_SCHEMA = "cell int, block long, n long, ids binary, labels binary, x binary"


def _matrix(column, dim: int):
    """An Arrow column of number lists as an integer matrix; shorter lists end in zeros."""
    import numpy as np

    out = np.zeros((len(column), dim), np.int64)
    offsets = column.offsets.to_numpy()
    sizes, values = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


class Space:
    """Pivots and the greatest norm: where a vector lies. Small, and sent with the tasks."""

    def __init__(self, pivots, norm2: float, greatest: int, dim: int) -> None:
        self.pivots, self.norm2, self.dim = pivots, norm2, dim
        #: In floating point, sums of products are exact below 2**53.
        self.exact = dim * float(greatest) ** 2 < 2**52
        self.wire = "<i2" if greatest < 2**15 else "<i4" if greatest < 2**31 else "<i8"

    def distances(self, x, anchor: bool):
        """Distance of each vector from each pivot."""
        import numpy as np

        x = x.astype(float)
        own = (x * x).sum(1)
        lift = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.norm2 - own, 0))
        p2 = (self.pivots**2).sum(1)
        square = (own + lift**2)[:, None] + p2[None, :] - 2 * (x @ self.pivots[:, :-1].T + lift[:, None] * self.pivots[None, :, -1])
        return np.sqrt(np.maximum(square, 0))

    def slack(self) -> float:
        """What rounding may do to a distance."""
        return 1e-6 * math.sqrt(self.norm2 + 1)

    def scores(self, a, b):
        import numpy as np

        return (a.astype(float) @ b.astype(float).T).astype(np.int64) if self.exact else a @ b.T


def _space(rows: DataFrame) -> tuple[Space, int] | None:
    """The space of all rows (id, label, x) and their number; none without rows."""

    def measure(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                sizes = np.diff(batch.column("x").offsets.to_numpy())
                x = _matrix(batch.column("x"), max(int(sizes.max()), 1))
                yield pa.RecordBatch.from_pydict({"dim": [int(x.shape[1])], "norm2": [float((x.astype(float) ** 2).sum(1).max())], "greatest": [int(np.abs(x).max())], "n": [batch.num_rows]})

    facts = rows.select("x").transform(_shared.in_arrow, measure, "dim long, norm2 double, greatest long, n long").agg(F.max("dim").alias("dim"), F.max("norm2").alias("norm2"), F.max("greatest").alias("greatest"), F.sum("n").alias("n")).first()
    if not facts["n"]:
        return None
    import numpy as np

    most = min(MOST_PIVOTS, max(1, round(math.sqrt(facts["n"]) / 4)))
    drawn = rows.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(most).collect()
    x = np.zeros((len(drawn), facts["dim"]))
    for i, r in enumerate(drawn):
        x[i, : len(r["x"])] = r["x"]
    x = np.unique(x, axis=0)
    return Space(np.hstack([x, np.sqrt(np.maximum(facts["norm2"] - (x * x).sum(1), 0))[:, None]]), facts["norm2"], facts["greatest"], facts["dim"]), facts["n"]


def _pack(ids, labels, x, wire) -> dict:
    return {"n": len(ids), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "x": x.astype(wire).tobytes()}


def _unpack(r: dict, space: Space):
    import numpy as np

    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["x"], space.wire).reshape(-1, space.dim).astype(np.int64)


def _blocks(rows: DataFrame, space: Space) -> DataFrame:
    """The rows by cell, in blocks, put aside."""

    def pack(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])
        held, count = [], 0

        def flush():
            ids, labels, x, cells = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(cells, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(cells[order])) + 1).tolist(), len(order)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                for lo in range(a, b, BLOCK):
                    own = order[lo : min(lo + BLOCK, b)]
                    out.append({"cell": int(cells[own[0]]), "block": uuid.uuid4().int >> 65} | _pack(ids[own], labels[own], x[own], space.wire))
            for at in range(0, len(out), 32):
                yield pa.RecordBatch.from_pylist(out[at : at + 32], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _matrix(part.column("x"), space.dim)
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), x, space.distances(x, False).argmin(1)))
                count += len(x)
                if count >= 16 * BLOCK:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return _shared.materialize(rows.transform(_shared.in_arrow, pack, _BLOCK_SCHEMA), "blocks")


def _radii(blocks: DataFrame, space: Space, enough: int) -> DataFrame:
    """label, cell: least and greatest distance from the pivot, and one within which some block has ``enough`` rows (infinite: none has)."""

    def measure(batches):
        import numpy as np
        import pyarrow as pa

        names = ("label", "cell", "least", "most", "enough")
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                _, labels, x = _unpack(r, space)
                d = space.distances(x, False)[:, r["cell"]]
                order = np.lexsort((d, labels))
                labels, d = labels[order], d[order]
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(d)]
                out += [(int(labels[a]), r["cell"], float(d[a]), float(d[b - 1]), float(d[a + enough - 1]) if b - a >= enough else math.inf) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))) if out else {c: [] for c in names}, schema=pa.schema([("label", pa.int64()), ("cell", pa.int32()), *((c, pa.float64()) for c in names[2:])]))

    found = blocks.transform(_shared.in_arrow, measure, "label long, cell int, least double, most double, enough double")
    return found.groupBy("label", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("enough").alias("enough"))


def _cells_for_positives(anchors: DataFrame, radii: DataFrame, space: Space, groups) -> DataFrame:
    """anchors with ``grp`` and ``cells``: those that may hold one of the wanted nearest of the label."""
    by_label = radii.groupBy("label").agg(F.collect_list(F.struct("cell", "least", "most", "enough")).alias("radii"))  # MOST_PIVOTS of them at most

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"), space.dim)
            d = space.distances(x, True)
            cells = []
            for i, radii in enumerate(batch.column("radii").to_pylist()):
                at, least, most, enough = (np.array([r[c] for r in radii]) for c in ("cell", "least", "most", "enough"))
                far = (d[i, at] + enough).min() + space.slack()
                cells.append(at[np.maximum(d[i, at] - most, least - d[i, at]) <= far].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), pa.array(groups(d.argmin(1), batch.column("id").to_numpy()), pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["id", "label", "x", "grp", "cells"])

    return anchors.join(by_label, "label").select("id", "label", "x", "radii").transform(_shared.in_arrow, choose, "id long, label long, x array<long>, grp int, cells array<int>")


def _cells_for_negatives(anchors: DataFrame, bounds, space: Space, low: int, high: int) -> DataFrame:
    """anchors (id, label, x, grp, scores) with the bands below their positives' scores, and ``cells``: those whose scores may lie in one of them."""

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        at, inner, outer = bounds
        for batch in batches:
            x = _matrix(batch.column("x"), space.dim)
            d = space.distances(x, True)[:, at]
            near = np.maximum(np.maximum(d - outer, inner - d) - space.slack(), 0)
            far = d + outer + space.slack()
            whole = space.norm2 + (x.astype(float) ** 2).sum(1)[:, None]
            lows = [[-((-v * low) // 100) for v in p] for p in batch.column("scores").to_pylist()]
            highs = [[v * high // 100 for v in p] for p in batch.column("scores").to_pylist()]
            slack = 1e-9 * (space.norm2 + 1)
            least, most = np.array([min(v) for v in lows], float)[:, None], np.array([max(v) for v in highs], float)[:, None]
            good = ((whole - near**2) / 2 + slack >= least) & ((whole - far**2) / 2 - slack <= most)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "x", "grp")], pa.array(lows, longs), pa.array(highs, longs), pa.array([at[g].tolist() for g in good], pa.list_(pa.int32()))], ["id", "label", "x", "grp", "low", "high", "cells"])

    return anchors.transform(_shared.in_arrow, choose, "id long, label long, x array<long>, grp int, low array<long>, high array<long>, cells array<int>")


def _joined(anchors: DataFrame, blocks: DataFrame, space: Space, parts: int, best, width: int) -> DataFrame:
    """(anchor, slot, id, score): of each anchor and slot, the best of each part of its group's blocks.

    anchors: id, label, x, grp, cells and, for bands, low and high. ``best``
    makes an object that looks at the vectors of a part and gives these rows.
    """
    wanted = anchors.select("grp", F.explode("cells").alias("cell")).distinct()
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    sent = wanted.join(blocks, "cell").select("grp", part("block").alias("part"), F.lit(1).alias("kind"), "ids", "labels", "x", F.lit(None).cast("binary").alias("bands"))
    has_bands = "low" in anchors.columns

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "x", "bands"))])
        for batch in batches:
            x, ids, labels, grp = _matrix(batch.column("x"), space.dim), *(batch.column(c).to_numpy() for c in ("id", "label", "grp"))
            bands = np.stack([_band(batch.column("low"), width, 1), _band(batch.column("high"), width, 0)], 1) if has_bands else np.zeros((len(ids), 0), np.int64)
            for g in np.unique(grp).tolist():
                own = np.flatnonzero(grp == g)
                r = _pack(ids[own], labels[own], x[own], space.wire)
                del r["n"]
                r |= {"grp": g, "kind": 0, "bands": bands[own].astype("<i8").tobytes()}
                for lo in range(0, parts, 16):
                    yield pa.RecordBatch.from_pylist([r | {"part": p} for p in range(lo, min(lo + 16, parts))], schema=schema)

    dealt = anchors.drop("cells").transform(_shared.in_arrow, pack, "grp int, part int, kind int, ids binary, labels binary, x binary, bands binary").unionByName(sent)

    def join(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "slot", "id", "score")])
        key, own, held, count, state = None, [], [], 0, None

        def look():
            nonlocal state, held, count
            if state is None and own:
                a = [np.concatenate(c) for c in zip(*own)]
                state = best(space, a[0], a[1], a[2], a[3])
            if state is not None and held:
                ids, labels, x = (np.concatenate(c) for c in zip(*held))
                order = np.argsort(ids, kind="stable")  # of equal scores the first is the smallest
                state.look(ids[order], labels[order], x[order])
            held, count = [], 0

        def result():
            look()
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in state.rows()], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["grp"], r["part"]) != key:
                    yield from result()
                    key, own, state = (r["grp"], r["part"]), [], None
                if r["kind"] == 0:
                    ids, labels, x = _unpack(r, space)
                    own.append((ids, labels, x, np.frombuffer(r["bands"], "<i8").reshape(len(ids), 2, -1) if has_bands else np.zeros((len(ids), 2, 0), np.int64)))
                else:
                    held.append(_unpack(r, space))
                    count += len(held[-1][0])
                    if count >= 2 * BLOCK:
                        look()
        yield from result()

    n = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = dealt.repartition(n, "grp", "part").sortWithinPartitions("grp", "part", "kind")
    return spread.transform(_shared.in_arrow, join, "anchor long, slot long, id long, score long")


def _band(column, width: int, empty: int):
    """Lists of bounds as a matrix; a band that an anchor lacks lets nothing in."""
    import numpy as np

    out = np.full((len(column), width), np.iinfo(np.int64).max if empty else np.iinfo(np.int64).min)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


class _Best:
    """The ``keep`` best of each anchor and slot among the vectors looked at: higher scores first, ties by smaller id."""

    keep, slots = 1, 1

    def __init__(self, space, ids, labels, x, bands) -> None:
        import numpy as np

        self.space, self.ids, self.labels, self.x, self.bands = space, ids, labels, x, bands
        self.slots = bands.shape[2] or 1
        self.anchor = np.empty(0, np.int64)  # anchor * slots + slot
        self.id, self.score = self.anchor.copy(), self.anchor.copy()
        self.least = np.full(len(ids) * self.slots, np.iinfo(np.int64).min)  # a full slot's last score

    def take(self, anchor, ids, score) -> None:
        import numpy as np

        good = score >= self.least[anchor]
        anchor, ids, score = (np.concatenate([a, b[good]]) for a, b in ((self.anchor, anchor), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, anchor))
        anchor, ids, score = anchor[order], ids[order], score[order]
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        place = np.arange(len(anchor)) - np.repeat(new, np.diff(np.append(new, len(anchor))))
        stay = place < self.keep
        self.anchor, self.id, self.score = anchor[stay], ids[stay], score[stay]
        full = place == self.keep - 1
        self.least[anchor[full]] = score[full]

    def rows(self):
        return self.ids[self.anchor // self.slots], self.anchor % self.slots, self.id, self.score


def _positives(keep: int):
    class Positives(_Best):
        def look(self, ids, labels, x) -> None:
            import numpy as np

            for label in np.intersect1d(self.labels, labels).tolist():
                a, b = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
                s = self.space.scores(self.x[a], x[b])
                i, j = np.nonzero((s >= self.least[a][:, None]) & (self.ids[a][:, None] != ids[b][None, :]))
                self.take(a[i], ids[b[j]], s[i, j])

    Positives.keep = keep
    return Positives


def _negatives(keep: int):
    class Negatives(_Best):
        def look(self, ids, labels, x) -> None:
            import numpy as np

            s = self.space.scores(self.x, x)
            other = self.labels[:, None] != labels[None, :]
            for slot in range(self.slots):
                at = np.arange(len(self.ids)) * self.slots + slot
                low = np.maximum(self.bands[:, 0, slot], self.least[at])
                i, j = np.nonzero((s >= low[:, None]) & (s <= self.bands[:, 1, slot][:, None]) & other)
                self.take(at[i], ids[j], s[i, j])

    Negatives.keep = keep
    return Negatives


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of what the parts found, the first n of each key, ranked from 1: in two steps, so that a key's parts needn't meet at once."""
    entry = F.struct((-F.col("score")).alias("__s"), "id", "score")
    head = lambda c: F.slice(F.array_sort(c), 1, n)
    some = found.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(16)).alias("__salt")).agg(head(F.collect_list(entry)).alias("x"))
    whole = some.groupBy(*keys).agg(head(F.flatten(F.collect_list("x"))).alias("x"))
    return whole.select(*keys, F.posexplode("x").alias("at", "y")).select(*keys, (F.col("at") + 1).alias("rank"), "y.id", "y.score")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: whole-number vectors (array<long>; a shorter one ends in zeros)
    with whole-number ids and labels. A score is the inner product. An anchor's
    positives are the first ``positives`` other rows of its label; for each, the
    first ``negatives`` rows of other labels whose score lies between ``low``
    and ``high`` per cent of the positive's come back, ranked from 1. First is
    the higher score, then the smaller id; fewer come back where there are fewer.

    ``is_anchor`` is a condition on the columns of ``vectors``. Rows with a null
    id, label, vector or component take no part. Of rows that repeat an id, the
    one with the smallest label and vector counts. Scores must fit in 64 bits.
    Other columns are not looked at. No anchors, or an empty table, give no rows.
    """
    if min(positives, negatives) < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives are 1 or more, low and high in order")
    spark = vectors.sparkSession
    x = F.col(vector_column).cast("array<long>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    rows = _shared.materialize(rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*"), "vectors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = _space(rows)
    if found is None:
        return spark.createDataFrame([], schema)
    space, n = found
    blocks = _blocks(rows.select("id", "label", "x"), space)
    radii = _shared.materialize(_radii(blocks, space, positives + 1), "radii")
    anchors = rows.where("anchor").select("id", "label", "x")
    parts = max(1, min(1 << 14, n // (64 * BLOCK)))  # some 64 blocks a part, were all sent

    near = _shared.materialize(_cells_for_positives(anchors, radii, space, _grouping(anchors, space)), "anchors")
    best = _shared.materialize(_first(_joined(near, blocks, space, parts, _positives(positives), 1), ["anchor"], positives), "positives")

    bands = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # ``positives`` of them at most
    bands = bands.select("anchor", F.col("p.score").alias("scores"))
    asked = near.drop("cells").join(bands, F.col("id") == F.col("anchor")).drop("anchor")
    reach = radii.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()  # MOST_PIVOTS of them at most
    import numpy as np

    bounds = tuple(np.array([r[c] for r in reach]) for c in ("cell", "least", "most"))
    asked = _shared.materialize(_cells_for_negatives(asked, bounds, space, low, high), "asked")
    mined = _first(_joined(asked, blocks, space, parts, _negatives(negatives), positives), ["anchor", "slot"], negatives)
    p = best.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(p, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _grouping(anchors: DataFrame, space: Space):
    """Numbers of anchors' groups from their cells and ids: cells next to each other share a group of some GROUP anchors, a larger cell is split."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cell = space.distances(_matrix(batch.column("x"), space.dim), True).argmin(1)
                at, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "n": n})

    sizes = np.zeros(len(space.pivots), np.int64)
    for r in anchors.select("x").transform(_shared.in_arrow, count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # MOST_PIVOTS at most
        sizes[r["cell"]] = r["n"]
    left, at, chain = set(range(1, len(sizes))), 0, [0]
    while left:  # each cell's follower is the nearest one left
        at = min(left, key=lambda c: float(((space.pivots[c] - space.pivots[at]) ** 2).sum()))
        left.discard(at)
        chain.append(at)
    first, pieces, now, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c in chain:
        if held and held + sizes[c] > GROUP:
            now, held = now + 1, 0
        first[c], pieces[c] = now, max(1, -(-int(sizes[c]) // GROUP))
        held += int(sizes[c])
        if pieces[c] > 1:
            now, held = now + int(pieces[c]), 0

    def groups(cells, ids):
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (first[cells] + (mixed.astype(np.int64) % pieces[cells])).astype(np.int32)

    return groups
