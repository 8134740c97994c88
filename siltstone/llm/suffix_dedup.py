"""Suffix-array dedup: prefix doubling over positions that the text itself picks.

Removed is every byte under a string of ``threshold`` bytes that starts at two
places or more. To rank all positions, a row a byte, would move many times the
corpus. So each window of ``threshold`` bytes is stood for by one position
inside it, its anchor: of the first ``width`` places in the window, the one
whose next ``threshold + 1 - width`` bytes have the smallest hash. Equal windows
have their anchors at equal places, and neighbouring windows mostly share one,
so there is an anchor every 64 bytes or so.

Spark sorts (rank, position) pairs of the anchors, with ranks of strings of
growing length. The first rank is that of the anchor's own bytes: positions
with a rank of their own drop out. The second is that of everything that the
anchor's windows cover: positions that share it are settled, all their windows
repeat, and one of them goes on for all. The others differ somewhere within
``width`` places. Their windows are dealt to blocks of half as many places
again and again, and with each halving the part that all windows of a block
share grows: 73, 137, 169, 185, ... 200 bytes. Each round ranks that part and
the whole once more. Positions go once they are alone with a rank or their
windows are settled; at the latest at ``threshold`` bytes. Ranks with few
positions needn't wait for further rounds: they meet in one task, which sorts
their windows.

A rank is a name of 64 bits, a settled position one of 128 (two hashes of
independent bases), a window in the last sort and a text 128.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared

#: Bytes that are hashed at once; longer texts are cut, with as much overlap as a window needs.
PIECE = 1 << 20
#: Ranks with so many positions at most are settled in one task: 2,048 contexts of under 330 bytes.
FEW = 2048
#: Odd multipliers of the two hashes.
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_WHOLE = (1 << 31) - 1


def span_of(threshold: int) -> int:
    """The places from which a window's anchor is picked: a power of two, and two thirds of a window at most."""
    if not 1 <= threshold < PIECE:
        raise ValueError("a string has a byte or more, and fits in a piece")
    return 1 << max(0, (2 * threshold // 3).bit_length() - 1)


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _powers(base: int, size: int):
    """Powers of a base and of its inverse, modulo 2**64."""
    import numpy as np

    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


class Hashes:
    """Hashes of all substrings of an array of bytes, under one of the two bases."""

    def __init__(self, data, which: int) -> None:
        import numpy as np

        size = max(2 * PIECE, 1 << len(data).bit_length())  # one size, so that a worker keeps one table for each base
        power, self.back = _powers(BASES[which], size)
        letters = _mixed((np.arange(1, 257, dtype=np.uint64) + np.uint64(which * 1000)) * np.uint64(0x9E3779B97F4A7C15))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * power[: len(data)], out=self.sums[1:])

    def of(self, at, length):
        """Of the substrings at these places, with this length or these lengths."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at])

    def all(self, length: int):
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else self.sums[:0]


def pieces(texts, threshold: int, most: int = PIECE):
    """Of an Arrow binary array: bytes of some texts or part of one, with (text, first byte) and the bounds of each piece in them."""
    import numpy as np

    held, own, at = [], [], 0
    step = most - threshold + 1
    for i, text in enumerate(texts):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        for lo in range(0, max(len(data) - threshold + 1, 0), step):
            part = data[lo : lo + most]
            if at + len(part) > most:
                yield np.concatenate(held), own
                held, own, at = [], [], 0
            own.append((i, lo, at, at + len(part)))
            held.append(part)
            at += len(part)
    if held:
        yield np.concatenate(held), own


def anchors(data, bounds, threshold: int, width: int, first):
    """anchor, first and last window of each stretch of windows with one anchor, inside the pieces.

    first: the hashes of the first base. Ties go to the leftmost place.
    """
    import numpy as np

    order = (first.all(threshold + 1 - width) & ~np.uint64(PIECE - 1)) | np.arange(len(data) - threshold + width, dtype=np.uint64)
    step = 1
    while step < width:
        order = np.minimum(order[:-step], order[step:])
        step *= 2
    valid = np.zeros(len(order), bool)
    for a, b in bounds:
        valid[a : b - threshold + 1] = True
    window = np.flatnonzero(valid)
    at = (order[window] & np.uint64(PIECE - 1)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], window[new], window[np.append(new[1:], len(at)) - 1]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text (null: empty) and its name of 128 bits."""
    text = _shared.text_of(text_column)
    return docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def _positions(texts: DataFrame, threshold: int, width: int, whole: bool, piece: int) -> DataFrame:
    """A row for each anchor of each different text of a task: its rank and, if ``whole``, s (name of all its windows cover), k1, k2, at, before, after (its windows start before to after bytes before it)."""
    names = ["rank", "s", "k1", "k2", "at", "before", "after"] if whole else ["rank"]

    def find(batches):
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        seen = set()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            fresh = [i for i, k in enumerate(zip(k1.tolist(), k2.tolist())) if k not in seen and not seen.add(k)]
            rows = batch.take(pa.array(fresh, pa.int32()))
            k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
            for data, own in pieces(rows.column("text").cast(pa.binary()), threshold, piece):
                hashes = Hashes(data, 0)
                at, lo, hi = anchors(data, [(a, b) for _, _, a, b in own], threshold, width, hashes)
                columns = [hashes.of(at, threshold + 1 - width).view(np.int64)]
                if whole:
                    text, start, begin, _ = (np.array(c) for c in zip(*own))
                    of = np.searchsorted(begin, lo, "right") - 1
                    s = Hashes(data, 1).of(lo, hi - lo + threshold)
                    columns += [s.view(np.int64), k1[text[of]], k2[text[of]], at - begin[of] + start[of], at - lo, at - hi]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = ", ".join(f"{n} {'long' if i < 4 else 'int'}" for i, n in enumerate(names))
    return texts.select("k1", "k2", "text").transform(_shared.in_arrow, find, schema)


_PLACE = ("k1", "k2", "at", "before", "after")


def _settle(rows: DataFrame, threshold: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans, left) of a round. rows, put aside: rank, s and places, with ``context`` after the first round.

    spans: what positions cover that share rank and s. left: a position for
    each s of the ranks that have several, and ``kinds``, how many.
    """
    place = [c for c in rows.columns if c not in ("rank", "s")]
    classes = _shared.materialize(rows.groupBy("rank", "s").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("place")), f"{name}-classes")
    shared = classes.where("n > 1").select("rank", "s")
    spans = _shared.materialize(_spans(rows.select("rank", "s", *_PLACE).join(shared, ["rank", "s"]), threshold), f"{name}-spans")
    several = classes.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1")
    left = _shared.materialize(classes.select("rank", "place").join(several, "rank").select("rank", "kinds", "place.*"), f"{name}-left")
    _shared.drop(classes)
    return spans, left


def _spans(rows: DataFrame, threshold: int) -> DataFrame:
    return rows.select("k1", "k2", (F.col("at") - F.col("before")).alias("begin"), (F.col("at") - F.col("after") + threshold).alias("end"))


def _contexts(texts: DataFrame, left: DataFrame, threshold: int) -> DataFrame:
    """left with ``context``: the bytes that the windows of each position cover. A text comes once, however many rows have it."""
    asked = _shared.materialize(left.groupBy("k1", "k2").agg(F.collect_list(F.struct("rank", "kinds", "at", "before", "after")).alias("asked")), "asked")  # of one text
    wanted = _shared.matching(texts.select("k1", "k2", "text"), "k1", asked).groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                asked, text = batch.column("asked").slice(i, 1), batch.column("text")[i].as_buffer().to_pybytes()
                rank, kinds, at, before, after = (f.to_numpy() for f in asked.flatten().flatten())
                for lo in range(0, len(at), 10_000):
                    own = slice(lo, lo + 10_000)
                    context = [text[a - b : a - c + threshold] for a, b, c in zip(at[own].tolist(), before[own].tolist(), after[own].tolist())]
                    n = len(context)
                    yield pa.RecordBatch.from_arrays([pa.array(rank[own]), pa.array(kinds[own]), *[pa.array(np.repeat(batch.column(k)[i].as_py(), n)) for k in ("k1", "k2")], *[pa.array(c[own]) for c in (at, before, after)], pa.array(context, pa.binary())], ["rank", "kinds", *_PLACE, "context"])

    joined = wanted.join(asked, ["k1", "k2"])
    return joined.select("k1", "k2", "text", "asked").transform(_shared.in_arrow, cut, "rank long, kinds long, k1 long, k2 long, at int, before int, after int, context binary")


def _repeated_windows(rows: DataFrame, threshold: int) -> DataFrame:
    """Spans of windows that repeat among the positions of a rank; a rank's positions meet in one task, FEW of them at most."""

    def sort(batches):
        import numpy as np
        import pyarrow as pa

        held, count = [], 0

        def settle():
            rank, k1, k2, at, before, after = (np.concatenate(c) for c in zip(*(h[:-1] for h in held)))
            n = before - after + 1  # windows of each
            data = np.frombuffer(b"".join(c for h in held for c in h[-1]), np.uint8)
            start = np.cumsum(n + threshold - 1) - (n + threshold - 1)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            one, two = (Hashes(data, k).of(start[row] + place, threshold) for k in (0, 1))
            order = np.lexsort((two, one))
            same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
            hit = np.zeros(len(row), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            at_hit = np.flatnonzero(hit)
            if not len(at_hit):
                return
            new = np.flatnonzero((np.diff(at_hit, prepend=-2) != 1) | (np.diff(row[at_hit], prepend=-1) != 0))
            first, last = at_hit[new], at_hit[np.append(new[1:], len(at_hit)) - 1]
            own, base = row[first], (at - before)[row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(base + place[first], pa.int32()), pa.array(base + place[last] + threshold, pa.int32())], ["k1", "k2", "begin", "end"])

        for batch in (b.slice(lo, FEW) for b in batches for lo in range(0, b.num_rows, FEW)):
            columns = [batch.column(c).to_numpy() for c in ("rank", "k1", "k2", "at", "before", "after")]
            context = batch.column("context").to_pylist()
            if count > FEW:  # up to the first row of another rank
                ends = np.flatnonzero(columns[0] != held[-1][0][-1])
                cut = int(ends[0]) if len(ends) else len(context)
                if cut:
                    held.append((*[c[:cut] for c in columns], context[:cut]))
                if cut < len(context):
                    yield from settle()
                    held, count = [], 0
                columns, context = [c[cut:] for c in columns], context[cut:]
            if context:
                held.append((*columns, context))
                count += len(context)
        if held:
            yield from settle()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.drop("kinds").repartition(n, "rank").sortWithinPartitions("rank").transform(_shared.in_arrow, sort, "k1 long, k2 long, begin int, end int")


def _halved(rows: DataFrame, threshold: int, size: int) -> DataFrame:
    """The positions' windows in blocks of ``size`` places: the rank of what all windows of a block share, and s of what these cover."""

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (b.slice(lo, FEW) for b in batches for lo in range(0, b.num_rows, FEW)):
            k1, k2, at, before, after = (batch.column(c).to_numpy() for c in _PLACE)
            first, last = after // size, before // size
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            high, low = np.minimum(before[row], (block + 1) * size - 1), np.maximum(after[row], block * size)
            contexts = batch.column("context").to_pylist()
            own = [contexts[r][b - h : b - l + threshold] for r, b, h, l in zip(row.tolist(), before[row].tolist(), high.tolist(), low.tolist())]
            data = np.frombuffer(b"".join(contexts), np.uint8)
            start = np.cumsum(before - after + threshold) - (before - after + threshold)
            anchor = start[row] + before[row]  # where the anchor stands in the data
            rank = Hashes(data, 0).of(anchor - block * size, threshold + 1 - size)
            rank = _mixed(rank + block.astype(np.uint64) * np.uint64(BASES[1])).view(np.int64)
            s = Hashes(data, 1).of(anchor - high, high - low + threshold).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rank, s, k1[row], k2[row])] + [pa.array(c, pa.int32()) for c in (at[row], high, low)] + [pa.array(own, pa.binary())], ["rank", "s", *_PLACE, "context"])

    return rows.transform(_shared.in_arrow, deal, "rank long, s long, k1 long, k2 long, at int, before int, after int, context binary")


def repeated_spans(texts: DataFrame, threshold: int, few: int = FEW, piece: int = PIECE) -> list[DataFrame]:
    """Tables of k1, k2, begin, end: bytes of a text under strings that repeat. They overlap. texts: k1, k2, text."""
    width = span_of(threshold)
    long = texts.where(F.octet_length("text") >= threshold)
    copies = long.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(0).alias("begin"), F.lit(_WHOLE).alias("end"))
    out = [_shared.materialize(copies, "copies")]
    ranks = _shared.materialize(_positions(long, threshold, width, False, piece).groupBy("rank").count().where("count > 1").select("rank"), "ranks")
    rows = _shared.materialize(_shared.matching(_positions(long, threshold, width, True, piece), "rank", ranks), "positions")
    _shared.drop(ranks)
    spans, left = _settle(rows, threshold, "whole")
    _shared.drop(rows)
    out.append(spans)
    contexts = _contexts(long, left.where(F.col("kinds") <= few), threshold)
    out.append(_shared.materialize(_repeated_windows(contexts, threshold), "few"))
    many = left.where(F.col("kinds") > few)
    if not many.isEmpty():
        many = _shared.materialize(_contexts(long, many, threshold), "many")
        while width > 1 and not many.isEmpty():
            width //= 2
            rows = _shared.materialize(_halved(many, threshold, width), "halved")
            spans, left = _settle(rows, threshold, "halved")
            _shared.drop(many, rows)
            out += [spans, _shared.materialize(_repeated_windows(left.where(F.col("kinds") <= few), threshold), "few")]
            many = _shared.materialize(left.where(F.col("kinds") > few), "many")
            _shared.drop(left)
    return out


def suffix_dedup(docs: DataFrame, threshold: int = 200, id_column: str = "doc_id", text_column: str = "text", few: int = FEW, piece: int = PIECE) -> DataFrame:
    """One row per input row: id, n_bytes, spans (byte intervals removed, in order, apart from each other), kept (the bytes left, joined).

    Removed is each byte under a string of ``threshold`` bytes of the UTF-8 text
    that also starts anywhere else, in the same text or another row's, judged on
    the input; a cut may fall inside a character, so ``kept`` is binary. Null
    texts count as empty. Rows with equal texts, repeated rows among them, are
    copies of each other: each loses all, if it is long enough. Ids don't matter,
    be they null or repeated. Very long texts are worked on in pieces of
    ``piece`` bytes (PIECE at most), with equal results. Other columns are not looked at. An empty
    table gives no rows.
    """
    keyed = _keyed(docs, id_column, text_column)
    parts = repeated_spans(keyed.select("k1", "k2", "text"), threshold, few, piece)
    every = functools.reduce(DataFrame.unionByName, parts)
    found = every.groupBy("k1", "k2").agg(F.max(F.col("end") == _WHOLE).alias("whole"), F.collect_list(F.struct("begin", "end")).alias("x"))
    found = _shared.materialize(found.select("k1", "k2", "whole", F.when(~F.col("whole"), F.array_sort("x")).alias("x")), "found")
    _shared.drop(*parts)

    marked = _shared.marked(keyed, "k1", found, "k1")
    as_is = [F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"), F.col("text").cast("binary").alias("kept")]
    rest = marked.where(~F.col("__maybe")).select("id", *as_is)
    hit = marked.where("__maybe").select("id", "text", "k1", "k2").join(found, ["k1", "k2"], "left").select("id", "text", "whole", "x")

    def cut(batches):
        import pyarrow as pa

        schema = pa.schema([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
        for batch in batches:
            out = []
            for text, whole, x in zip(batch.column("text").cast(pa.binary()), batch.column("whole").to_pylist(), batch.column("x").to_pylist()):
                data = text.as_py()
                spans = [(0, len(data))] if whole else merged((s["begin"], s["end"]) for s in x or ())
                edges = [0, *(e for s in spans for e in s), len(data)]
                out.append({"n_bytes": len(data), "spans": [{"begin": a, "end": b} for a, b in spans], "kept": b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))})
            made = pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.columns], ["id", *schema.names])

    fields = T._parse_datatype_string("n_bytes long, spans array<struct<begin:int,end:int>>, kept binary").fields
    return rest.unionByName(hit.transform(_shared.in_arrow, cut, T.StructType([T.StructField("id", docs.schema[id_column].dataType), *fields])))


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order of their begins, with those that touch made one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
