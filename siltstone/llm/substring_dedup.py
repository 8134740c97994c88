"""Substring dedup: repeated word windows, found through a count-min prefilter.

Pass 1 counts the window hashes of each partition in the cells of a count-min
sketch (two rows of 2**29 cells at most). Partition sketches are sent as sorted
cell numbers, a byte or so a window, and merged by range of cells into one bit
a cell: counted twice or more. Counts are over-, never underestimated.

Pass 2 reads the texts again and keeps the windows whose cells are all set:
every window that repeats, and a few others. Those are grouped exactly, by 80
bits of hash, first within each task (only a task's first document of a window
is sent on, so a window in very many documents costs a row per task), then by
range of hash. What comes back are spans of words, dealt by document.

Pass 3 joins the spans to the texts they belong to; other texts do not move.

The sketch is broadcast; its size has a fixed bound (128 MB) and follows the
input below it. Beyond some 10**9 windows it fills up and lets more windows
through to the exact grouping, which stays right, at the price of shuffle.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared
from ._blobs import pack_sorted, unpack_sorted

MAX_CELL_BITS = 29
ROWS = 2
#: Cells of a row are merged in this many ranges.
RANGES = 64


def hash_words(texts):
    """64-bit hash of every word of an Arrow string array, each distinct word hashed once, and the offsets of the texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    parts = pc.ascii_split_whitespace(texts)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    names, digest = coded.dictionary.cast(pa.binary()), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w.as_buffer()) for w in names), np.uint64, len(names))
    real = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)  # a text that starts or ends with white space gives empty words
    index = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int32)
    bounds = bounds - bounds[0]
    if not real.all():
        keep = real[index]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        index = index[keep]
    return (hashes[index] if len(index) else np.empty(0, np.uint64)), bounds


def window_hashes(words, bounds, width: int):
    """Two hashes of every window of ``width`` words inside one text, its text's number and its first word's place there."""
    import numpy as np

    sizes = np.diff(bounds)
    n = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), n)
    place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    if not len(doc):
        return np.empty(0, np.uint64), np.empty(0, np.uint32), doc, place
    first = bounds[:-1][doc] + place
    span = len(words) - width + 1

    def rolled(x, base):
        h = np.zeros(span, np.uint64)
        for i in range(width):
            h = h * np.uint64(base) + x[i : i + span]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h[first]

    other = (words ^ (words >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return rolled(words, 0x5851F42D4C957F2D), (rolled(other ^ (other >> np.uint64(27)), 0x2545F4914F6CDD1D) >> np.uint64(32)).astype(np.uint32), doc, place


def cells(h, row: int, bits: int):
    import numpy as np

    return ((h >> np.uint64(64 - bits)) if row == 0 else ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits))).astype(np.uint32)


def _deltas(sorted_ids) -> bytes:
    """Sorted distinct numbers below 2**32 as bytes: a gap under 255 takes one, any other 255 and four more."""
    import numpy as np

    gaps = np.diff(sorted_ids, prepend=0)
    wide = gaps >= 255
    short = np.minimum(gaps, 255).astype(np.uint8).tobytes()
    return len(gaps).to_bytes(4, "little") + short + gaps[wide].astype("<u4").tobytes()


def _undeltas(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", -1, 4 + n)
    return np.cumsum(gaps)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = _shared.text_of(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("id is not null")


def count_min(texts: DataFrame, width: int, bits: int) -> dict[int, bytes]:
    """By range of cells, compressed: one bit a cell, set if the windows counted there are two or more."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        pending, held = [], 0
        schema = pa.schema([("range", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
        span = 1 << max(0, bits - int(math.log2(RANGES)))

        def flush():
            h = np.concatenate(pending)
            out = []
            for row in range(ROWS):
                cell = cells(h, row, bits)
                cell.sort()
                new = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
                cell, times = cell[new[:-1]], np.diff(new)
                edges = np.searchsorted(cell, np.arange(0, (1 << bits) + span, span))
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        own, twice = cell[a:b].astype(np.int64) - k * span, times[a:b] > 1
                        out.append({"range": row * RANGES + k, "once": _deltas(own[~twice]), "more": _deltas(own[twice])})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for rows in _shared.row_slices(batch, "text", 4_000_000):
                h, _, _, _ = window_hashes(*hash_words(rows.column("text")), width)
                pending.append(h)
                held += len(h)
                if held > 6_000_000:
                    yield flush()
                    pending, held = [], 0
        if held:
            yield flush()

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        span = 1 << max(0, bits - int(math.log2(RANGES)))
        counts: dict[int, object] = {}
        for batch in batches:
            for r in batch.to_pylist():
                count = counts.setdefault(r["range"], np.zeros(span, np.uint8))
                for ids, add in ((_undeltas(r["once"]), 1), (_undeltas(r["more"]), 2)):
                    count[ids] = np.minimum(count[ids], 250) + add
        out = [{"range": k, "bits": zlib.compress(np.packbits(c > 1).tobytes(), 1)} for k, c in counts.items()]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), ("bits", pa.binary())]))

    partial = texts.select("text").transform(_shared.in_arrow, sketch, "range int, once binary, more binary")
    merged = partial.repartition("range").transform(_shared.in_arrow, merge, "range int, bits binary")
    return {r["range"]: bytes(r["bits"]) for r in merged.toLocalIterator()}  # ROWS * 2**bits / 8 bytes at most, compressed


def bitmaps(packed: dict[int, bytes], bits: int) -> list:
    """The sketch's rows, a bit a cell."""
    import numpy as np

    size = max(1, (1 << bits) // 8 // RANGES)
    out = [np.zeros(size * RANGES, np.uint8) for _ in range(ROWS)]
    for k, data in packed.items():
        out[k // RANGES][k % RANGES * size : (k % RANGES + 1) * size] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def repeated_spans(texts: DataFrame, width: int, bits: int, heavy, shards: int) -> DataFrame:
    """id, text_key, spans: words of a text that lie in a window which also starts in a document with a smaller id (begins and ends, merged).

    heavy: the broadcast sketch, compressed.
    """
    wire = "shard int, kind int, docs binary, starts binary, places binary, hashes binary, more binary"

    def intervals(doc, place):
        """Window starts, sorted by document and place, as merged word intervals: document, begin, end."""
        import numpy as np

        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=0) > width))
        last = np.append(new[1:], len(place)) - 1
        return doc[new], place[new], place[last] + width

    def found(doc, place, ids, keys, spread):
        """Rows of intervals (kind 1), dealt by document."""
        import numpy as np

        order = np.lexsort((place, doc))
        d, begin, end = intervals(doc[order], place[order])
        bucket = (ids[d] ^ keys[d] ^ (keys[d] >> 32)) % spread
        order = np.lexsort((begin, d, bucket))
        d, begin, end, bucket = d[order], begin[order], end[order], bucket[order]
        new = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for x, y in zip(new, new[1:]):
            used, counts = np.unique(d[x:y], return_counts=True)
            yield {"shard": int(bucket[x]), "kind": 1, "docs": np.stack([ids[used], keys[used]]).astype("<i8").tobytes(), "starts": counts.astype("<u4").tobytes(), "places": np.stack([begin[x:y], end[x:y]]).astype("<u4").tobytes()}

    def grouped(h, more, doc, place, ids):
        """Sorted by window and document; whether a window's document has a larger id than its first."""
        import numpy as np

        order = np.lexsort((ids[doc], more, h))
        h, more, doc, place = h[order], more[order], doc[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        return h, more, doc, place, ids[doc] > ids[doc[start]]

    def schema():
        import pyarrow as pa

        return pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "starts", "places", "hashes", "more"))])

    def candidates(batches):
        import numpy as np
        import pyarrow as pa

        heavy_cells = bitmaps(heavy.value, bits)
        held, count, ids, keys, n_docs = [], 0, [], [], 0

        def flush():
            h, more, doc, place = (np.concatenate(x) for x in zip(*held))
            all_ids, all_keys = np.concatenate(ids), np.concatenate(keys)
            h, more, doc, place, later = grouped(h, more, doc, place, all_ids)
            out = list(found(doc[later], place[later], all_ids, all_keys, shards)) if later.any() else []
            send = ~later  # every place of a window in its first document here
            h, more, doc, place = h[send], more[send], doc[send], place[send]
            shard = (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((place, doc, shard))
            h, more, doc, place, shard = h[order], more[order], doc[order], place[order], shard[order]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            length = np.zeros(len(all_ids) + 1, np.int64)
            np.maximum.at(length, doc + 1, place + 1)
            base = np.cumsum(length)  # places of all documents laid end to end
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    used = np.unique(doc[a:b])
                    out.append({"shard": k, "kind": 0, "docs": np.stack([all_ids[used], all_keys[used]]).astype("<i8").tobytes(), "starts": pack_sorted(base[used]), "places": _deltas(base[doc[a:b]] + place[a:b] + 1), "hashes": h[a:b].tobytes(), "more": more[a:b].astype("<u2").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=schema())

        for batch in batches:
            for rows in _shared.row_slices(batch, "text", 4_000_000):
                h, more, doc, place = window_hashes(*hash_words(rows.column("text")), width)
                hit = np.ones(len(h), bool)
                for row in range(ROWS):
                    cell = cells(h, row, bits)
                    hit &= (heavy_cells[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                held.append((h[hit], more[hit].astype(np.uint16), (doc[hit] + n_docs).astype(np.int32), place[hit].astype(np.int32)))
                ids.append(rows.column("id").to_numpy())
                keys.append(rows.column("text_key").to_numpy())
                n_docs += rows.num_rows
                count += int(hit.sum())
                if count > 2_000_000:
                    yield from flush()
                    held, count, ids, keys, n_docs = [], 0, [], [], 0
        if count:
            yield from flush()

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        held, docs, n, shard = [], [], 0, None

        def finish():
            h, more, doc, place = (np.concatenate(x) for x in zip(*held))
            (ids, keys), same = np.unique(np.concatenate(docs, axis=1), axis=1, return_inverse=True)  # a document may be in several rows
            h, more, doc, place, later = grouped(h, more, same.reshape(-1)[doc], place, ids)
            if later.any():
                yield pa.RecordBatch.from_pylist(list(found(doc[later], place[later], ids, keys, shards)), schema=schema())

        for batch in batches:
            through = batch.filter(pa.array(batch.column("kind").to_numpy() == 1))
            if through.num_rows:
                yield through
            for i in np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist():
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held and r["shard"] != shard:
                    yield from finish()
                    held, docs, n = [], [], 0
                shard = r["shard"]
                table, starts, at = np.frombuffer(r["docs"], "<i8").reshape(2, -1), unpack_sorted(r["starts"]), _undeltas(r["places"]) - 1
                doc = np.searchsorted(starts, at, "right") - 1
                held.append((np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["more"], np.uint16), doc + n, at - starts[doc]))
                docs.append(table)
                n += table.shape[1]
        if held:
            yield from finish()

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        docs, begins, ends, which, n = [], [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("docs", "starts", "places")}
                table, pair = np.frombuffer(r["docs"], "<i8").reshape(2, -1), np.frombuffer(r["places"], "<u4").reshape(2, -1)
                which.append(np.repeat(np.arange(table.shape[1]) + n, np.frombuffer(r["starts"], "<u4")))
                docs.append(table), begins.append(pair[0]), ends.append(pair[1])
                n += table.shape[1]
        if not docs:
            return
        (ids, keys), same = np.unique(np.concatenate(docs, axis=1), axis=1, return_inverse=True)
        doc, begin, end = same.reshape(-1)[np.concatenate(which)], np.concatenate(begins).astype(np.int64), np.concatenate(ends).astype(np.int64)
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        reach = np.maximum.accumulate(end + (doc << 32)) & 0xFFFFFFFF
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        spans = np.stack([begin[first], reach[last]], axis=1).astype("<u4")
        cut = np.append(np.flatnonzero(np.diff(doc[first], prepend=-1)), len(first))
        schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])
        for lo in range(0, len(cut) - 1, 20_000):
            own = cut[lo : lo + 20_001]
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[first[own[:-1]]]]), pa.array(keys[doc[first[own[:-1]]]]), pa.array([spans[a:b].tobytes() for a, b in zip(own, own[1:])], pa.binary())], schema=schema)

    dealt = texts.transform(_shared.in_arrow, candidates, wire).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.transform(_shared.in_arrow, settle, wire).select("shard", "docs", "starts", "places").repartition(shards, "shard").transform(_shared.in_arrow, gather, "id long, text_key long, spans binary")


def substring_dedup(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text", max_cell_bits: int = MAX_CELL_BITS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, spans (word intervals removed), kept_text.

    Removed is each word covered by a window of ``width`` words whose sequence
    also starts in a document with a smaller id, judged on the input. Words are
    runs of anything but ASCII white space. Null texts have no words. Rows with
    a null id have no order: they lose nothing and make others lose nothing.
    Rows with equal ids do not count as smaller; each is judged by its own
    text. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_column, text_column)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0)).alias("n")).first()["n"]
    bits = min(max_cell_bits, max(13, math.ceil(math.log2(2 * (size // 6 + 1)))))
    sketch = spark.sparkContext.broadcast(count_min(texts, width, bits))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 25)  # 32 MB of text each at most: 130 MB of windows if all repeat
    spans = repeated_spans(texts, width, bits, sketch, shards)
    found = _shared.materialize(spans.withColumn("__doc", F.xxhash64("id", "text_key")), "spans")
    sketch.unpersist()

    text = _shared.text_of(text_column)
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key")).withColumn("__doc", F.xxhash64(F.col("id").cast("long"), F.col("text_key")))
    marked = _shared.marked(keyed, "__doc", found, "__doc")
    wanted = found.select(F.col("__doc").alias("d"), F.col("id").alias("i"), F.col("text_key").alias("k"), "spans")
    joined = marked.where("__maybe").join(wanted, (F.col("__doc") == F.col("d")) & (F.col("id") == F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    rows = marked.where(~F.col("__maybe")).select("id", "text", F.lit(None).cast("binary").alias("spans")).unionByName(joined.select("id", "text", "spans"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        result = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])
        for batch in batches:
            out = []
            texts, spans = batch.column("text").cast(pa.binary()), batch.column("spans")
            for i in range(batch.num_rows):
                words, blob = texts[i].as_py().split(), spans[i].as_py()
                merged = np.frombuffer(blob or b"", "<u4").reshape(-1, 2).tolist()
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"begin": a, "end": b} for a, b in merged], "kept_text": b" ".join(kept).decode()})
            made = pa.RecordBatch.from_pylist(out, schema=result)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.columns], ["id", *result.names])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *T._parse_datatype_string("n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept_text string").fields])
    return rows.transform(_shared.in_arrow, cut, schema)
