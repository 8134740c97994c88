"""Harmonic packing of token sequences into a fixed capacity.

A piece of length r is of class k when k such pieces fill a sequence but k + 1
do not: capacity/(k+1) < r <= capacity/k. Each class fills its own sequences
with k pieces, by rank alone, so workers need not look at each other's bins.

What a class would waste is cut off first: documents give whole sequences, and
a rest that would leave too much of its share of a sequence empty is cut at
the next reciprocal (capacity/(k+1), of which k+1 fill a sequence), and so on.
The pieces that fill no sequence of their class, fewer than k for a class and
so a bounded number in all, go into sequences by best fit, largest first.

Ranks come from positions in sorted files and a count per file and class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _shared
from .tokens import WordEncoder

#: From here on classes go in steps of an eighth, so that there are few.
FINE = 32


def size_class(length: int, capacity: int) -> int:
    """How many pieces of this length a sequence takes, rounded down to one of a few counts."""
    k = capacity // length
    if k <= FINE:
        return k
    step = 1 << max(0, k.bit_length() - 4)
    return k // step * step


def class_counts(capacity: int) -> list[int]:
    return sorted({size_class(r, capacity) for r in range(1, capacity + 1)})


def cuts(tokens: int, capacity: int, slack: float = 0.02) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces; they cover it without gaps.

    A rest is cut on while a piece of it would waste more than ``slack`` of its
    share of a sequence and of the document's own tokens, down to short rests.
    """
    full, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity, 1) for i in range(full)]
    at = full * capacity
    while rest:
        fits = capacity // rest
        if fits > FINE or capacity / fits - rest <= slack * max(capacity / fits, tokens):
            out.append((at, rest, size_class(rest, capacity)))
            break
        cut = capacity // (fits + 1)
        out.append((at, cut, size_class(cut, capacity)))
        at, rest = at + cut, rest - cut
    return out


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("class", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_column: str, text_column: str, slack: float, with_ids: bool) -> DataFrame:
    fields = [f for f in PIECES.fields if with_ids or f.name != "ids"]

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = _shared.per_process(f"words {tokenizer}", lambda: WordEncoder(tokenizer))
        for batch in batches:
            for rows in _shared.row_slices(batch, "text", 5_000_000):
                ids, offsets = encoder.encode(rows.column("text"))
                doc, start, length, crc, total, kind = [], [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    n = hi - lo
                    for s, m, k in cuts(n, capacity, slack):
                        doc.append(i), start.append(s), length.append(m), total.append(n), kind.append(k)
                        crc.append(zlib.crc32(ids[lo + s : lo + s + m]))
                columns = [rows.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(kind, pa.int32())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _shared.text_of(text_column).alias("text"))
    return rows.transform(_shared.in_arrow, cut, T.StructType(fields))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text", slack: float = 0.02, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id of every document, the end id included, lies in one piece. Null
    texts count as empty and give the end id alone; repeated rows and ids are
    packed as they come; other columns are not looked at; an empty table gives
    no pieces. Sequences are to be padded to the capacity by the reader.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, capacity, id_column, text_column, slack, with_ids)
    path = _shared.new_path(spark, "pieces")
    pieces.sortWithinPartitions("class").write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(pieces.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))

    counts = placed.groupBy("file", "class").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("class").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    offsets = counts.select("file", "class", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("class_n"))
    offsets = _shared.materialize(offsets, "offsets")
    per_class = {r["class"]: r["n"] for r in offsets.groupBy("class").agg(F.max("class_n").alias("n")).collect()}  # a few dozen classes
    base, bases = 0, {}
    for k in sorted(per_class):
        bases[k] = base
        base += per_class[k] // k
    first_of = F.create_map(*[x for k, b in bases.items() for x in (F.lit(k), F.lit(b).cast("long"))]) if bases else F.create_map(F.lit(0), F.lit(0).cast("long"))

    ranked = placed.join(offsets, ["file", "class"]).withColumn("rank", F.col("at") + F.col("shift")).drop("file", "at", "shift")
    full = F.col("rank") < F.col("class_n") - F.col("class_n") % F.col("class")
    carried = ["ids"] if with_ids else []
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *carried]
    binned = ranked.where(full).withColumn("sequence_id", first_of[F.col("class")] + F.floor(F.col("rank") / F.col("class")))
    alone = binned.where("class = 1").withColumn("offset", F.lit(0).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # at most `class` rows
    shared = binned.where("class > 1").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = _best_fit(ranked.where(~full), capacity, base)
    return alone.select(columns).unionByName(shared.select(columns)).unionByName(rest.select(columns))


def _best_fit(rest: DataFrame, capacity: int, base: int) -> DataFrame:
    """The pieces that fill no sequence of their class, largest first into sequences that have room.

    Fewer than k pieces of a class k are left, so their number has a bound that
    depends on the capacity alone; one task takes them all.
    """
    schema = T.StructType([f for f in rest.schema.fields if f.name not in ("class", "class_n", "rank")] + [T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def lay(batches):
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.take(np.lexsort((table["rank"].to_numpy(), -table["length"].to_numpy())))
        room, where, offset = [], [], []
        for n in table["length"].to_pylist():
            fits = [i for i, r in enumerate(room) if r >= n]
            i = min(fits, key=room.__getitem__) if fits else len(room)
            if i == len(room):
                room.append(capacity)
            where.append(base + i)
            offset.append(capacity - room[i])
            room[i] -= n
        out = table.drop_columns(["class", "class_n", "rank"]).append_column("sequence_id", pa.array(where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from out.select(schema.names).to_batches()

    return rest.repartition(1).transform(_shared.in_arrow, lay, schema)
