"""Small helpers that the operators share: tables put aside, membership filters, Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import _hadoop as hadoop
from ..sources.scratch import new_path

__all__ = ["SparkSession", "hadoop", "new_path"]
materialize, drop = scratch.put_aside, scratch.discard


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def merged(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffling both sides. Spark takes a table for small by its compressed files, and would send it, and all that is made of its rows, through the driver."""
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


#: A membership filter has 16 bits a key, 2**30 bits (128 MB) at most; beyond some 10**8 keys it lets more rows through, and loses none.
FEWEST_BITS, MOST_BITS = 16, 30


def filter_bits(keys: int) -> int:
    """The size of a filter for so many keys, as a power of two."""
    return min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(16 * keys + 1))))


def _bit_of(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << size)) + 1


def membership_filter(keys: DataFrame, column: str, size: int) -> DataFrame:
    """A one-hash Bloom filter of a key column with 2**size bits, as rows of 4 KB."""
    bit = _bit_of(F.col(column), size)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def mark_maybe(df: DataFrame, column: str, bits: DataFrame, size: int, flag: str = "__maybe") -> DataFrame:
    """Adds whether a row's key may be in the filter: true for every key that is, and for a few others.

    The broadcast side holds 2**MOST_BITS bits at most, however many keys it stands for.
    """
    b, w = unused(df, "__bucket"), unused(df, "__bits")
    bit = _bit_of(F.col(column), size)
    at = F.bitmap_bit_position(bit)
    byte = F.substring(F.col(w), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    isset = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
    sent = F.broadcast(bits.select(F.col("bucket").alias(b), F.col("bits").alias(w)))
    return df.withColumn(b, F.bitmap_bucket_number(bit)).join(sent, b, "left").withColumn(flag, F.coalesce(isset, F.lit(False))).drop(b, w)


def marked(df: DataFrame, column: str, keys: DataFrame, key: str, flag: str = "__maybe") -> DataFrame:
    """mark_maybe against a table of keys that was put aside, with a filter of its size."""
    size = filter_bits(keys.count())
    return mark_maybe(df, column, membership_filter(keys, key, size), size, flag)


def matching(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among the keys (in the column of the same name, put aside): none that is gets lost."""
    flag = unused(df, "__maybe")
    return marked(df, column, keys, column, flag).where(F.col(flag)).drop(flag)


def without(df: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose key is not among ``keys`` (put aside): an anti join that moves only rows that may be dropped."""
    names = df.columns
    k, flag = unused(df, "__key"), unused(df, "__maybe")
    found = marked(df.withColumn(k, key), k, keys, column, flag)
    stay = found.where(~F.col(flag)).select(*[found[f"`{c}`"] for c in names])
    rest = found.where(F.col(flag)).join(keys.select(F.col(column).alias(k)), k, "left_anti")
    return stay.unionByName(rest.select(*[rest[f"`{c}`"] for c in names]))


def row_slices(batch, column: str, most: int = 6_000_000):
    """Slices of an Arrow batch holding about ``most`` bytes of a string column each; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def per_process(key: str, make, family: str | None = None):
    """make(), once for each worker process. Tokenizers keep memory when they are freed, so a task must not make its own.

    Of a family a process holds one member; another takes its place.
    """
    import sys
    import types

    held = sys.modules.setdefault("_siltstone_process", types.ModuleType("_siltstone_process")).__dict__
    if key not in held:
        if family:
            held.pop(held.get(f"family {family}"), None)
            held[f"family {family}"] = key
        held[key] = make()
    return held[key]


#: Bytes of an Arrow batch that goes to Python: two tasks, their buffers and copies stay well inside an executor.
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, and memory that goes back to the system at a task's end, as worker processes live on."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28)).rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        per_process("malloc", _tidy_malloc)
        yield from function(batches)
        _give_back_memory()

    return df.mapInArrow(run, schema)


def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def _tidy_malloc() -> bool:
    """Blocks over a megabyte are mapped one by one and unmapped when freed; Arrow's go the same way."""
    import pyarrow as pa

    libc = _libc()
    if libc is not None and hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
        pa.set_memory_pool(pa.system_memory_pool())
    return True


def _give_back_memory() -> None:
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
