"""Jump consistent hashing of stable keys to shards, and gapless slots.

No ring table: the shard follows from the key and the shard count alone, and
one more shard takes about 1/(n+1) of the keys, all into itself.

Slots need no shuffle of rows: each task writes its rows sorted by shard, and
the position in the file then gives the rank; only a count per file and shard
is gathered for the offsets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _shared


def jump_hash(keys, shards: int):
    """Shard of each 64-bit key (numpy), by Lamping and Veach's loop over whole arrays."""
    import numpy as np

    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = np.asarray(keys).astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    active, b, j = np.arange(len(key)), np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while len(active):
        b = j
        at[active] = b
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        j = ((b + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = j < shards
        active, key, j = active[live], key[live], j[live]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key; a null key counts as key 0."""
    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype("int32"))

    return shard(F.coalesce(key, F.lit(0)).cast("long"))


def assign_shards(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 (null: 8); slots run from 0 without
    gaps in every shard, repeated rows and ids included; grown_shard is the
    shard under one more shard. Null ids are placed as id 0. Other columns are
    not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = _shared.text_of(text_column)
    key = F.col(id_column)
    rows = docs.select(key.alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", jump_shard(F.col("id"), shards).alias("shard"), jump_shard(F.col("id"), shards + 1).alias("grown_shard"))
    path = _shared.new_path(spark, "shards")
    rows.sortWithinPartitions("shard", "id").write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = placed.groupBy("file", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(offsets, ["file", "shard"]).select("id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", pieces: int = 1) -> None:
    """Write whole rows as Parquet under ``shard=K`` folders; ``pieces`` files or more share a shard, so that none lands in a single task."""
    key = F.col(id_column)
    out = docs.withColumn("shard", jump_shard(key, shards))
    spread = F.pmod(F.xxhash64(*docs.columns), F.lit(pieces))
    out.repartition(shards * pieces, "shard", spread).write.partitionBy("shard").parquet(path)
