"""Exact dedup over a log-structured merge index of text digests.

* A *memtable* is one task's share of a batch. Flushing sorts it by digest and
  writes it to a run of level 0. Beside each run lies its filter: a Bloom filter
  as a small table, sized from the run's rows.
* A level that holds ``fanout`` runs is *compacted* into one sorted run of the
  next level: per digest the smallest rank (ranks run backwards under
  ``keep="largest"``), its row, and the row count. Spark combines on the map
  side, so a digest that holds a third of all rows costs one row per task.
* A *manifest* names the runs of each level. It is written anew, under a new
  number, after each flush and compaction, so an index can be opened again by
  its folder, and a run that a stop left half-written is in no manifest.
* A *lookup* tests a batch against each run's filter and joins what may be
  there with that run alone.
* *Hits* (digests with several rows) get byte verification: their texts are
  grouped as bytes under the digest. Unequal texts with one digest are split
  into classes of their own.

Native: DataFrame functions only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.sinks import write_document
from . import _shared


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class LsmIndex:
    """Digest -> surviving row, kept under one folder.

    ``flush`` appends a batch as sorted runs and compacts levels that are full,
    ``compact`` merges all runs into one, ``lookup`` finds what the index says
    of the digests of a batch. A folder that has a manifest is opened again.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType, keep: str = "smallest", fanout: int = 4) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        if fanout < 2:
            raise ValueError("a level takes 2 runs or more")
        self.spark, self.path, self.keep, self.fanout = spark, path.rstrip("/"), keep, fanout
        self.schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("id", id_type), T.StructField("row", T.StructType([T.StructField("batch", T.LongType()), T.StructField("n", T.LongType())])), T.StructField("n", T.LongType())])
        self.state: dict = {"version": 0, "made": 0, "batches": 0, "keep": keep, "levels": []}
        if numbers := self._manifests():
            self.state = json.loads("".join(r["value"] for r in spark.read.text(f"{self.path}/manifest-{max(numbers)}.json").collect()))
            if self.state["keep"] != keep:
                raise ValueError(f"the index keeps the {self.state['keep']} identifier")

    def _manifests(self) -> list[int]:
        fs, root = _shared.hadoop(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [int(n[len("manifest-") : -len(".json")]) for n in names if n.startswith("manifest-")]

    def _publish(self, levels: list[list[dict]], **changed: int) -> None:
        """Written aside, then renamed: a manifest is there whole or not at all."""
        self.state = self.state | changed | {"levels": levels, "version": self.state["version"] + 1}
        aside, name = f"{self.path}/_staged-{self.state['version']}", f"{self.path}/manifest-{self.state['version']}.json"
        write_document(self.spark, self.state, aside)
        fs, at = _shared.hadoop(self.spark, aside)
        if not fs.rename(at, _shared.hadoop(self.spark, name)[1]):
            raise OSError(f"{name} could not be written; does another process write to this index?")

    def _run(self, rows: DataFrame) -> dict:
        """A sorted run and its filter, not yet in the manifest."""
        name = f"run-{self.state['made']}"
        self.state["made"] += 1
        rows.sortWithinPartitions("digest").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        n = self.read({"name": name}).count()  # from footers
        bits = _shared.filter_bits(n)
        _shared.membership_filter(self.read({"name": name}), "digest", bits).write.parquet(f"{self.path}/{name}-filter")
        return {"name": name, "rows": n, "bits": bits}

    def read(self, run: dict) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{run['name']}")

    def flush(self, rows: DataFrame) -> None:
        """rows: digest, id, and row (the number of a row for good), or none to have one given."""
        number = F.col("row") if "row" in rows.columns else F.monotonically_increasing_id()
        batch = self.state["batches"]
        run = self._run(rows.select("digest", "id", F.struct(F.lit(batch).cast("long").alias("batch"), number.alias("n")).alias("row"), F.lit(1).cast("long").alias("n")))
        levels = [list(x) for x in self.state["levels"]] or [[]]
        levels[0].append(run)
        self._publish(levels, batches=batch + 1)
        at = 0
        while at < len(self.state["levels"]) and len(self.state["levels"][at]) >= self.fanout:
            self._merge(at, at)
            at += 1

    def _merge(self, first: int, last: int) -> None:
        """The runs of these levels as one run of the level after them."""
        levels = [list(x) for x in self.state["levels"]]
        merged = [r for level in levels[first : last + 1] for r in level]
        run = self._run(self.merged(merged))
        levels[first : last + 1] = [[] for _ in range(first, last + 1)]
        if last + 1 == len(levels):
            levels.append([])
        levels[last + 1].append(run)
        self._publish(levels)

    def runs(self) -> list[dict]:
        return [r for level in self.state["levels"] for r in level]

    def _none(self) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def entries(self, runs: list[dict]) -> DataFrame:
        out = self._none()
        for r in runs:
            out = out.unionByName(self.read(r))
        return out

    def merged(self, runs: list[dict]) -> DataFrame:
        """A row per digest of these runs: the identifier that stays, its row, and how many rows there are."""
        by, best = (F.min_by, F.min) if self.keep == "smallest" else (F.max_by, F.max)
        return self.entries(runs).groupBy("digest").agg(best("id").alias("id"), F.coalesce(by("row", "id"), F.min("row")).alias("row"), F.sum("n").alias("n"))

    def compact(self) -> DataFrame:
        """Everything as one sorted run: a row per digest."""
        runs = self.runs()
        if len(runs) > 1 or (runs and self.state["levels"][0]):
            self._merge(0, len(self.state["levels"]) - 1)
        return self.entries(self.runs())

    def lookup(self, batch: DataFrame) -> DataFrame:
        """digest, id, row, n of what the index holds of a batch's digests. A run is joined with what its filter lets through alone."""
        asked = batch.select("digest").distinct()
        found = self._none()
        for r in self.runs():
            bits = self.spark.read.parquet(f"{self.path}/{r['name']}-filter")
            maybe = _shared.mark_maybe(asked, "digest", bits, size=r["bits"]).where("__maybe").select("digest")
            found = found.unionByName(self.read(r).join(maybe, "digest", "left_semi").select(self.schema.names))
        by, best = (F.min_by, F.min) if self.keep == "smallest" else (F.max_by, F.max)
        return found.groupBy("digest").agg(best("id").alias("id"), F.coalesce(by("row", "id"), F.min("row")).alias("row"), F.sum("n").alias("n"))

    def hits(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (with a digest column) whose digest the index holds; their bytes are yet to be verified."""
        return batch.join(self.lookup(batch).select("digest"), "digest", "left_semi")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when their bytes are; null counts as empty. Of equal texts
    the row with the smallest (or largest) id stays; a null id loses to any
    other, and of rows with equal ids exactly one stays. Other columns are not
    looked at, so their names may be anything. An empty table gives no rows.

    Digests are taken once and come into the index in ``batches`` parts.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), _shared.text_of(text_column).alias("text"))
    source = source.withColumn("digest", digest(F.col("text")))
    id_type = docs.schema[id_column].dataType
    path = _shared.new_path(spark, "digests")
    number = F.monotonically_increasing_id()
    source.select("digest", "id", number.alias("row"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    index = LsmIndex(spark, _shared.new_path(spark, "lsm"), id_type, keep, fanout)
    for b in range(batches):
        index.flush(rows.where(F.col("batch") == b).select("digest", "id", "row"))
    level = index.compact().select("digest", "id", F.col("row.n").alias("row"), "n")
    several = level.where("n > 1")

    # byte verification: texts under each digest that was hit
    texts = _shared.matching(source.select("digest", "text"), "digest", several.select("digest"))
    texts = texts.groupBy("digest", "text").agg(F.count("*").alias("n"))
    collided = _shared.materialize(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collided")
    out = _annotate(rows, several, ["digest"])
    if not collided.isEmpty():
        apart = Window.partitionBy("digest").orderBy("text")
        doubtful = source.join(collided, "digest", "left_semi")
        classes = doubtful.select("digest", "text").distinct().withColumn("class", F.row_number().over(apart))
        doubtful = doubtful.join(classes, ["digest", "text"]).select("digest", "class", "id", F.monotonically_increasing_id().alias("row"))
        doubtful = _shared.materialize(doubtful, "split")
        by, best = (F.min_by, F.min) if keep == "smallest" else (F.max_by, F.max)
        level = doubtful.groupBy("digest", "class").agg(best("id").alias("id"), F.coalesce(by("row", "id"), F.min("row")).alias("row"), F.count("*").alias("n"))
        split = _annotate(doubtful, _shared.materialize(level, "split-level"), ["digest", "class"])
        out = out.join(collided, "digest", "left_anti").unionByName(split)
    return out


def _annotate(rows: DataFrame, level: DataFrame, on: list[str]) -> DataFrame:
    """Each row with its survivor. Both sides come from files, so that Spark may split a hot digest."""
    found = level.select(*on, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n"))
    joined = rows.join(found, on, "left")
    alone = F.col("n").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )
