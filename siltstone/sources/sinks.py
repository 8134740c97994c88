"""Writers: guarded outputs, sorted JSON lines, atomic batches, ordered finalisation, event log."""

from __future__ import annotations

import datetime
import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import promote


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def guard(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    """All outputs are looked at before any work: one that exists is an error, or goes on overwrite."""
    there = [p for p in paths if exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(f"outputs exist: {there}")
    for at in there:
        fs, p = _fs(spark, at)
        fs.delete(p, True)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a line, keys sorted, nulls kept."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, schema: T.StructType, mode: str = "errorifexists") -> None:
    """With the declared schema, so that empty lists keep their type."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode(mode).parquet(path)


def write_document(spark: SparkSession, payload: Any, path: str, overwrite: bool = True) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray((json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n").encode()))
    finally:
        out.close()


#: Names of files that Spark writes: those of one write have its identifier, and one schema.
_WRITE = re.compile(r"part-\d{5}-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[.-]c\d{3}")


class BatchWriter:
    """Batches under ``root/batch_id=N``, each there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, batch: int) -> str:
        return f"{self.root}/batch_id={batch}"

    def commit(self, batch: int, df: DataFrame, schema: T.StructType | None = None, order: list[str] | None = None) -> bool:
        """Written aside, then renamed. False if the batch is there already. Without a schema, df's own: see finalize for batches that differ."""
        if exists(self.spark, self.path(batch)):
            return False
        aside = f"{self.root}/_staged-{batch}"
        try:
            self._ordered(self._typed(df, schema), None, order).write.mode("overwrite").parquet(aside)
            fs, source = _fs(self.spark, aside)
            if not fs.rename(source, _fs(self.spark, self.path(batch))[1]):
                raise OSError(f"batch {batch} could not be committed")
        except Exception:
            fs, p = _fs(self.spark, aside)
            fs.delete(p, True)
            raise
        return True

    def commit_all(self, df: DataFrame, batch: Column, schema: T.StructType | None = None, order: list[str] | None = None) -> list[str]:
        """All batches of df in one write, each there whole or not at all; batch: the number of a row's batch, or null. Returns the batches that are new.

        Those that are there already stay as they are. A stop between two
        renames leaves the ones before it, and a rerun adds the others. Rows are
        put in order inside their batches here, by range, so that finalize
        needn't sort; without an order they stay as the tasks have them.
        """
        there = set(self._names())
        known = [int(n.split("=")[1]) for n in there if n.split("=")[1].lstrip("-").isdigit()]
        aside = f"{self.root}/_staged-{uuid.uuid4().hex}"
        fs, staged = _fs(self.spark, aside)
        made = []
        try:
            numbered = df.withColumn("batch_id", batch.cast("long"))
            if known:
                numbered = numbered.where(F.col("batch_id").isNull() | ~F.col("batch_id").isin(known))
            typed = self._typed(numbered, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]) if schema else None)
            self._ordered(typed, "batch_id", order).write.partitionBy("batch_id").parquet(aside)
            for name in sorted(s.getPath().getName() for s in fs.listStatus(staged) if s.isDirectory()):
                if name not in there:
                    if not fs.rename(_fs(self.spark, f"{aside}/{name}")[1], _fs(self.spark, f"{self.root}/{name}")[1]):
                        raise OSError(f"{name} could not be committed")
                    made.append(name)
        finally:
            fs.delete(staged, True)
        return made

    @staticmethod
    def _typed(df: DataFrame, schema: T.StructType | None) -> DataFrame:
        return promote.storable(df) if schema is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])

    @staticmethod
    def _ordered(df: DataFrame, batch: str | None, order: list[str] | None) -> DataFrame:
        if not order:
            return df
        by = [*([batch] if batch else []), *order]
        return df.repartitionByRange(*by).sortWithinPartitions(*by)

    def _names(self) -> list[str]:
        fs, root = _fs(self.spark, self.root)
        return [n for s in (fs.listStatus(root) if fs.exists(root) else []) if (n := s.getPath().getName()).startswith("batch_id=")]

    def batches(self) -> list[int]:
        """Numbers of the batches that are there; rows without a number are a batch, too, but have none here."""
        return sorted(int(n.split("=")[1]) for n in self._names() if n.split("=")[1].lstrip("-").isdigit())

    def read(self, schema: T.StructType) -> DataFrame:
        """All batches; a column that an older batch lacks is null."""
        if not self._names():
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(self.root)

    def schema(self, least: T.StructType | None = None) -> T.StructType:
        """The columns of ``least`` and of all batches, as their files say, each under the type that all of them widen to."""
        own = self._own_schemas(self._listed())
        found = {id(s): promote.as_written(s) for s in own.values()}  # one a write
        return promote.unified([*([least] if least else []), *found.values()])

    def _listed(self) -> dict[str, list[str]]:
        """The names of each batch's files, batches in order, from one listing of the root; a batch without files is left out."""
        fs, root = _fs(self.spark, self.root)
        found: dict[str, list[str]] = {}
        each = fs.listFiles(root, True) if fs.exists(root) else None
        while each is not None and each.hasNext():
            *before, batch, file = each.next().getPath().toString().split("/")
            if batch.startswith("batch_id=") and file[0] not in "_." and before[-1:] == [root.getName()]:
                found.setdefault(batch, []).append(file)
        return {n: sorted(found[n]) for n in sorted(found, key=_batch_key)}

    def _own_schemas(self, listed: dict[str, list[str]]) -> dict[str, T.StructType]:
        """The schema of each batch's files, as they say: a footer is read for each write, not for each batch."""
        write = {n: frozenset(m[1] if (m := _WRITE.match(f)) else f"{n}/{f}" for f in files) for n, files in listed.items()}
        first: dict[frozenset, str] = {}
        for n, w in write.items():
            first.setdefault(w, n)
        with ThreadPoolExecutor(8) as threads:
            read = dict(zip(first, threads.map(lambda n: self.spark.read.parquet(f"{self.root}/{n}").schema, first.values())))
        return {n: read[w] for n, w in write.items()}

    def finalize(self, path: str, schema: T.StructType | None = None, keep: bool = False) -> T.StructType:
        """All batches as one table, there whole or not at all; then the batches go, unless they are to be kept. Returns its schema.

        The table has all columns of ``schema`` and of every batch, whole
        numbers widened where a batch has wider ones or fractions; a column that
        a batch lacks is null, and types that don't go together are an error.
        Files come in the order of their batches (one without a number first)
        and, inside these, of the tasks that wrote them, and are named so. A
        file that has the table's schema is renamed as it is; others are read
        and written once. Nothing is sorted: rows are in the order in which
        their batch was committed. A run that was stopped goes on where it was.
        """
        if exists(self.spark, path):
            raise FileExistsError(path)
        aside = f"{path.rstrip('/')}._staged"
        fs, staged = _fs(self.spark, aside)
        listed = self._listed()
        schemas = self._own_schemas(listed)
        # what a stopped run had put there is under its schema already
        moved = sorted(self._files(aside)) if fs.exists(staged) else []
        known = [promote.as_written(self.spark.read.parquet(aside).schema)] if moved else []
        found = {id(s): promote.as_written(s) for s in schemas.values()}
        wanted = promote.unified([*known, *([schema] if schema else []), *found.values()])
        if known and wanted != promote.unified([known[0]]):
            raise promote.SchemaConflict(f"batches have changed since {aside} was begun")
        fs.mkdirs(staged)
        for s in fs.listStatus(staged):
            if s.isDirectory():
                fs.delete(s.getPath(), True)

        def take(name: str) -> None:
            at = f"{self.root}/{name}"
            own = schemas[name]
            typed = promote.as_written(own)
            as_is = not keep and typed == wanted and all(f.dataType == g.dataType for f, g in zip(own.fields, wanted.fields))
            for file in listed[name]:
                target = f"{aside}/part-{_batch_key(name):020d}-{file}"
                for half in moved:  # by a run that was stopped, as the file is still here
                    if half.startswith(target.rpartition("/")[2].removesuffix(".parquet")):
                        fs.delete(_fs(self.spark, f"{aside}/{half}")[1], False)
                if as_is:
                    if not fs.rename(_fs(self.spark, f"{at}/{file}")[1], _fs(self.spark, target)[1]):
                        raise OSError(f"{at}/{file} could not be moved")
                    continue
                written = f"{aside}/_{uuid.uuid4().hex}"
                promote.promoted(self.spark.read.parquet(f"{at}/{file}"), typed, wanted).write.parquet(written)
                for part in sorted(self._files(written)):  # pieces of one file, in its order
                    if not fs.rename(_fs(self.spark, f"{written}/{part}")[1], _fs(self.spark, f"{target.removesuffix('.parquet')}-{part[:10]}.parquet")[1]):
                        raise OSError(f"{at}/{file} could not be moved")
                fs.delete(_fs(self.spark, written)[1], True)
                if not keep:
                    fs.delete(_fs(self.spark, f"{at}/{file}")[1], False)

        try:
            with ThreadPoolExecutor(8) as threads:
                list(threads.map(take, listed))
            if not self._files(aside):
                self.spark.createDataFrame([], wanted).write.mode("append").parquet(aside)
            if not fs.rename(staged, _fs(self.spark, path)[1]):
                raise OSError(f"{path} could not be finalized")
        except Exception:
            if keep:  # nothing was moved out of the batches
                fs.delete(staged, True)
            raise
        if not keep:
            fs.delete(_fs(self.spark, self.root)[1], True)
        return wanted

    def _files(self, at: str) -> list[str]:
        fs, p = _fs(self.spark, at)
        return [n for s in fs.listStatus(p) if s.isFile() and (n := s.getPath().getName())[0] not in "_."]

    def review(self, schema: T.StructType, order: list[str], n: int) -> DataFrame:
        if n < 0:
            raise ValueError("a review sample has 0 rows or more")
        return self.read(schema).orderBy("batch_id", *order).limit(n)


def _batch_key(name: str) -> int:
    """Folders of batches in order: one without a number first, then by number."""
    number = name.split("=")[1]
    return int(number) + (1 << 63) + 1 if number.lstrip("-").isdigit() else 0


class EventLog:
    """JSON lines of timestamp, run, type and payload in a folder, a small file each: nothing is read or rewritten to add one, and no job runs. Names sort by time."""

    def __init__(self, spark: SparkSession, path: str, run: str) -> None:
        self.spark, self.at, self.run = spark, path.rstrip("/"), run

    def _append(self, **fields: Any) -> None:
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        row = {"timestamp": now, "run_name": self.run} | fields
        fs, p = _fs(self.spark, f"{self.at}/{time.time_ns():020d}-{uuid.uuid4().hex}.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray((json.dumps(row, ensure_ascii=False, default=str) + "\n").encode()))
        finally:
            out.close()

    def add(self, kind: str, **payload: Any) -> None:
        self._append(event_type=kind, payload=json.dumps(payload, sort_keys=True, default=str))

    def error(self, stage: str, error: BaseException, **payload: Any) -> None:
        """An error of a stage as a line of its own kind."""
        self._append(event_type="error", stage=stage, error_type=type(error).__name__, message=str(error), payload=json.dumps(payload, sort_keys=True, default=str))

    def stats(self, path: str, **counts: Any) -> None:
        """The run's figures as one document; a later snapshot takes its place."""
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        write_document(self.spark, {"timestamp": now, "run_name": self.run} | counts, path)
