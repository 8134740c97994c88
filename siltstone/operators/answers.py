"""Raw answers of a model in a log, so that a run that was stopped goes on without asking again."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import _hadoop, new_path, put_aside
from ..sources.sinks import exists

#: What a call that failed leaves: the kind of error, its message, and an HTTP answer's status and body.
FAILURE = "struct<error_type:string,message:string,http_status:int,body:string>"
_LOG = f"key string, raw string, failure {FAILURE}"
#: A wave of tasks of one size has so many; tasks of the next wave are up to so many times as large, as long as they end in so many seconds.
TASKS, STEP, SECONDS = 256, 8, 2.0


@dataclass(frozen=True)
class AnswerLog:
    """A folder of answers, by a digest of what was asked for whom: stage, attempt, identity, prompt and the request's other fields.

    Calls are made by many small tasks, of ``each`` answers a thread, and each
    task's answers are there as soon as it ends, whatever becomes of the job. So
    a task that is lost and run again, or a run that is started again, asks for
    what is missing: ``each`` calls a thread of the tasks under way at most, or
    those that were begun in their first ``SECONDS``, if these are more: where
    answers come fast, tasks grow from wave to wave, and a task that is not done
    by then leaves its other rows to small tasks. A call that failed is in the
    log, too, and is made again by the next run.
    """

    path: str
    each: int = 4

    def __post_init__(self) -> None:
        if self.each < 1:
            raise ValueError("a task makes a call a thread or more")

    def read(self, spark: SparkSession) -> DataFrame:
        """key, raw, failure: an answer a key, one that failed only where no other is there."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], _LOG)
        entry = F.struct(F.col("failure").isNotNull().alias("failed"), "raw", "failure")
        return spark.read.schema(_LOG).parquet(self.path).groupBy("key").agg(F.min(entry).alias("a")).select("key", "a.raw", "a.failure")

    def ask(self, rows: DataFrame, prompt: Column, identity: list[Column], generator, generate, pool: int, concurrency: int | None) -> DataFrame:
        """rows with ``raw`` and ``failure``. Rows alike in identity and prompt share an answer; ``generate`` makes the calls (see generate.generate)."""
        spark = rows.sparkSession
        asked = json.dumps(generator.fields(), sort_keys=True, default=str) if hasattr(generator, "fields") else type(generator).__name__
        text = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
        key = F.sha2(F.concat_ws("\x1f", *map(text, [*identity, F.lit(asked), prompt])).cast("binary"), 256)
        keyed = put_aside(rows.withColumns({"__key": key, "__text": prompt}), "asked")
        known = self.read(spark).where("failure is null").select(F.col("key").alias("__key"))
        missing = put_aside(keyed.select("__key", "__text").dropDuplicates(["__key"]).join(known, "__key", "left_anti"), "missing")
        n = missing.count()
        if concurrency is None:
            self._grow(missing, n, lambda part, size, seconds: self._write(generate(part.repartition(size), F.col("__text"), generator, pool, seconds=seconds)), pool * self.each)
        else:
            for part, size in self._waves(missing, n, concurrency):
                self._write(generate(part.repartition(max(1, -(-size // (pool * self.each)))), F.col("__text"), generator, pool))
        answers = self.read(spark).withColumnRenamed("key", "__key")
        return keyed.drop("__text").join(answers, "__key", "left").drop("__key")

    def _write(self, calls: DataFrame) -> int:
        """Number of answers, written task by task."""
        seen = Observation()
        calls = calls.select(F.col("__key").alias("key"), "raw", "failure").observe(seen, F.count(F.lit(1)).alias("n"))
        calls.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        return seen.get["n"]

    def _grow(self, missing: DataFrame, n: int, ask, least: int) -> None:
        """Asks for all in waves, by ranges of a hash; ``ask(part, tasks, seconds)`` gives the number of answers. A task has ``least`` rows at first.

        Where tasks stay small, the second wave is the last one; else there are a few.
        """
        slots, number = missing.sparkSession.sparkContext.defaultParallelism, F.pmod(F.xxhash64("__key"), F.lit(1 << 30))
        size, begin, last, got = least, 0.0, False, 0
        while n and begin < 1:
            left = round(n * (1 - begin))
            end = 1.0 if last or left <= 2 * TASKS * size else begin + TASKS * size / n
            rows = max(1, round(n * (end - begin)))
            tasks = max(-(-rows // size), min(2 * slots, -(-rows // least)))
            part = missing if end - begin == 1 else missing.where((number >= int(begin * (1 << 30))) & (number < int(end * (1 << 30))))
            at = time.monotonic()
            got += ask(part, tasks, None if size == least else SECONDS)
            took = (time.monotonic() - at) * min(slots, tasks) / tasks
            step, begin = min(STEP, SECONDS / max(took, 1e-3)), end
            size, last = (int(size * step), False) if step >= 2 else (size, True)
        if got < n:  # what tasks left
            known = self.read(missing.sparkSession).where("failure is null").select(F.col("key").alias("__key"))
            ask(missing.join(known, "__key", "left_anti"), -(-(n - got) // least), None)

    def _waves(self, missing: DataFrame, n: int, concurrency: int):
        """What is to be asked, so much at a time that no more calls run than may, with its number of rows."""
        if not n:
            return
        if n <= concurrency * self.each:
            yield missing, n
            return
        waves = -(-n // (concurrency * self.each))
        for part in in_waves(missing, F.pmod(F.xxhash64("__key"), F.lit(waves))):
            yield part, concurrency * self.each


def in_waves(rows: DataFrame, number: Column):
    """The rows in a table for each number, in order (null comes last), put aside by it."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "waves")
    rows.withColumn("__wave", number.cast("long")).repartition("__wave").write.partitionBy("__wave").parquet(path)
    fs, at = _hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    order = lambda name: int(n) if (n := name.split("=")[1]).lstrip("-").isdigit() else 1 << 63
    for name in sorted(names, key=order):
        yield spark.read.schema(rows.schema).parquet(f"{path}/{name}")
