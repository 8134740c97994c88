"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _LOCAL["dir"]


def application_folder(spark: SparkSession) -> str:
    """One folder for everything that this application puts aside; it goes when the application's JVM ends."""
    path = f"{shared_folder(spark)}/siltstone-{spark.sparkContext.applicationId}"
    if _LOCAL.get("made") != path:
        fs, at = _hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _LOCAL["made"] = path
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put_aside(df: DataFrame, name: str = "table", counts: dict[str, Column] | None = None, **options: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here, and a lost executor costs a reread.

    ``counts`` are aggregates that are observed as the rows are written, with no
    job of their own; the result has them as ``siltstone_counts``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    seen = Observation() if counts else None
    watched = df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if counts else df
    watched.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.siltstone_path, out.siltstone_counts = path, seen.get if seen else {}
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables put aside that nothing reads any more."""
    for df in tables:
        fs, at = _hadoop(df.sparkSession, df.siltstone_path)
        fs.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
