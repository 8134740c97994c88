"""Assembly of a manifest: joins with classified misses, normalisation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import stable_hash
from ..functions.text import nonblank, split_keywords, strip
from ..schemas import CAPTION_COLUMNS
from ..sources.scratch import new_path


def one_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row of each key that comes first in the order; a partial aggregate finds it, so a hot key is one row a task."""
    best = F.min_by(F.struct(*df.columns), order) if not isinstance(order, tuple) else F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.where(key.isNotNull()).groupBy(key.alias("__key")).agg(best.alias("__row")).select("__row.*")


def last_wins(df: DataFrame, key: Column, ordinal: Column) -> DataFrame:
    return df.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.max_by(F.struct(*df.columns), ordinal).alias("__row")).select("__row.*")


def first_wins(df: DataFrame, key: Column, ordinal: Column) -> DataFrame:
    return one_per_key(df, key, ordinal)


def classify(rows: DataFrame, key: str, metadata: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """rows left-joined to metadata and audio on a stripped key, with the miss of each: missing_file_name, metadata_missing, audio_missing, or null.

    metadata and audio have a column ``file_name`` that is unique; their other
    columns come along. Spark picks a broadcast or a shuffle join by their size.
    """
    name = strip(F.coalesce(F.col(key), F.lit("")))
    out, problem = rows.withColumn("__name", name), F.when(F.col("__name") == "", "missing_file_name")
    for side, table, code in (("metadata", metadata, "metadata_missing"), ("audio", audio, "audio_missing")):
        if table is not None:
            flagged = table.withColumnRenamed("file_name", "__name").withColumn(f"__{side}", F.lit(True))
            out = out.join(flagged, "__name", "left")
            problem = problem.when(F.col(f"__{side}").isNull(), code)
    return out.withColumn("error_type", problem).drop("__name", "__metadata", "__audio")


def split_outcome(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a miss, rows with one)."""
    return classified.where("error_type is null").drop("error_type"), classified.where("error_type is not null")


def captions_of_row(columns: tuple[str, ...] = CAPTION_COLUMNS) -> Column:
    return nonblank(F.array(*[F.col(c) for c in columns]))


def suffix_of(path: Column) -> Column:
    """The last name's ending in lower case, '.wav' without one (a leading dot begins no ending)."""
    found = F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(".wav"))


def release_path(root: str, split: Column, audio_id: Column, path: Column) -> Column:
    return F.replace(F.concat_ws("/", F.lit(root), split, F.concat(audio_id, suffix_of(path))), F.lit("\\"), F.lit("/"))


def audio_file_name(existing: Column, split: Column, audio_id: Column, path_hint: Column, root: str = "audio") -> Column:
    empty = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    made = release_path(root, empty(split, "unknown_split"), empty(audio_id, "unknown_audio"), empty(path_hint, ""))
    return F.coalesce(F.replace(F.nullif(existing, F.lit("")), F.lit("\\"), F.lit("/")), made)


def display_path(path: Column, base: str) -> Column:
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def normalize(ok: DataFrame, prefix: str, root: str, captions: Column | None = None) -> DataFrame:
    """Joined rows (split, file_name, caption_1.. unless captions are given, keywords, sound_id, path, duration_seconds) as manifest rows."""
    name = strip(F.col("file_name"))
    audio_id = F.concat_ws("_", F.lit(prefix), F.col("split"), stable_hash(name))
    captions = captions_of_row() if captions is None else nonblank(captions)
    return ok.select(
        audio_id.alias("audio_id"), "split", name.alias("original_file_name"), release_path(root, F.col("split"), audio_id, F.col("path")).alias("audio_file_name"),
        F.col("path").alias("local_audio_path"), F.round("duration_seconds", 6).alias("duration_seconds"), captions.alias("captions"), F.array_join(captions, " ").alias("caption_summary"),
        split_keywords(F.col("keywords")).alias("keywords"), F.coalesce("sound_id", F.lit("")).alias("sound_id"),
    )


def provenance(ok: DataFrame, manifest_id: Column, source: dict[str, str]) -> DataFrame:
    """Source constants, origin columns, and the metadata as struct and as sorted JSON."""
    fields = ("keywords", "license", "manufacturer", "sound_id", "sound_link", "start_end_samples")
    metadata = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    return ok.select(
        manifest_id.alias("audio_id"), *[F.lit(v).alias(k) for k, v in source.items()], "split", strip(F.col("file_name")).alias("original_file_name"), F.col("path").alias("local_audio_path_abs"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("sound_id", "sound_link", "start_end_samples", "manufacturer")], F.coalesce("license", F.lit("")).alias("license_url"),
        metadata.alias("metadata"), F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata_json"),
    )


def split_stats(classified: DataFrame, metadata_rows: DataFrame, split: str = "split") -> DataFrame:
    """Per split: rows loaded, written and missed by cause; missing_caption_rows is how many more metadata rows there are."""
    miss = lambda code: F.count_if(F.col("error_type") == code)
    loaded = classified.groupBy(split).agg(F.count("*").alias("caption_rows_loaded"), F.count_if(F.col("error_type").isNull()).alias("normalized_records_written"), miss("audio_missing").alias("missing_audio_files"), miss("metadata_missing").alias("missing_metadata_rows"))
    meta = metadata_rows.groupBy(split).agg(F.count("*").alias("metadata_rows_loaded"))
    out = loaded.join(meta, split, "left").withColumn("metadata_rows_loaded", F.coalesce("metadata_rows_loaded", F.lit(0)))
    return out.withColumn("missing_caption_rows", F.greatest(F.lit(0), F.col("metadata_rows_loaded") - F.col("caption_rows_loaded")))


def append_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all splits in one table with the split's name; a column that a split lacks is null there."""
    out = None
    for name, rows in parts.items():
        named = rows.withColumn("split", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no splits")
    return out


def audio_of_split(own: DataFrame, whole: DataFrame) -> DataFrame:
    """The split's own audio index, or the whole root's where the split's folder has no audio at all. Both: file_name, path."""
    return whole if own.isEmpty() else own


def run_totals(stats: DataFrame, written: DataFrame, provenance_rows: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: splits seen and records, provenance rows and errors of all of them."""
    parts = stats.select(F.lit("split_names").alias("name"), F.lit(1).cast("long").alias("n"), "split")
    for df, name in ((written, "total_records_written"), (provenance_rows, "total_provenance_records_written"), (errors, "total_errors")):
        parts = parts.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"), allowMissingColumns=True)
    return parts.agg(F.array_sort(F.collect_set("split")).alias("split_names"), *[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in ("total_records_written", "total_provenance_records_written", "total_errors")])


def duplicate_ids(rows: DataFrame, column: str = "audio_id") -> DataFrame:
    """Non-blank ids on more than one row."""
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("count")).where("count > 1")


def lean(rows: DataFrame) -> DataFrame:
    """The ten manifest columns with defaults for what is missing."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    lists = lambda c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    hint = F.coalesce(F.nullif(text("local_audio_path"), F.lit("")), text("original_file_name"))
    return rows.select(
        text("audio_id").alias("audio_id"), text("split").alias("split"), text("original_file_name").alias("original_file_name"), audio_file_name(text("audio_file_name"), text("split"), text("audio_id"), hint).alias("audio_file_name"),
        text("local_audio_path").alias("local_audio_path"), (F.col("duration_seconds") if "duration_seconds" in have else F.lit(None)).cast("double").alias("duration_seconds"), lists("captions").alias("captions"),
        text("caption_summary").alias("caption_summary"), lists("keywords").alias("keywords"), text("sound_id").alias("sound_id"),
    )


def with_ordinal(df: DataFrame, *order: Column, name: str = "row_ordinal") -> DataFrame:
    """A number from 0 in the given order, without gaps; no row is gathered in one task.

    The rows are written once, in order, by range; a row's number is its place
    in its file and the rows of the files before it. So it does not depend on
    which columns are read later, nor on how Spark plans that. Rows that the
    order does not tell apart are numbered in any order, but for good.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    file = F.struct(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("task"), F.col("_metadata.file_name").alias("name"))
    at = _unused("__at", df)
    placed = spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns], F.struct(file.alias("file"), F.col("_metadata.row_index").alias("row")).alias(at))
    counts = placed.groupBy(F.col(f"{at}.file").alias("__file")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    first = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    joined = placed.join(first, F.col(f"{at}.file") == F.col("__file"))
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], (F.col(f"{at}.row") + F.col("__first")).alias(name))


def _unused(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
