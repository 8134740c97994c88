"""Readers: CSV of unknown encoding, JSON lines, Parquet, audio files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import strip
from .scratch import put_aside

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")  # the first two differ in a mark at the begin, which goes


#: What cp1252 has in place of the control characters 0x80 to 0x9f; it lacks five of them.
_CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
_LACKING = "".join(chr(b) for b, c in zip(range(0x80, 0xA0), _CP1252) if c == "\ufffd")
_HELD = "".join(chr(b) for b, c in zip(range(0x80, 0xA0), _CP1252) if c != "\ufffd")


def _verdicts(splits: DataFrame) -> DataFrame:
    """path, encoding: the first encoding that takes all bytes of a file. No character of any goes beyond a line."""
    fits = splits.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_and("cp1252").alias("cp1252"))
    return fits.select("path", F.when(F.col("utf8"), ENCODINGS[1]).when(F.col("cp1252"), ENCODINGS[2]).otherwise(ENCODINGS[3]).alias("encoding"))


def _decoded(raw: Column, encoding: Column) -> Column:
    latin = F.decode(raw, "ISO-8859-1")
    plain = F.decode(raw, "UTF-8")
    return F.when(encoding == ENCODINGS[1], plain).when(encoding == ENCODINGS[2], F.translate(latin, _HELD, _CP1252.replace("\ufffd", ""))).otherwise(latin)


def in_quotes(line: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open at the end of a line of CSV, if it is or isn't at its begin. A quote inside a plain field is a character like any other."""
    if b'"' not in line:
        return quoted
    at, n = 0, len(line)
    while True:
        if quoted:
            while True:  # to the field's last quote; two stand for one
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != b'"':
                    break
                at += 2
            quoted, at = False, at + 1
        else:
            if line[at : at + 1] == b'"':
                quoted, at = True, at + 1
                continue
        ends = [x for x in (line.find(b",", at), line.find(b"\r", at)) if x >= 0]  # the next field, or record
        if not ends:
            return False
        at = min(ends) + 1
        if at > n:
            return False


def _csv_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, line, raw, opened, closed: whether the line begins and ends outside quotes; verdicts on encodings). A file is read in splits.

    Each split is walked through for both states in which it may begin; what it
    makes of them is then handed from split to split, and sent to the lines.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.is_valid_utf8("value").alias("is_utf8"), F.col("value").cast("binary").alias("raw"))

    def walk(batches):
        import pyarrow as pa

        here, states = None, [False, True]
        for batch in batches:
            begin, end = ([], []), ([], [])
            for path, split, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "raw"))):
                if (path, split) != here:
                    here, states = (path, split), [False, True]
                for k in (0, 1):
                    begin[k].append(states[k])
                    states[k] = in_quotes(raw, states[k])
                    end[k].append(states[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.bool_()) for x in (*begin, *end))], [*batch.schema.names, "begin0", "begin1", "end0", "end1"])

    kinds = "path string, split long, at long, is_utf8 boolean, raw binary, begin0 boolean, begin1 boolean, end0 boolean, end1 boolean"
    lines = put_aside(read.mapInArrow(walk, kinds), "csv-lines")
    cp1252 = F.col("is_utf8") | ~F.decode("raw", "ISO-8859-1").rlike(f"[{_LACKING}]")
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max_by(F.struct("end0", "end1"), "at").alias("end"), F.bool_and("is_utf8").alias("utf8"), F.bool_and(cp1252).alias("cp1252"))
    splits = put_aside(splits, "csv-splits")
    # a file's splits are few: their states one after the other, each as (split, its first number, lines before, state at its begin)
    start = F.struct(F.array().cast("array<struct<split:bigint,first:bigint,before:bigint,quoted:boolean>>").alias("out"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("quoted"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(F.struct(x["split"].alias("split"), x["first"].alias("first"), s["n"].alias("before"), s["quoted"].alias("quoted")))).alias("out"), (s["n"] + x["n"]).alias("n"), F.when(s["quoted"], x["end"]["end1"]).otherwise(x["end"]["end0"]).alias("quoted"))
    told = splits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("split", "n", "first", "end"))).alias("x")).select("path", F.explode(F.aggregate("x", start, step)["out"]).alias("s")).select("path", "s.*")
    placed = lines.join(F.broadcast(told), ["path", "split"])
    state = lambda c: F.when(F.col("quoted"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    out = placed.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "raw", (~state("begin")).alias("opened"), (~state("end")).alias("closed"))
    return out, _verdicts(splits)


def _csv_records(lines: DataFrame) -> DataFrame:
    """path, line (where it begins), raw: lines that a quoted field goes on over are put together.

    Each task does so with the lines that it has one after the other; what
    begins or ends in another task's is joined, two pieces a task and file or so.
    """

    def gather(batches):
        import pyarrow as pa

        held, begin, expected = [], None, None
        for batch in batches:
            out = []
            for path, line, raw, opened, closed in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "raw", "opened", "closed"))):
                if held and (path, line) != expected:
                    out.append((*begin, False, b"\n".join(held)))
                    held = []
                if not held:
                    begin = (path, line, opened)
                held.append(raw)
                expected = (path, line + 1)
                if closed:
                    out.append((*begin, True, b"\n".join(held)))
                    held = []
            yield made(pa, out)
        if held:
            yield made(pa, [(*begin, False, b"\n".join(held))])

    def made(pa, rows):
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "line", "opened", "closed", "raw"])

    pieces = put_aside(lines.mapInArrow(gather, "path string, line long, opened boolean, closed boolean, raw binary"), "csv-pieces")
    whole = pieces.where("opened and closed").select("path", "line", "raw")
    first = F.max(F.when(F.col("opened"), F.col("line"))).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    joined = pieces.where("not (opened and closed)").withColumn("first", first).groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("x"))
    lists = F.transform("x", lambda x: F.decode(x["raw"], "ISO-8859-1"))  # bytes as characters, there and back
    return whole.unionByName(joined.select("path", F.col("first").alias("line"), F.encode(F.array_join(lists, "\n"), "ISO-8859-1").alias("raw")))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of one or more CSV files with a header, as cleaned strings, with path and ordinal. Missing required columns and empty files are errors.

    Files of any size are read in splits: each file's encoding is the first that
    takes all its lines, and a quoted field may go on over lines and splits. The
    ordinal is the number of the line that a row begins on (where carriage
    returns alone end rows, they count on from there).
    """
    lines, verdicts = _csv_lines(spark, path)
    verdicts = put_aside(verdicts, "csv-encodings")  # tables of a row a file are written: their size is known, so rows are not shuffled to meet them
    records = _csv_records(lines).join(verdicts, "path")
    text = _decoded(F.col("raw"), F.col("encoding"))
    records = records.select("path", "line", F.when(F.col("line") == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("text"))
    heads = records.where("line = 1").select("path", F.col("text").alias("head"))
    files = spark.read.format("binaryFile").load(path).select("path")  # names alone, those of files without a line, too
    fields = [T.StructField("path", T.StringType()), T.StructField("ordinal", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)]

    def checked(batches):
        import pyarrow as pa

        for batch in batches:
            for name, head, rows in zip(*(batch.column(c).to_pylist() for c in ("path", "head", "rows"))):
                own = _csv_rows(head or "")
                missing = [c for c in columns if c not in (own[0] if own else [])]
                if missing:
                    raise ValueError(f"{name} is missing required columns: {missing}")
                if not rows and len(own) < 2:
                    raise ValueError(f"{name} is empty.")
            yield batch.select(["path", "head"])

    def parse(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in columns)])
        names: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for name, line, text, head in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "text", "head"))):
                if head not in names:
                    names[head] = _csv_rows(head)[0]
                for i, row in enumerate(_csv_rows(text)[line == 1 :]):
                    values = dict(zip(names[head], row))
                    out.append({"path": name, "ordinal": line + i + (line == 1)} | {c: values.get(c, "").strip() for c in columns})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    counted = records.where((F.col("line") > 1) & (F.trim(F.btrim("text", F.lit("\r"))) != "")).groupBy("path").agg(F.count("*").alias("rows"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = files.select(bare(F.col("path")).alias("at"))
    told = listed.join(heads.withColumn("at", bare(F.col("path"))), "at", "left").select(F.coalesce("path", "at").alias("path"), "head").join(counted, "path", "left").mapInArrow(checked, "path string, head string")
    return records.join(put_aside(told, "csv-heads"), "path").mapInArrow(parse, T.StructType(fields))


def _csv_rows(text: str) -> list[list[str]]:
    import csv
    import io

    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, and the first bad line ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """path, line (from 1), text of the lines of text files, or of those that ``keep`` (on ``text``) lets through; no file goes through one task.

    Spark reads files in splits, and each split's lines one after the other. A
    line's number is its place in its split and the lines of the splits before
    it, which are counted in the same reading.
    """
    kept = F.lit(True) if keep is None else keep
    read = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    lines = put_aside(read.select(F.col("file_path").alias("path"), F.col("file_block_start").alias("split"), "at", F.when(F.coalesce(kept, F.lit(False)), F.col("text")).alias("text")), "lines")
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    placed = lines.where("text is not null").join(splits.withColumn("before", F.coalesce(before, F.lit(0))), ["path", "split"])
    return placed.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and text of lines that are neither blank nor a JSON object."""
    from ..functions.jsons import parse_object

    return numbered_lines(spark, path, (strip(F.col("text")) != "") & parse_object(F.col("text"))["problem"].isNotNull())


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By the path's ending: .parquet, .jsonl or .json."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"unknown format: {path}")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and length of files under a root by glob, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def find_file(spark: SparkSession, root: str, names: list[str], preferred: list[str] | None = None) -> str | None:
    """A preferred path, if it exists; else the first path, in order, of the first name that is found."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for at in preferred or []:
        p = hadoop.Path(at)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return at
    for name in names:
        found = list_files(spark, root, name).agg(F.min("path")).first()[0]
        if found:
            return found
    return None


def audio_index(spark: SparkSession, root: str) -> DataFrame:
    """file_name, path: one file for each base name, the first by path."""
    return list_files(spark, root, "*.wav").groupBy(F.element_at(F.split("path", "/"), -1).alias("file_name")).agg(F.min("path").alias("path"))


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Frames by rate to six places; null for what is no WAV file."""
    import io
    import wave

    def one(data: bytes):
        try:
            with wave.open(io.BytesIO(data)) as wav:
                return round(wav.getnframes() / wav.getframerate(), 6) if wav.getframerate() > 0 else None
        except Exception:
            return None

    return content.map(one)


def audio_durations(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", wav_seconds("content").alias("duration_seconds"))
