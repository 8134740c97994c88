"""Cross-site line dedup: lines that many distinct sites share are boilerplate.

One aggregation gives, per line hash, the number of occurrences, the first
document and a HyperLogLog sketch of its sites; sketches merge on both sides of
the shuffle, so a line on every page costs one row per task. A line with fewer
occurrences than ``min_sites`` cannot spread that far. Of the others, those
whose estimate is far from the threshold are settled by it; near it, distinct
sites are counted exactly.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Sketches of 2**12 registers err by about 1.6 %; a quarter is over fifteen times that.
LG_K = 12
NEAR = 0.25


def line_key(line: Column) -> Column:
    """128 bits of a line without outer blanks; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def _lines(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    text = _shared.text_of(text_column)
    split = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), F.col(site_column).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return split.select("id", "text_key", "site", "pos", line_key(F.col("line")).alias("key")).where("key is not null")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """key, first_id, n_sites of the lines on ``min_sites`` sites or more (n_sites estimated where that is far above)."""
    sketched = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    found = sketched.where(F.col("n") >= min_sites).select("key", "first_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    found = _shared.materialize(found.where(F.col("estimate") >= (1 - NEAR) * min_sites), "line-spread")
    near = F.col("estimate") < (1 + NEAR) * min_sites
    sure = found.where(~near).select("key", "first_id", F.col("estimate").alias("n_sites"))
    asked = lines.select("key", "site").join(found.where(near).select("key"), "key", "left_semi")
    exact = asked.groupBy("key", "site").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("site").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    counted = found.join(exact, "key").select("key", "first_id", "n_sites")
    return _shared.materialize(sure.unionByName(counted), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with boilerplate lines removed from the text, plus n_lines and n_removed (under the names in ``counts``, which docs must not have).

    A line is compared without its outer blanks. On ``min_sites`` distinct
    sites or more it stays only in the document with the smallest id that has
    it (all its repeats there too), so no line is lost for good. Blank lines
    stay; a null site is no site; null text stays null and has no lines; rows
    with equal ids are judged each by its own text; a line found only with null
    ids stays. Every row of docs is returned, an emptied one too, and other
    columns are handed on. An empty table gives no rows.
    """
    names = docs.columns
    if clash := set(names) & set(counts):
        raise ValueError(f"docs already has {sorted(clash)}; give other names in counts")
    lines = _lines(docs, id_column, text_column, site_column)
    common = boilerplate(lines, min_sites)
    hit = lines.select("id", "text_key", "pos", "key").join(common.select("key", "first_id"), "key").where(~F.col("id").eqNullSafe(F.col("first_id")))
    hit = hit.withColumn("doc", F.xxhash64("id", "text_key")).groupBy("doc", "id", "text_key").agg(F.collect_set("pos").alias("removed"))
    hit = _shared.materialize(hit, "removed-lines")

    # the row goes along as one column, so that its names may be any
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_column).alias("own_id"), F.col(text_column).alias("own_text"), F.xxhash64(_shared.text_of(text_column)).alias("own_key"))
    marked = _shared.marked(packed.withColumn("own_doc", F.xxhash64("own_id", "own_key")), "own_doc", hit, "doc", "maybe")
    text = _shared.text_of("own_text")
    n_lines = F.when(F.col("own_text").isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long").alias(counts[0])
    plain = marked.where(~F.col("maybe")).select("row.*", n_lines, F.lit(0).cast("long").alias(counts[1]))
    same = (F.col("own_doc") == F.col("doc")) & F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key"))
    joined = marked.where("maybe").join(hit, same, "left")
    # a map finds a line's place at once, however many are removed
    gone = F.array(F.map_from_arrays("removed", F.transform("removed", lambda x: F.lit(True))))
    kept = F.array_join(F.get(F.transform(gone, lambda m: F.filter(F.split(text, "\n"), lambda line, i: F.try_element_at(m, i).isNull())), F.lit(0)), "\n")
    cleaned = F.when(F.col("removed").isNull(), F.col("own_text")).otherwise(kept)
    n_removed = F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed"))
    changed = joined.select(*[cleaned.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in names], n_lines, n_removed.cast("long").alias(counts[1]))
    return plain.unionByName(changed)
