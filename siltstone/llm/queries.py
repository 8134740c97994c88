"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared
from .decontam import contaminated, find_contamination
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .line_dedup import line_dedup
from .packing import pack
from .periodic_runs import collapse_runs
from .quality import score_quality
from .sharding import assign_shards
from .simhash import near_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity
from .tokens import token_index, write_tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), 24)
    return placed.withColumnRenamed("id", "doc_id").withColumn("law", F.lit("key"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"), min_sites=10)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(_shared.text_of("text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_index(spark, path)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"), width=13)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    names = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"), threshold=200)
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    # every tenth text repeats from word a on, with period p
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)))
    docs = docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(planted, F.lit(1), F.col("n")), " ")).otherwise(F.col("text")).alias("text"))
    found = collapse_runs(docs, exponent=4, least=6)

    def order(x, y):
        left, right = x.length.cast("long") * y.period, y.length.cast("long") * x.period
        return F.when(left != right, F.sign(right - left)).when(x.start != y.start, F.sign(x.start - y.start)).otherwise(F.sign(x.period - y.period)).cast("int")

    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    runs, kept = F.array_join(F.transform("runs", line), ""), F.col("kept_text")
    found = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *[F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((runs, "runs_sha256"), (kept, "collapsed_sha256"))])
    figures = [F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", "n_runs", *figures, F.floor(F.col("best.length") * F.lit(1000) / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_sharding, op3_line_dedup, op4_token_files, op5_simhash, op6_packing, op7_substring_dedup, op8_quality, op9_toxicity, op10_decontamination, op11_suffix_dedup, op12_periodic_runs, op13_hard_negatives)
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op3_line_dedup": r"""
        with lines as (
            select doc_id, source, i, list_extract(parts, i) as line, trim(list_extract(parts, i), ' ' || chr(9) || chr(13)) as bare
            from (select doc_id, source, string_split(text, chr(10)) as parts from documents where text is not null) d,
                 lateral (select unnest(range(1, len(parts) + 1)) as i) u),
        common as (select bare, min(doc_id) as first_id from lines where bare <> '' group by bare having count(distinct source) >= 10),
        judged as (select l.*, c.bare is not null and l.doc_id <> c.first_id as gone from lines l left join common c using (bare))
        select d.doc_id, count(j.i) as n_lines, count(j.i) filter (where gone) as n_removed,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from documents d left join judged j on d.doc_id = j.doc_id group by d.doc_id""",
    "op7_substring_dedup": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
             p as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from d, lateral (select unnest(range(1, len(w) - 11)) as i) u),
             f as (select k, min(doc_id) as first_id from p group by k having count(*) > 1),
             gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from p join f using (k) where first_id < doc_id),
             words as (select doc_id, j, w[j] as word from d, lateral (select unnest(range(1, len(w) + 1)) as j) u),
             kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by j) as t from words anti join gone using (doc_id, j) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op10_decontamination": r"""
        with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
             b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
             win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + 12], ' ') as k from b, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) u where len(w) > 0),
             p as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k from (select * from d, (select distinct n from win) l where len(w) >= n), lateral (select unnest(range(1, len(w) - n + 2)) as i) u),
             hit as (select doc_id, i, n, item_id from p join win using (n, k)),
             pos as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by doc_id),
             items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join pos using (doc_id) left join items using (doc_id)""",
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x
                   from embeddings where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
             s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
             p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, row_number() over w as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 3""",
}
