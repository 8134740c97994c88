"""Queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for the engine's own: a document is a clip, its lines are
captions, its language the split, its labels the metadata; conversations stand
in for claims and questions, events and pages for JSON and paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import hashing as H
from ..functions import jsons as J
from ..functions import text as X
from ..operators import assemble as A
from ..operators import chain as C
from ..operators import dedup as D
from ..operators import generate as G
from ..operators import select as U
from ..operators import validate as V
from ..operators.answers import AnswerLog
from ..sources import files
from ..sources.scratch import new_path
from ..sources.sinks import BatchWriter

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clips(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id"))
    return docs.select("doc_id", F.col("lang").alias("split"), name.alias("file_name"), F.split("text", "\n").alias("lines"), F.concat(F.lit("/data/"), "lang", F.lit("/"), name, F.lit(".WAV")).alias("path"), (F.col("n_chars") / 1000).alias("duration_seconds"))


def _metadata(spark, d) -> DataFrame:
    labels = table(spark, d, "labels")
    keywords = F.concat(F.lit("quality "), "quality", F.lit("; toxic "), "toxic", F.lit(";"))
    rows = labels.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file_name"), keywords.alias("keywords"), F.col("doc_id").cast("string").alias("sound_id"), F.col("doc_id").alias("ordinal"))
    return A.last_wins(rows, F.col("file_name"), F.col("ordinal")).drop("ordinal")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
    select 'doc_' || lang || '_' || substr(sha1('doc' || d.doc_id), 1, 12) as audio_id, lang as split, 'doc' || d.doc_id as original_file_name,
           'audio/' || lang || '/doc_' || lang || '_' || substr(sha1('doc' || d.doc_id), 1, 12) || '.wav' as audio_file_name,
           '/data/' || lang || '/doc' || d.doc_id || '.WAV' as local_audio_path, round(n_chars / 1000.0, 6) as duration_seconds,
           array_to_string({_LINES}, '|') as captions, array_to_string({_LINES}, ' ') as caption_summary,
           'quality ' || quality || '|toxic ' || toxic as keywords, d.doc_id::varchar as sound_id
    from documents d join labels l on d.doc_id = l.doc_id""")
def manifest_build(spark, d):
    ok, _ = A.split_outcome(A.classify(_clips(spark, d), "file_name", _metadata(spark, d)))
    made = A.normalize(ok, "doc", "audio", F.col("lines"))
    return made.withColumns({"captions": F.array_join("captions", "|"), "keywords": F.array_join("keywords", "|")})


@query("""select 'join' as stage, lang as split, 'metadata_missing' as error_type, 'doc' || doc_id as file_name from documents where doc_id not in (select doc_id from labels)""")
def manifest_errors(spark, d):
    _, bad = A.split_outcome(A.classify(_clips(spark, d), "file_name", _metadata(spark, d)))
    return bad.select(F.lit("join").alias("stage"), "split", "error_type", "file_name")


@query("""
    with c as (select lang as split, count(*) as n, count(l.doc_id) as w from documents d left join labels l on d.doc_id = l.doc_id group by 1),
         m as (select lang as split, count(*) as n from labels l join documents d on d.doc_id = l.doc_id group by 1)
    select c.split, c.n as caption_rows_loaded, w as normalized_records_written, 0::bigint as missing_audio_files, c.n - w as missing_metadata_rows,
           coalesce(m.n, 0) as metadata_rows_loaded, greatest(0, coalesce(m.n, 0) - c.n) as missing_caption_rows
    from c left join m on c.split = m.split""")
def split_stats(spark, d):
    clips, meta = _clips(spark, d), _metadata(spark, d)
    placed = meta.join(clips.select("file_name", "split"), "file_name")
    return A.split_stats(A.classify(clips, "file_name", meta), placed)


@query("""
    select (select list_sort(list(distinct lang)) from documents)::varchar as split_names, (select count(*) from documents join labels using (doc_id)) as total_records_written,
           (select count(*) from documents join labels using (doc_id)) as total_provenance_records_written, (select count(*) from documents where doc_id not in (select doc_id from labels)) as total_errors""")
def run_totals(spark, d):
    clips = _clips(spark, d)
    names = sorted(r["split"] for r in clips.select("split").distinct().where("split is not null").collect())  # a run's splits are few
    parts = {lang: clips.where(F.col("split") == lang).drop("split") for lang in names}
    ok, bad = A.split_outcome(A.classify(A.append_splits(parts), "file_name", _metadata(spark, d)))
    totals = A.run_totals(clips, ok, ok, bad)
    return totals.withColumn("split_names", F.concat(F.lit("["), F.array_join("split_names", ", "), F.lit("]")))


@query("""
    select 'doc_' || d.doc_id as audio_id, 'siltstone' as source_name, lang as split, 'doc' || d.doc_id as original_file_name, '/data/' || lang || '/doc' || d.doc_id || '.WAV' as local_audio_path_abs,
           d.doc_id::varchar as sound_id, '' as license_url, '{"keywords":"quality ' || quality || '; toxic ' || toxic || ';","license":"","manufacturer":"","sound_id":"' || d.doc_id || '","sound_link":"","start_end_samples":""}' as metadata_json
    from documents d join labels l on d.doc_id = l.doc_id""")
def provenance(spark, d):
    ok, _ = A.split_outcome(A.classify(_clips(spark, d), "file_name", _metadata(spark, d)))
    whole = ok.withColumns({c: F.lit(None).cast("string") for c in ("license", "manufacturer", "sound_link", "start_end_samples")})
    made = A.provenance(whole, F.concat(F.lit("doc_"), "sound_id"), {"source_name": "siltstone"})
    return made.select("audio_id", "source_name", "split", "original_file_name", "local_audio_path_abs", "sound_id", "license_url", "metadata_json")


@query("""select sum((turn % 3 = 0)::int) as missing_local_audio_paths_in_units from conversations""")
def missing_paths(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("path"))
    return U.missing_paths(turns.select(F.array("path").alias("local_audio_paths")))


@query("""select role as member, count(*) as units from conversations group by 1""")
def member_reuse(spark, d):
    return U.member_reuse(table(spark, d, "conversations").select(F.array("role").alias("members")))


@query("""select audio_id, count(*) as "count" from (select sha1(text) as audio_id from documents) group by 1 having count(*) > 1""")
def duplicate_ids(spark, d):
    return A.duplicate_ids(table(spark, d, "documents").select(F.sha1(F.col("text").cast("binary")).alias("audio_id")))


@query("""select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def metadata_last_wins(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return A.last_wins(events, F.col("user_id"), F.struct("ts", "event_id")).drop("ts")


@query("""select split_part(url, '/', 3) as host, url from pages qualify row_number() over (partition by split_part(url, '/', 3) order by url) = 1""")
def index_first_wins(spark, d):
    pages = table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "url")
    return A.first_wins(pages, F.col("host"), F.col("url"))


@query("""select doc_id, lang from documents where lang in ('de', 'fr')""")
def split_filter(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("""select *, row_number() over (order by doc_id) - 1 as row_ordinal from documents qualify row_ordinal >= 25 and row_ordinal < 125""")
def row_slice(spark, d):
    return U.row_slice(A.with_ordinal(table(spark, d, "documents"), F.col("doc_id")), 25, 100)


@query("""select event_id, user_id, event_type, value, props, (row_number() over (order by event_id) - 1) // 256 as batch_id from events""")
def batch_assign(spark, d):
    rows = A.with_ordinal(table(spark, d, "events"), F.col("event_id"))
    return rows.select("event_id", "user_id", "event_type", "value", "props", U.batch_of(F.col("row_ordinal"), 256).alias("batch_id"))


@query("""
    select p_partkey, array_to_string(list_filter(list_transform(string_split(k, case when contains(k, ';') then ';' else ',' end), lambda x: trim(x)), lambda x: x <> ''), '|') as keywords
    from (select p_partkey, case when p_partkey % 2 = 0 then p_name || ', ' || p_brand || ',,' || p_type else p_name || ' ; ' || p_brand || ', ' || p_type || ';' end as k from part)""")
def keyword_split(spark, d):
    part = table(spark, d, "part")
    even, odd = F.concat("p_name", F.lit(", "), "p_brand", F.lit(",,"), "p_type"), F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(", "), "p_type", F.lit(";"))
    return part.select("p_partkey", F.array_join(X.split_keywords(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)), "|").alias("keywords"))


@query("""
    select page_id, 'audio/web/page_' || substr(sha1(url), 1, 12) || case when page_id % 3 = 0 then '.wav' when page_id % 3 = 1 then '.flac' else '.wav' end as audio_file_name,
           case when page_id % 2 = 0 then 'p' || page_id else '/other/p' || page_id end as shown from pages""")
def release_path(spark, d):
    pages = table(spark, d, "pages")
    ending = F.when(F.col("page_id") % 3 == 0, ".WAV").when(F.col("page_id") % 3 == 1, ".Flac").otherwise("")
    hint = F.concat(F.lit("/data.d/clips/p"), "page_id", ending)
    base = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data.d/clips/p"), "page_id")).otherwise(F.concat(F.lit("/other/p"), "page_id"))
    return pages.select("page_id", A.release_path("audio", F.lit("web"), F.concat(F.lit("page_"), H.stable_hash(F.col("url"))), hint).alias("audio_file_name"), A.display_path(base, "/data.d/clips").alias("shown"))


_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"


@query(f"""select doc_id, array_to_string(list_sort({_TOKENS}), ' ') as tokens from documents""")
def lexical_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.lexical_tokens(F.col("text"))), " ").alias("tokens"))


_CLASSES = f"select doc_id, min(doc_id) over (partition by list_sort({_TOKENS})) as rep from documents"


@query(_CLASSES)
def token_classes(spark, d):
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.lexical_tokens(F.col("text")).alias("tokens"))
    return U.token_classes(sets).withColumnRenamed("id", "doc_id")


@query(f"""
    with r as (select doc_id from ({_CLASSES}) where doc_id = rep), t as (select doc_id, unnest({_TOKENS}) as token from documents join r using (doc_id)),
         n as (select doc_id, count(*) as n from t group by 1), c as (select x.doc_id as a, y.doc_id as b, count(*) as c from t x join t y on x.token = y.token and x.doc_id < y.doc_id group by 1, 2)
    select a, b, round(c / (p.n + q.n - c)::double, 6) as similarity from c join n p on p.doc_id = a join n q on q.doc_id = b where c / (p.n + q.n - c)::double >= 0.7""")
def similar_pairs(spark, d):
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.lexical_tokens(F.col("text")).alias("tokens"))
    return U.similar_pairs(sets, 0.7).withColumn("similarity", F.round("similarity", 6))


#: Seeded draws over a whole table: place in a seeded shuffle (o), and what attempt a draws at place i of a unit.
def _shuffled(name: str, key: str) -> str:
    return f"s as (select {key} as id, {_TOKENS} as tokens, row_number() over (order by sha1('42:' || {key}), {key}) - 1 as o from {name})"


def _draw(i: int) -> str:
    return f"('0x' || substr(sha1('42:' || a || ':{i}'), 1, 12))::bigint % (select greatest(count(*), 1) from s)"


def _jaccard(a: str, b: str) -> str:
    both, n = f"len(list_intersect({a}.tokens, {b}.tokens))", f"len({a}.tokens) + len({b}.tokens)"
    return f"(case when {n} = 0 then 0.0 else {both} / ({n} - {both})::double end)"


def _unit_sql(where: str) -> str:
    """Random units of two documents: 10,000 draws, equal units once."""
    return f"""
    with {_shuffled("documents", "doc_id")}, r as (select a as priority, {_draw(0)} as i, {_draw(1)} as j from range(10000) t(a)),
         m as (select priority, x.id as x, y.id as y, {_jaccard("x", "y")} as similarity from r join s x on x.o = i join s y on y.o = j where i <> j),
         u as (select 'unit_' || substr(sha1(array_to_string(list_sort([x::varchar, y::varchar]), '::')), 1, 16) as unit_id, priority, x, y, round(similarity, 6) as similarity
               from m where {where} qualify row_number() over (partition by unit_id order by priority) = 1)"""


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", X.lexical_tokens(F.col("text")).alias("tokens"))


def _units_of(spark, d, **plan):
    """A hundred units of two documents: random ones drawn over all of them, others from a walk through all pairs, whatever their number."""
    made = U.UnitPlan(**({"members": 2, "count": 100, "most": 1, "beyond": "walk"} | plan))
    return U.create_units(_documents(spark, d), made, "doc_id", "tokens")


def _walked_sql(name: str, key: str, where: str, count: int) -> str:
    """The first units of two rows that are allowed, of all there are: by how far apart they are in the seeded shuffle, then by a seeded order."""
    return f"""
    with {_shuffled(name, key)}, t as (select o, unnest(tokens) as token from s), c as (select x.o as i, y.o as j, count(*) as c from t x join t y on x.token = y.token and x.o < y.o group by 1, 2),
         p as (select x.id as x, y.id as y, y.o - x.o as span, coalesce(c, 0) / greatest(len(x.tokens) + len(y.tokens) - coalesce(c, 0), 1)::double as similarity from s x join s y on x.o < y.o left join c on i = x.o and j = y.o),
         u as (select 'unit_' || substr(sha1(array_to_string(list_sort([x::varchar, y::varchar]), '::')), 1, 16) as unit_id, x, y, span, similarity from p where {where})
    select unit_id, x, y, round(similarity, 6) as similarity from u order by span, sha1('42:' || unit_id), unit_id limit {count}"""


def _pairs_of(units: DataFrame, key: str) -> DataFrame:
    return units.select("unit_id", F.col(f"m0.{key}").alias("x"), F.col(f"m1.{key}").alias("y"), F.round("similarity", 6).alias("similarity"))


@query(_walked_sql("documents", "doc_id", "similarity >= 0.1 and similarity <= 1.0", 100))
def similar_units(spark, d):
    units, _, _ = _units_of(spark, d, strategy="similar")
    return _pairs_of(units, "doc_id")


@query(_walked_sql("documents", "doc_id", "similarity >= 0.9 and similarity <= 1.0", 100))
def rare_similar_units(spark, d):
    """Units so much alike that there are few: the walk hands over to the join."""
    units, _, _ = _units_of(spark, d, strategy="similar", similar_from=0.9)
    return _pairs_of(units, "doc_id")


@query(_walked_sql("documents", "doc_id", "similarity <= 0.05", 100))
def dissimilar_units(spark, d):
    units, _, _ = _units_of(spark, d, strategy="dissimilar")
    return _pairs_of(units, "doc_id")


@query(f"""
    with {_shuffled("benchmark", "item_id")}, m as (select x.id as x, y.id as y, z.id as z, z.o - x.o as span, ({_jaccard("x", "y")} + {_jaccard("x", "z")} + {_jaccard("y", "z")}) / 3 as similarity from s x join s y on x.o < y.o join s z on y.o < z.o),
         u as (select 'unit_' || substr(sha1(array_to_string(list_sort([x::varchar, y::varchar, z::varchar]), '::')), 1, 16) as unit_id, x, y, z, span, round(similarity, 6) as similarity from m where similarity >= 0.1)
    select unit_id, x, y, z, similarity from u order by span, sha1('42:' || unit_id), unit_id limit 100""")
def triple_units_mean_similarity(spark, d):
    items = table(spark, d, "benchmark").select("item_id", X.lexical_tokens(F.col("text")).alias("tokens"))
    made = U.UnitPlan(members=3, count=100, strategy="similar", beyond="walk")
    if items.limit(made.members).count() < made.members:
        return items.limit(0).select(F.lit("").alias("unit_id"), *[F.col("item_id").alias(c) for c in "xyz"], F.lit(0.0).alias("similarity"))
    units, _, _ = U.create_units(items, made, "item_id", "tokens")
    return units.select("unit_id", *[F.col(f"m{i}.item_id").alias(c) for i, c in enumerate("xyz")], F.round("similarity", 6).alias("similarity"))


@query(f"""
    with {_shuffled("benchmark", "item_id")}, u as (select x.id as x, y.id as y, 'unit_' || substr(sha1(array_to_string(list_sort([x.id::varchar, y.id::varchar]), '::')), 1, 16) as unit_id, {_jaccard("x", "y")} as similarity from s x join s y on x.o < y.o)
    select unit_id, least(x, y) as x, greatest(x, y) as y, round(similarity, 6) as similarity from u where similarity >= 0.1 order by sha1('42:' || unit_id), unit_id limit 50""")
def enumerated_units(spark, d):
    """Every pair of items is counted up and compared, and the first units come from all of them."""
    items = table(spark, d, "benchmark").select("item_id", X.lexical_tokens(F.col("text")).alias("tokens"))
    units, _, _ = U.create_units(items, U.UnitPlan(members=2, count=50, strategy="similar", beyond="walk", order="seeded"), "item_id", "tokens")
    return units.select("unit_id", F.least("m0.item_id", "m1.item_id").alias("x"), F.greatest("m0.item_id", "m1.item_id").alias("y"), F.round("similarity", 6).alias("similarity"))


@query("""select *, row_number() over (order by sha1('42:' || doc_id), doc_id) - 1 as ord from documents qualify ord < 40""")
def seeded_subset(spark, d):
    return U.seeded_subset(table(spark, d, "documents"), 40, 42, "doc_id").withColumn("ord", F.col("ord").cast("long"))


@query("""select doc_id, text, row_number() over (order by sha1('42:' || doc_id), doc_id) - 1 as ord from documents""")
def seeded_shuffle(spark, d):
    return U.seeded_subset(table(spark, d, "documents"), 0, 42, "doc_id").select("doc_id", "text", "ord")


@query(f"{_unit_sql('true')} select unit_id, priority, x, y from u order by priority limit 100")
def random_units(spark, d):
    units, _, _ = _units_of(spark, d)
    return units.select("unit_id", "priority", F.col("m0.doc_id").alias("x"), F.col("m1.doc_id").alias("y"))


@query()
def reuse_capped_units(spark, d):
    units, _, _ = _units_of(spark, d, count=1_000, reuse=2)
    return units.select("unit_id", "priority", F.array_join("members", ",").alias("members"))


@query("""
    select 'unit' as stage, 'unit_count_exceeds_possible' as error_type, n * (n - 1) // 2 + 5 as requested_unit_count, n * (n - 1) // 2 as possible_unordered_units, null::bigint as units_generated from (select count(*) as n from benchmark)
    union all select 'unit', 'unit_count_not_satisfied', n * (n - 1) // 2 + 5, null, n * (n - 1) // 2 from (select count(*) as n from benchmark)""")
def unit_shortfalls(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    n = items.count()
    _, short, _ = U.create_units(items, U.UnitPlan(members=2, count=n * (n - 1) // 2 + 5), "item_id")
    return short


@query(f"{_unit_sql('true')}, f as (select x, y from u order by priority limit 100) select count(distinct m) as distinct_members_used, 100::bigint as units_generated, (select count(*) from documents) as subset_records_selected from (select unnest([x, y]) as m from f)")
def unit_stats(spark, d):
    _, _, stats = _units_of(spark, d)
    return stats.select("distinct_members_used", "units_generated", "subset_records_selected")


@query("""
    with o as (select doc_id, 'doc' || doc_id as id, '/data/' || lang || '/doc' || doc_id || '.WAV' as path, lang, row_number() over (order by doc_id) as n from documents)
    select 'unit_' || substr(sha1(array_to_string(list_sort([x.id, y.id]), '::')), 1, 16) as unit_id, 'audio_unit_manifest_v1' as schema_version, 'caption_grounded' as grounding_standard, 2 as audio_count,
           x.id || '|' || y.id as audio_ids, x.path || '|' || y.path as local_audio_paths, x.lang || '|' || y.lang as captions from o x join o y on y.n = x.n + 1""")
def unit_records(spark, d):
    """Each document with the next one as a unit, its members in order."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc"), "doc_id")
    member = F.struct(name.alias("audio_id"), F.concat(F.lit("/data/"), "lang", F.lit("/"), name, F.lit(".WAV")).alias("local_audio_path"), name.alias("audio_file_name"), F.array("lang").alias("captions"))
    placed = A.with_ordinal(docs.select("doc_id", member.alias("m")), F.col("doc_id"))
    units = placed.select("row_ordinal", F.col("m").alias("m0")).join(placed.select((F.col("row_ordinal") - 1).alias("row_ordinal"), F.col("m").alias("m1")), "row_ordinal")
    out = U.unit_records(units, 2)
    joined = [F.array_join(c, "|").alias(n) for c, n in (("audio_ids", "audio_ids"), ("local_audio_paths", "local_audio_paths"), (F.flatten("audio_captions"), "captions"))]
    return out.select("unit_id", "schema_version", "grounding_standard", "audio_count", *joined)


@query("""
    select doc_id, k, i, case when i % 2 = 0 then 'supported' else 'contradicted' end || '_by_AUDIO_' || (i // 2 + 1) as condition_name,
           case when i % 2 = 0 then 'SUPPORTED' else 'CONTRADICTED' end as claim_status, 'AUDIO_' || (i // 2 + 1) as source
    from (select doc_id, doc_id % 3 + 1 as k, unnest(range(2 * (doc_id % 3 + 1))) as i from documents)""")
def conditions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("k"))
    return docs.select("doc_id", "k", F.posexplode(U.conditions(F.col("k").cast("int"))).alias("i", "c")).select("doc_id", "k", F.col("i").cast("long").alias("i"), "c.condition_name", "c.claim_status", F.get("c.evidence_sources", F.lit(0)).alias("source"))


@query("""
    select doc_id, candidate_index, doc_id * 2 + candidate_index as condition_index, case when (doc_id * 2 + candidate_index) % 4 % 2 = 0 then 'supported' else 'contradicted' end || '_by_AUDIO_' || ((doc_id * 2 + candidate_index) % 4 // 2 + 1) as condition_name
    from documents, (select unnest([0, 1]) as candidate_index)""")
def candidate_fanout(spark, d):
    out = U.fan_out(table(spark, d, "documents").select("doc_id"), 2, "doc_id")
    return out.withColumn("condition_name", U.choose_condition(F.lit(2), F.col("condition_index"))["condition_name"])


@query(f"""
    select doc_id, array_to_string({_LINES}, '|') || '##' || lang as groups, 3::bigint as n from documents""")
def caption_groups(spark, d):
    """A list of lines, a null and a plain text as JSON, made lists of captions."""
    docs = table(spark, d, "documents")
    said = F.concat(F.lit("["), F.to_json(F.split("text", "\n")), F.lit(",null,"), F.to_json(F.array("lang")).substr(F.lit(2), F.length(F.to_json(F.array("lang"))) - 2), F.lit("]"))
    groups = X.caption_groups(said)
    return docs.select("doc_id", F.array_join(F.transform(groups, lambda g: F.array_join(g, "|")), "#").alias("groups"), F.size(groups).cast("long").alias("n"))


@query("""select doc_id, case doc_id % 4 when 0 then 'no_path_hint' else 'none' end as problem from documents""")
def manifest_rules(spark, d):
    """Rows with a hint of a path in one of three columns, or in none."""
    docs = table(spark, d, "documents")
    hint = lambda k: F.when(F.col("doc_id") % 4 == k, F.concat(F.lit("a/"), "doc_id")).when(F.col("doc_id") % 2 == 0, "")
    rows = docs.select("doc_id", hint(1).alias("audio_file_name"), hint(2).alias("local_audio_path"), hint(3).alias("original_file_name"))
    return V.require(rows, ["doc_id", "audio_file_name"]).select("doc_id", F.coalesce(V.first_problem(V.manifest_rules()), F.lit("none")).alias("problem"))


@query(f"""
    with c as (select doc_id, {_LINES} as c from documents)
    select doc_id, array_to_string(case when len(c) <= 3 then c else list_transform(range(3), lambda i: c[(doc_id + i) % len(c) + 1]) end, '|') as captions from c""")
def caption_window(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(X.rotating_window(F.split("text", "\n"), 3, F.col("doc_id")), "|").alias("captions"))


@query(f"""
    with c as (select doc_id, {_LINES} as c from documents), w as (select doc_id, c, case when len(c) <= 3 then c else list_transform(range(3), lambda i: c[(doc_id + i) % len(c) + 1]) end as w from c)
    select doc_id, case when doc_id % 3 = 1 then '' else 'AUDIO_1 captions:' || chr(10) || case when len(w) = 0 then '- none' else array_to_string(list_transform(w, lambda x: '- ' || x), chr(10)) end end
        || case when doc_id % 3 = 0 then chr(10) || chr(10) else '' end || case when doc_id % 3 = 2 then '' else 'AUDIO_2 captions:' || chr(10) || '- none' end as context from w""")
def context_render(spark, d):
    docs = table(spark, d, "documents")
    captions = F.array(F.split("text", "\n"), F.array().cast("array<string>"))
    sources = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("AUDIO_2"))).otherwise(F.array(F.lit("AUDIO_1")))
    chosen = X.selected_labels(F.lit(2), sources, F.lit("no source named"))
    return docs.select("doc_id", X.render_context(captions, X.source_labels(F.lit(2)), chosen, 3, F.col("doc_id")).alias("context"))


@query(f"""
    with e as (select doc_id, list_transform({_LINES}, lambda x, i: (case when i % 2 = 0 then 'Claim' else 'QA' end) || ' attempt 1: ' || x) as e from documents),
         o as (select doc_id, list_filter(e, lambda x: starts_with(x, 'QA attempt ')) as o from e),
         l as (select doc_id, list_transform(o[-2:], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) as l from o)
    select doc_id, case when len(l) = 0 then 'None.' else array_to_string(list_transform(l, lambda x: '- ' || case when length(x) > 360 then rtrim(substr(x, 1, 357)) || '...' else x end), chr(10)) end as feedback from l""")
def feedback_render(spark, d):
    docs = table(spark, d, "documents")
    errors = F.transform(X.nonblank(F.split("text", "\n")), lambda x, i: F.concat(F.when((i + 1) % 2 == 0, F.lit("Claim")).otherwise(F.lit("QA")), F.lit(" attempt 1: "), x))
    return docs.select("doc_id", X.render_feedback(errors, F.lit("QA")).alias("feedback"))


def _folded(text: str, *ignored: str, least: int = 1) -> str:
    """SQL for folded words; among the tables' letters only the sharp s folds further than lower case."""
    names = ", ".join(f"'{w}'" for w in ignored)
    return f"list_filter(string_split(lower(replace(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), 'ß', 'ss')), ' '), lambda w: length(w) >= {least} and w not in ({names}))"


def _ground(text: str) -> str:
    return _folded(text, *X.GROUNDING_IGNORED)


def _relevant(question: str, claim: str) -> str:
    q, c = (_folded(t, *X.GROUNDING_IGNORED, *X.RELEVANCE_IGNORED, least=3) for t in (question, claim))
    return f"len(list_filter({q}, lambda q: len(list_filter({c}, lambda c: q = c or (length(q) >= 4 and starts_with(c, q)) or (length(c) >= 4 and starts_with(q, c)))) > 0)) > 0"


_FIRST_WORDS = f"array_to_string(list_filter(string_split(regexp_replace(({_LINES})[1], '\\s+', ' ', 'g'), ' '), lambda w: w <> '')[1:8], ' ')"


@query(f"""
    with l as (select doc_id, {_LINES} as lines from documents), w as (select doc_id, lines, list_filter(string_split(regexp_replace(lines[-1], '\\s+', ' ', 'g'), ' '), lambda w: w <> '') as w from l),
         p as (select doc_id, lines, case when doc_id % 2 = 0 then array_to_string(w[2:5], ' ') else array_to_string(list_reverse(w[1:4]), ' ') end as phrase from w),
         t as (select *, ' ' || array_to_string({_ground('phrase')}, ' ') || ' ' as padded from p)
    select doc_id, phrase, trim(padded) <> '' and len(list_filter(lines, lambda x: contains(' ' || array_to_string({_ground('x')}, ' ') || ' ', padded))) > 0 as grounded from t""")
def grounded_phrases(spark, d):
    docs = table(spark, d, "documents")
    lines = X.nonblank(F.split("text", "\n"))
    words = X.words(F.element_at(lines, -1))
    phrase = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(words, 2, 4), " ")).otherwise(F.array_join(F.reverse(F.slice(words, 1, 4)), " "))
    return docs.select("doc_id", phrase.alias("phrase"), X.is_grounded(lines, phrase).alias("grounded"))


@query(f"""
    select conv_id, turn, {_relevant('text', 'claim')} as relevant from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as claim from conversations) where claim is not null""")
def question_relevance(spark, d):
    turns = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", "text", F.lag("text").over(w).alias("claim")).where("claim is not null")
    return pairs.select("conv_id", "turn", X.is_relevant(F.col("text"), F.col("claim")).alias("relevant"))


_SAID = "text || case turn % 4 when 0 then ' It is Not Mentioned anywhere.' when 1 then ' absent from the captions' else '' end"


@query(f"""select conv_id, turn, regexp_matches(lower({_SAID}), 'not mentioned|does not mention|no caption|absent from the caption|absence from the caption|not in the captions') as absent from conversations""")
def absence_language(spark, d):
    said = F.concat("text", F.when(F.col("turn") % 4 == 0, " It is Not Mentioned anywhere.").when(F.col("turn") % 4 == 1, " absent from the captions").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", X.argues_from_absence(said).alias("absent"))


@query("""
    select conv_id, turn, case when turn % 3 = 2 then '<b>' || trim(text) else trim(text) end as cleaned, turn % 3 <> 2 as removed from conversations""")
def reasoning_strip(spark, d):
    turns = table(spark, d, "conversations")
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<Think>so\nmuch</thinking> "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<|channel>thought \nhm<channel|>"), "text")).otherwise(F.concat(F.lit("<b>"), "text"))
    cleaned = J.strip_reasoning(wrapped)
    return turns.select("conv_id", "turn", cleaned["text"].alias("cleaned"), cleaned["removed"].alias("removed"))


def _faulty(spark, d):
    e = table(spark, d, "events")
    case = F.col("event_id") % 8
    made = F.when(case == 0, F.col("props")).when(case == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(case == 2, F.concat(F.lit("{"), "props")).when(case == 3, F.concat("props", F.lit(" done"))).when(case == 4, F.lit("[1]")).when(case == 5, F.lit("{'k': 1}")).when(case == 6, F.lit('{"k": "x", "extra": null}')).otherwise(F.lit("{}"))
    return e.select("event_id", made.alias("raw"))


@query("""select event_id, case event_id % 8 when 2 then 'doubled_brace' when 3 then 'invalid_json' when 4 then 'not_object' when 5 then 'invalid_json' else 'none' end as problem from events""")
def strict_json(spark, d):
    return _faulty(spark, d).select("event_id", F.coalesce(J.parse_object(F.col("raw"))["problem"], F.lit("none")).alias("problem"))


@query("""
    select event_id, case when event_id % 8 = 6 then 'unexpected' when event_id % 8 = 7 then 'k:required' when (props->>'k')::int > 50 then 'k:maximum' else 'none' end as problem
    from events where event_id % 8 not in (2, 3, 4, 5)""")
def schema_validate(spark, d):
    parsed = _faulty(spark, d).withColumn("json", J.parse_object(F.col("raw"))["json"]).where("json is not null").withColumn("opened", J.opened(F.col("json")))
    schema = S.closed(k={"type": "number", "minimum": 0, "maximum": 50})
    return parsed.select("event_id", F.coalesce(J.first_problem(J.opened_problems(F.col("opened"), schema)), F.lit("none")).alias("problem"))


def _units(spark, d):
    """A unit of two clips, a claim about the first and a question, with faults by turns."""
    docs = table(spark, d, "documents").select("doc_id", X.nonblank(F.split("text", "\n")).alias("lines"))
    words = X.words(F.get("lines", F.lit(0)))
    text = F.array_join(F.slice(words, 1, 8), " ")
    case = F.col("doc_id") % 6
    status = F.when(F.col("doc_id") % 2 == 0, "SUPPORTED").otherwise("CONTRADICTED")
    target = F.struct(F.lit("c").alias("condition_name"), F.when(case == 2, "CONTRADICTED").otherwise(status).alias("claim_status"), F.array(F.lit("AUDIO_1")).alias("evidence_sources"), F.lit("").alias("instruction"))
    basis = F.when(case == 1, "").when(case == 3, "this is not mentioned").otherwise("the captions say otherwise")
    claim = F.struct(F.when(case == 4, "too short").otherwise(F.concat(text, F.lit(" so it is"))).alias("claim_text"), status.alias("claim_status"), F.array(F.lit("AUDIO_1")).alias("evidence_sources"), F.array(text).alias("supporting_caption_phrases"), basis.alias("contradiction_basis"), F.array().cast("array<string>").alias("forbidden_inferences"), F.lit(0.5).alias("confidence"))
    return docs.select("doc_id", F.lit(2).alias("audio_count"), F.array("lines", F.array().cast("array<string>")).alias("captions"), target.alias("target"), claim.alias("claim"))


@query(f"""
    select doc_id, case when doc_id % 6 = 2 then 'status_differs' when doc_id % 6 = 4 then 'claim_too_short' when len({_ground('t')}) = 0 then 'not_grounded' when doc_id % 6 = 1 then 'no_basis' when doc_id % 6 = 3 then 'basis_is_absence' else 'none' end as problem
    from (select doc_id, {_FIRST_WORDS} as t from documents)""")
def claim_validate(spark, d):
    rows = _units(spark, d).withColumn("opened", J.opened(F.to_json("claim")))
    rules = V.claim_rules(F.col("claim"), F.col("target"), F.col("captions"), F.col("audio_count"), F.col("opened"))
    return rows.select("doc_id", F.coalesce(J.first_problem(rules), F.lit("none")).alias("problem"))


@query(f"""
    with c as (select doc_id, case when doc_id % 6 = 4 then 'too short' else {_FIRST_WORDS} || ' so it is' end as claim from documents),
         q as (select doc_id, claim, case doc_id % 5 when 1 then 'too short?' when 2 then 'does it say that ' || claim when 3 then 'is one of all of them up?' else 'is it said in there that ' || claim || '?' end as question from c)
    select doc_id, case when len(string_split(question, ' ')) < 6 or not ends_with(question, '?') then 'question_form' when not ({_relevant('question', 'claim')}) then 'question_not_relevant' else 'none' end as problem,
           case when doc_id % 2 = 0 then 'supported' else 'contradicted' end || '|AUDIO_1' as answer from q""")
def qa_validate(spark, d):
    rows = _units(spark, d)
    case = F.col("doc_id") % 5
    asked = F.when(case == 1, "too short?").when(case == 2, F.concat(F.lit("does it say that "), "claim.claim_text")).when(case == 3, "is one of all of them up?").otherwise(F.concat(F.lit("is it said in there that "), "claim.claim_text", F.lit("?")))
    rows = rows.withColumn("qa", V.build_qa(F.struct(asked.alias("question"), F.lit("because").alias("claim_evaluation_explanation")), F.col("claim")))
    rows = rows.withColumn("opened", J.opened(F.to_json("qa")))
    rules = V.qa_rules(F.col("qa"), F.col("claim"), F.col("audio_count"), F.col("opened"))
    return rows.select("doc_id", F.coalesce(J.first_problem(rules), F.lit("none")).alias("problem"), F.array_join("qa.answer", "|").alias("answer"))


@query("""
    select doc_id, case doc_id % 5 when 1 then 'rejected' when 2 then 'pass_with_errors' when 3 then 'pass_with_corrections' when 4 then 'unknown_source' else 'none' end as problem,
           case when doc_id % 5 in (1, 2) then 'bad; worse' when doc_id % 5 = 0 then 'no reason provided' else 'note' end as detail from documents""")
def verifier_gate(spark, d):
    case = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    made = F.struct(
        F.when(case == 1, "FAIL").otherwise("PASS").alias("verifier_status"), F.when(case.isin(1, 2), F.array(F.lit("bad"), F.lit("worse"))).otherwise(none).alias("validation_errors"), F.when(case == 0, " ").otherwise("note").alias("validation_notes"),
        F.when(case == 3, "SUPPORTED").alias("corrected_claim_status"), F.when(case == 4, F.array(F.lit("AUDIO_3"))).otherwise(none).alias("corrected_evidence_sources"),
    )
    rows = table(spark, d, "documents").select("doc_id", made.alias("v")).withColumn("opened", J.opened(F.to_json("v", {"ignoreNullFields": "false"})))
    rules = V.verifier_rules(F.col("v"), F.lit(2), F.col("opened"))
    return rows.select("doc_id", F.coalesce(J.first_problem(rules), F.lit("none")).alias("problem"), V.rejection_detail(F.col("v")).alias("detail"))


@query("""
    select doc_id, case when status then 'supported' else 'contradicted' end || '|AUDIO_' || (doc_id % 2 + 1) as answer from (select doc_id, doc_id % 3 = 0 as status from documents)""")
def answer_build(spark, d):
    docs = table(spark, d, "documents")
    answer = V.benchmark_answer(F.when(F.col("doc_id") % 3 == 0, "SUPPORTED").otherwise("CONTRADICTED"), F.array(F.concat(F.lit("AUDIO_"), F.col("doc_id") % 2 + 1)))
    return docs.select("doc_id", F.array_join(answer, "|").alias("answer"))


def _script(prompt: str) -> str:
    """Answers with the prompt's last line; every third one only when told of an error."""
    import json
    import zlib

    line = prompt.rsplit("\n", 1)[-1]
    if zlib.crc32(line.encode()) % 3 == 0 and "None." in prompt:
        return "no json"
    return json.dumps({"question": f"Is it said that {line} in there?", "claim_evaluation_explanation": "as said"})


@query("""
    select doc_id, 'Is it said that ' || doc_id || ' in there?' as question, 'synthetic_' || substr(sha1('u' || doc_id || chr(10) || doc_id || chr(10) || 'Is it said that ' || doc_id || ' in there?'), 1, 16) as example_id from documents""")
def scripted_generation(spark, d):
    rows = table(spark, d, "documents").select("doc_id")
    prompt = lambda feedback: X.render_template("Errors: {{said}}\n{{claim}}", said=feedback, claim=F.col("doc_id"))
    rules = lambda qa: [("question_form", F.size(X.words(qa["question"])) < 6)]
    ok, _ = G.with_retries(rows, G.Stage("QA", prompt, S.QA_GENERATED_JSON, S.QA_GENERATED, rules), G.ScriptedGenerator(_script))
    return ok.select("doc_id", "record.question", H.example_id(F.concat(F.lit("u"), "doc_id"), F.col("doc_id").cast("string"), F.col("record.question")).alias("example_id"))


@query("""
    select doc_id, 'Is it said that ' || doc_id || ' in there?' as question from documents""")
def resumed_generation(spark, d):
    """A run with a log of answers, started a second time: nothing is asked again."""
    log = AnswerLog(new_path(spark, "log"))
    rows = table(spark, d, "documents").select("doc_id")
    prompt = lambda feedback: X.render_template("Errors: {{said}}\n{{claim}}", said=feedback, claim=F.col("doc_id"))
    stage = G.Stage("QA", prompt, S.QA_GENERATED_JSON, S.QA_GENERATED, lambda qa: [("question_form", F.size(X.words(qa["question"])) < 6)])
    written = []
    for _ in range(2):
        ok, _ = G.with_retries(rows, stage, G.ScriptedGenerator(_script), log=log, identity=("doc_id",))
        written.append(spark.read.parquet(log.path).count())
    if written[0] != written[1]:
        raise AssertionError("an answer in the log is asked for once")
    return ok.select("doc_id", "record.question")


@query("""
    with p as (select event_id, event_id // 4000 as file, '{"event":' || event_id || case when event_id % 11 = 5 then '' else '}' end as text from events)
    select file, row_number() over (partition by file order by event_id) as line, text from p qualify text not like '%}'""")
def bad_json_lines(spark, d):
    """The events as lines of JSON, 4,000 a file, some without their end: those lines with their numbers."""
    at = new_path(spark, "lines")
    line = F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 11 == 5, "").otherwise("}"))
    rows = table(spark, d, "events").select("event_id", line.alias("value"), U.batch_of(F.col("event_id"), 4000).alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "event_id").select("value", "file").write.partitionBy("file").text(at)
    found = files.bad_json_lines(spark, at)
    return found.select(F.regexp_extract("path", "file=(-?[0-9]+)", 1).cast("long").alias("file"), "line", "text")


@query("""select doc_id::varchar as doc_id, lang, sha1(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g')) as text_sha1 from documents""")
def csv_scan(spark, d):
    """The documents as CSV, their texts with lines, quotes and commas in quoted fields, read again in splits."""
    at = new_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").repartitionByRange("doc_id")  # a task without rows would write a file of a header alone, which is an error to read
    docs.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(at)
    rows = files.read_csv(spark, at, ("doc_id", "lang", "text"))
    return rows.select("doc_id", "lang", F.sha1(F.regexp_replace("text", "[ \\t\\r\\n]+", "").cast("binary")).alias("text_sha1"))


def _candidates(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Claim "), F.col("turn") % 3).alias("claim"), F.concat(F.lit("is it "), F.col("turn") % 2, F.lit("?")).alias("question"), "role", "text")


@query("""select conv_id, turn, row_number() over (partition by conv_id, turn % 6 order by turn) = 1 as kept from conversations""")
def near_dedup_exact(spark, d):
    return D.keep_distinct_exact(_candidates(spark, d), "conv_id", "turn", "claim", "question").select("conv_id", "turn", "kept")


@query()
def near_dedup_ratio(spark, d):
    rows = _candidates(spark, d).withColumn("claim", F.col("text"))
    return D.keep_distinct(rows, "conv_id", "turn", "claim", "question", F.col("role"), 0.9).select("conv_id", "turn", "kept")


def _answer(prompt: str) -> str:
    """A model that says what its prompt asks for, with faults that follow from the caption."""
    import json

    lines = prompt.split("\n")
    told = {k: json.loads(v) for k, is_, v in (x.partition("=") for x in lines) if is_ and k in ("target", "claim", "qa")}
    if lines[0] == "verify":
        bad = len(told["qa"]["question"]) % 7 == 0
        return json.dumps({"verifier_status": "FAIL" if bad else "PASS", "validation_errors": ["odd"] if bad else [], "validation_notes": "", "corrected_claim_status": None, "corrected_evidence_sources": []})
    if lines[0] == "ask":
        return json.dumps({"question": "Is it right that " + told["claim"]["claim_text"] + "?", "claim_evaluation_explanation": "as said"})
    said = " ".join(lines[lines.index("AUDIO_1 captions:") + 1][2:].split()[:6])
    if len(said) % 3 == 0 and "None." in prompt:
        return "<think>hm</think> no json"
    never = told["target"]["claim_status"] == "CONTRADICTED" and len(said) % 5 > 0
    claim = {"claim_text": f"they {'never ' if never else ''}said {said}", "claim_status": told["target"]["claim_status"], "evidence_sources": told["target"]["evidence_sources"], "supporting_caption_phrases": [said]}
    return "<think>so</think>" + json.dumps(claim | {"contradiction_basis": "the captions say otherwise", "forbidden_inferences": [], "confidence": 0.5})


_CHAIN = C.Chain({
    C.CLAIM: "claim\n{{audio_context}}\ntarget={{target_condition_json}}\n{{validation_feedback}}\n{{reasoning_instruction}}",
    C.QA: "ask\nclaim={{claim_record_json}}\n{{validation_feedback}}\n{{reasoning_instruction}}",
    C.VERIFIER: "verify\n{{audio_context}}\ntarget={{target_condition_json}}\nclaim={{claim_record_json}}\nqa={{qa_record_json}}\n{{validation_feedback}}\n{{reasoning_instruction}}",
}, G.ScriptedGenerator(_answer), each=2)


def _run_chain(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id"))
    one = lambda c: F.array(c)
    units = docs.select(name.alias("unit_id"), F.col("doc_id").alias("unit_index"), F.lit(1).alias("audio_count"), one(name).alias("audio_ids"), one(name).alias("local_audio_paths"), one(name).alias("audio_file_names"), one(X.nonblank(F.split("text", "\n"))).alias("audio_captions"))
    return C.run(units, _CHAIN)


_OUTCOME = f"""
    with c as (select doc_id, {_LINES} as c from documents), k as (select doc_id, unnest([0, 1]) as k, c from c),
         t as (select doc_id, k, len(c) > 0 as spoken, case when len(c) <= 3 then c[1] else c[(doc_id + k) % len(c) + 1] end as line from k),
         p as (select doc_id, k, spoken, array_to_string(list_filter(string_split(regexp_replace(line, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')[1:6], ' ') as said from t),
         q as (select doc_id, k, spoken, said, spoken and len({_ground('said')}) > 0 as grounded, 'they ' || case when k = 1 and length(said) % 5 > 0 then 'never ' else '' end || 'said ' || said as claim from p),
         v as (select *, 'Is it right that ' || claim || '?' as question, grounded and length('Is it right that ' || claim || '?') % 7 > 0 as verified from q),
         o as (select *, case when not verified or grounded is null then 'error' when k = 1 and exists (select 1 from v b where b.doc_id = v.doc_id and b.k = 0 and b.verified and {_folded('b.claim')} = {_folded('v.claim')}) then 'duplicate' else 'example' end as outcome from v)"""


@query(f"{_OUTCOME} select 'doc' || doc_id as unit_id, k as candidate_index, outcome, case when outcome = 'error' then '' else question end as question from o")
def unit_run(spark, d):
    out = _run_chain(spark, d)
    text = lambda df, name: df.select("unit_id", "candidate_index", F.lit(name).alias("outcome"), F.col("qa.question").alias("question"))
    kept = out.audit.select("unit_id", "candidate_index", F.lit("example").alias("outcome"), F.col("qa_record.question").alias("question"))
    return kept.unionByName(text(out.duplicates, "duplicate")).unionByName(out.errors.select("unit_id", "candidate_index", F.lit("error").alias("outcome"), F.lit("").alias("question")))


@query(f"""{_OUTCOME} select 'doc' || doc_id as unit_id, k as candidate_index, case when not spoken then 'unit' when grounded then 'VerifierAgent' else 'ClaimAgent' end as stage, 'InvalidAnswer' as error_type,
    doc_id as unit_index, null::int as http_status, null::boolean as retryable, case when spoken then 1 end as message_count from o where outcome = 'error'""")
def error_fields(spark, d):
    """Errors of a run, with where they came from and what had been asked."""
    errors = _run_chain(spark, d).errors
    return errors.select("unit_id", "candidate_index", "stage", "error_type", "unit_index", "http_status", "retryable", F.col("request_summary.message_count").alias("message_count"))


@query(f"""{_OUTCOME} select count(*) as candidate_generations_planned, count(*) filter (outcome = 'example') as examples_written, count(*) filter (outcome = 'error') as errors_written,
    count(*) filter (outcome = 'duplicate') as near_duplicates_removed, count(*) as candidate_generations_completed from o""")
def example_stats(spark, d):
    return _run_chain(spark, d).stats.drop("dry_run", "examples_per_unit")


@query("""select attempt, least(1.0 * 2.0 ** (attempt - 1), 30.0) as delay, status, status in (408, 425, 429) or status >= 500 as retryable from range(1, 9) t(attempt), (select unnest([200, 400, 408, 425, 429, 500, 503]) as status)""")
def retry_schedule(spark, d):
    rows = spark.range(1, 9).select(F.col("id").alias("attempt"), F.explode(F.array(*[F.lit(x) for x in (200, 400, 408, 425, 429, 500, 503)])).alias("status"))
    return rows.select("attempt", J.backoff_seconds(F.col("attempt")).alias("delay"), "status", J.is_retryable(F.col("status")).alias("retryable"))


def _responses(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    case = F.col("event_id") % 6
    message = F.when(case == 0, F.to_json(F.struct(F.col("props").alias("content")))).when(case == 1, F.lit('{"content":null,"reasoning":"hm"}')).when(case == 2, F.to_json(F.struct(F.lit("").alias("content"), F.col("props").alias("reasoning")))).when(case == 3, F.lit('{"refusal":"no"}')).otherwise(F.lit('{"content":"part"}'))
    end = F.when(case == 4, "length").otherwise("stop")
    return e.select("event_id", "props", message.alias("message"), F.when(case == 5, F.lit('{"choices":[]}')).otherwise(F.concat(F.lit('{"choices":[{"finish_reason":"'), end, F.lit('","message":'), message, F.lit("}]}"))).alias("response"))


@query("""
    select event_id, case event_id % 6 when 0 then props when 2 then props else '' end as text, case event_id % 6 when 1 then 'reasoning_only' when 3 then 'no_content' when 4 then 'length_partial' when 5 then 'no_choices' else 'none' end as problem,
           case event_id % 6 when 1 then 'null' when 2 then 'empty' when 3 then 'missing' else 'nonempty' end as content_state from events""")
def message_text(spark, d):
    rows = _responses(spark, d).withColumn("got", J.message_text(F.col("response"), structured=True))
    return rows.select("event_id", F.coalesce("got.text", F.lit("")).alias("text"), F.coalesce("got.problem", F.lit("none")).alias("problem"), J.field_state(F.col("message"), "content").alias("content_state"))


@query("""select conv_id, turn, length(text) as prompt_chars, 'm' as model, 1 as message_count, 'seed|top_k' as extra_fields, 'message=' || chr(39) || 'bad ' || conv_id || chr(39) || ', code=400' as detail from conversations""")
def request_summary(spark, d):
    request = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.lit(7).alias("top_k"), F.lit(1).alias("seed")))
    body = F.concat(F.lit('{"error":{"message":"bad '), "conv_id", F.lit('","code":400,"param":null}}'))
    rows = table(spark, d, "conversations").select("conv_id", "turn", request.alias("request"), body.alias("body"))
    rows = rows.select("conv_id", "turn", J.request_summary(F.col("request")).alias("s"), J.error_detail(F.col("body")).alias("detail"))
    return rows.select("conv_id", "turn", F.coalesce("s.prompt_chars", F.lit(0)).alias("prompt_chars"), "s.model", "s.message_count", F.array_join("s.extra_fields", "|").alias("extra_fields"), "detail")


@query("""select event_id, event_type, value, (event_id // 4000) as batch_id from events""")
def commit_finalize(spark, d):
    """Batches committed in one write and put together; a second commit of the same batches changes nothing."""
    at = new_path(spark, "batches")
    schema = S.ddl("event_id long, event_type string, value double")
    events, writer = table(spark, d, "events"), BatchWriter(spark, at)
    batch = U.batch_of(F.col("event_id"), 4000)
    writer.commit_all(events, batch, schema, ["event_id"])
    if writer.commit_all(events, batch, schema):
        raise AssertionError("a batch is written once")
    writer.finalize(f"{at}-whole", schema)
    return spark.read.schema(schema).parquet(f"{at}-whole").withColumn("batch_id", batch)


@query("""
    select event_id, event_type, case when event_id % 3 = 0 then round(value) when event_id % 3 = 1 then value end as value, case when event_id % 3 = 2 then props end as props, case when event_id % 3 > 0 then user_id end as user_id,
           row_number() over (order by event_id % 3, event_id) - 1 as place from events""")
def promoted_batches(spark, d):
    """Batches whose columns come and widen over time: whole numbers, then fractions and a user, then props in place of the value; the table keeps the order of the commits."""
    at = new_path(spark, "growing")
    events, writer = table(spark, d, "events"), BatchWriter(spark, at)
    own = {0: ["event_id", "event_type", F.round("value").cast("int").alias("value")], 1: ["event_id", "event_type", "value", "user_id"], 2: ["event_id", "event_type", F.lit(None).alias("value"), "user_id", "props"]}
    for batch, columns in own.items():
        writer.commit(batch, events.where(F.col("event_id") % 3 == batch).select(*columns), order=["event_id"])
    writer.finalize(f"{at}-whole")
    whole = spark.read.parquet(f"{at}-whole")
    placed = A.with_ordinal(whole.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")), F.col("file"), F.col("row"), name="place")
    return placed.drop("file", "row")
