"""The thin queries on the smallest tables: DuckDB where SQL can say it, else the contract's columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_line_dedup": "doc_id n_lines n_removed kept_sha256",
    "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op8_quality": "doc_id held_out text_score meta_score score predicted",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) == set(df.columns)
    rows = df.collect()
    if name != "op13_hard_negatives":
        ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert {r.doc_id for r in rows} == ids and (len(rows) == len(ids) or name == "op6_packing")
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.execute(ORACLE_SQL[name])
        at = [d[0] for d in want.description]
        assert sorted(at) == sorted(df.columns)
        assert sorted(tuple(r[x] for x in at) for r in rows) == sorted(want.fetchall())


def test_registered():
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
