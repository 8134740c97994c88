"""A corpus pipeline of five stages, each one of the ten operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import _shared
from siltstone.llm.decontam import drop_contaminated
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.near_copies import drop_similar
from siltstone.llm.packing import pack
from siltstone.llm.queries import table, tokenizer_path
from siltstone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models predict toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sites or more stay in the first document that has them; no document goes."""
    names = docs.columns
    cleaned = line_dedup(docs, min_sites=10, counts=("__n_lines", "__n_removed"))
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles stays, the one with the smallest doc_id."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2,048 tokens."""
    return pack(docs, tokenizer_path(), 2048)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
