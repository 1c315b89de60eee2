"""A corpus from raw documents to packed sequences, in stages; each stage's result is written and read by the next.

Stages 1 to 4 return the columns of documents. ORACLE_SQL is None: language models and tokenizers have no SQL;
tests/llm holds the stages against plain Python versions.

Defined cases: null, empty and blank texts and those without a letter go in the first stage; of equal texts the row with the
smallest id stays, a null id counting as the largest, and of rows that repeat it one; rows with a null id are no near copies of any;
documents that the mix takes twice come twice; extra columns are carried through the first four stages, whatever their
names; an empty table gives an empty table with the last stage's columns. What a stage wrote on its way is removed when its result is written, and
that when the next one's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import exact_dedup, language_id, minhash_dedup, mixing, packing
from starloom.llm.common import table
from starloom.storage import drop_written, settled


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learned language, go."""
    model = language_id.train(docs, "text", "lang", "doc_id")
    return language_id.drop_unidentified(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("minhash_near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(before)
    return docs
