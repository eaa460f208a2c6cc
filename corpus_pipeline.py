"""A training corpus from raw documents: toxic texts out, near copies out, sources mixed, tokens packed.

Every stage reads all that the one before kept, and gives an empty table for an empty
one. Null texts are empty and null ids are ids; columns that stages don't know pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, packing, simhash, toxicity
from quern.llm.common import discard, materialize, scratch
from quern.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; rows are judged one by one, so equal rows go or stay together."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null last, then the smallest hash of the text."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources cut to, or repeated up to, their share of the words; a null source is a source, and rows at a cut are in the order of a hash."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence; an empty text is its end token, and equal rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("drop_toxic", drop_toxic),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: Scoring toxicity, hashing shingles and tokenizing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            kept = materialize(stage(spark, docs, sf_dir), name, stays=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
