"""A training corpus in five stages: toxicity, near duplicates, personal data, source mix, packing.

Defined results, in all stages: null and empty texts are kept as far as they come (they score as clean, have no near
duplicates and no personal data, take no words of the mix); rows of a null id are kept and link with nothing; repeated rows
are judged alike, and of rows of one doc_id that are near duplicates of another document all go; texts of any length are
read whole; extra columns, of whatever names, come along up to the mix; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, near_dedup, packing, pii, toxicity
from quillon.llm.common import shared_dir, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Without labels the seed words decide; rows that were held out are judged too."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked at a similarity of 0.80: that of the smallest doc_id."""
    return near_dedup.keep_first(docs, near_dedup.NearDup(percent=80))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind in brackets; null texts stay null or become empty."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass that takes words of it, so ids may repeat; documents without words take no part."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of tokens; an empty text is its end token."""
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_tokens=True)


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_duplicates_out),
    ("personal data", personal_data_out),
    ("source mix", mixed),
    ("packing", packed),
]

#: A trained model, a pseudorandom draw and a tokenizer decide the rows: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
