"""Corpus preparation: quality, toxicity, near-duplicates, mixing and packing over documents.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet
before the next reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballotlake.llm import mixing, packing, quality, simhash, toxicity
from ballotlake.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, quality.fit(docs))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, once."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("SimHash near-dedup", keep_one_of_each),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages have no equal in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents, stage by stage.

    Null, empty, repeated and clashing rows and columns go as each stage's operator states: null texts count as
    empty, a null or shared doc_id names nothing on its own, columns beyond those used pass through all but the last
    stage, and an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
