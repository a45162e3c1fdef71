"""From documents to packed sequences: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Each works on all rows that its predecessor kept.

For all stages: columns may hold nulls; extra columns are carried along, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dupforge.llm import exact_dedup, packing, pii, quality, simhash
from dupforge.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose lines that too many documents of their host have. Null and empty texts have no words and go; rows that repeat are judged alike; of ties, rows with the least doc_id, all keep such a line."""
    return quality.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; null texts are empty ones, null doc_ids rank below all; of rows that tie for the largest, one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least doc_id stays, once if it is repeated; texts without words are one group; rows without doc_id stay."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; of spans that overlap the first counts. Null texts stay null; every row stays."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Null texts are empty: one piece; rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("SimHash near dedup", near), ("PII", personal_data), ("packing", pack)]

#: Line frequency by hashes, fingerprints and tokenizers aren't to be had in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
