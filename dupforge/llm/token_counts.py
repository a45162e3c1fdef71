"""Operator 10, token counts from an exact length histogram.

Documents are counted by encoded length. The histogram alone, with suffix sums, answers for every context limit: how many
documents and tokens reach it, what is left when each document is truncated to it, and which length a quantile has.

Suffix sums are taken in two steps, within buckets of neighbouring lengths and over the buckets' totals, so no task gets the
whole histogram.

Defined results: a null text is empty and has 0 tokens; rows that repeat count each; doc_id isn't looked at; extra columns are
ignored; an empty table gives an empty histogram, for which totals are 0 and quantiles null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.llm.byte_tokens import TOKENIZER, encoder
from dupforge.llm.common import Scratch, documents

#: Lengths whose suffix sums one task takes.
BUCKET = 64


def _lengths(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Counts of a task's own documents: a row for each length."""
    bpe, seen = encoder(tokenizer), Counter()
    for batch in batches:
        seen.update(len(bpe.encode(text.as_py() or "")) for text in batch.column("text"))
        if len(seen) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])
            seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])


def histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens, n_docs: how many documents have as many tokens."""
    counts = docs.select("text").mapInArrow(lambda b: _lengths(b, tokenizer), "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))
    return Scratch(docs.sparkSession, "token-counts").save(counts, "histogram")  # it is read several times, and texts are encoded once


def with_suffix_sums(counts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each length L of the histogram: documents and tokens of documents of L tokens or more, the tokens left when all
    documents are truncated to L, and the share of documents of L tokens at most (the quantile at L)."""
    rows = counts.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "bucket": F.floor(F.col("n_tokens") / bucket)})
    inside = W.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    over = W.orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    all_ = W.partitionBy(F.lit(0))
    totals = totals.select("bucket", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_over") for c in ("d", "t")), F.sum("d").over(all_).alias("all_docs"), F.sum("t").over(all_).alias("all_tokens"))
    sums = rows.withColumns({"docs_from": F.sum("n_docs").over(inside), "tokens_from": F.sum("tokens").over(inside)}).join(totals, "bucket")
    docs_from, tokens_from = F.col("docs_from") + F.col("d_over"), F.col("tokens_from") + F.col("t_over")
    return sums.select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), F.col("all_tokens").alias("total_tokens"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"), ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when all documents are truncated to limit, whether or not a document has that length."""
    above = sums.filter(F.col("n_tokens") > limit).orderBy("n_tokens").limit(1).select("docs_from", "tokens_from", "total_tokens").first()
    if above:
        return above["total_tokens"] - above["tokens_from"] + limit * above["docs_from"]
    some = sums.limit(1).select("total_tokens").first()
    return some[0] if some else 0


def length_at(sums: DataFrame, quantile: float | Column) -> int | None:
    """The least length that this share of the documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= quantile).agg(F.min("n_tokens")).first()[0]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(histogram(documents(spark, sf_dir)))
