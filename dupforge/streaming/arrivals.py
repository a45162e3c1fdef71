"""Structured Streaming over arriving records: the first of each content is new, later ones are copies. State is a content's digest, kept as long as the watermark asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(records: DataFrame, keep: str = "7 days") -> DataFrame:
    """records (a stream: content, arrived timestamp, …): rows whose content wasn't seen within keep. Copies are dropped without their content being kept."""
    digest = F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)
    return records.withColumn("digest", digest).withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["digest"])


def copies_by_window(records: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Files, distinct contents and bytes by window of arrival."""
    digest = F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)
    rows = records.withColumn("digest", digest).withWatermark("arrived", late)
    return rows.groupBy(F.window("arrived", width)).agg(F.count("*").alias("n_files"), F.approx_count_distinct("digest").alias("n_contents"), F.sum(F.octet_length("content")).alias("bytes"))
