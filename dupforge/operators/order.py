"""Places in one order of all rows, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.scratch import Scratch


def positions(rows: DataFrame, *by: str | Column, name: str = "position", first: int = 1) -> DataFrame:
    """rows and their place in the order of by, from first on: a sort over all partitions, then the counts of the partitions before."""
    scratch = Scratch(rows.sparkSession, "positions")
    placed = scratch.save(rows.sort(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumns({"_p": F.shiftright("_at", 33), "_r": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_p").agg(F.count("*").alias("_c"))  # a row a partition
    before = counts.select(F.col("_p").alias("_q"), (F.sum("_c").over(W.orderBy("_p")) - F.col("_c") + first).alias("_b"))
    return placed.join(before, F.col("_p") == F.col("_q")).withColumn(name, F.col("_r") + F.col("_b")).drop("_at", "_p", "_r", "_q", "_b")
