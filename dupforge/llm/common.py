"""Helpers that the training-text operators share: inputs, scratch tables in the shared folder, and ASCII folding."""

from __future__ import annotations

import math
import os
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.scratch import Scratch  # noqa: F401

#: ASCII white space, as the contracts' word pattern has it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Plans that give their rows in the same order whenever they run: files and local rows, and what is done to each row by itself.
STEADY = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter"}


def steady(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs, written first unless it reads alike each time, so that its rows may be known by their places."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.deterministic() and plan.getClass().getSimpleName() in STEADY:
        if not plan.children().size():
            return docs
        plan = plan.children().apply(0)
    return scratch.save(docs, "docs")


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. For pure ASCII, lower() does that; it would also change letters such as É."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered(docs: DataFrame) -> DataFrame:
    """_row, the place in docs, and doc, all columns of docs: so no name that docs may have clashes with those of an operator."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def with_text(docs: DataFrame, text: Column, changed: Column) -> list[Column]:
    """The columns of docs, out of the struct doc, with another text; n_chars, if it is there, follows where the text has changed."""
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    out["text"] = F.when(changed, text).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length(text)).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return [v.alias(k) for k, v in out.items()]


def lowest(rows: DataFrame, by: str, n: int, salts: int = 64) -> DataFrame:
    """A sample of n rows at most of each value of by: those whose h is lowest, of 4 * n / salts at most from each of as many salts. rows: doc_id, h.
    The first pass deals each value to several tasks, and each of them passes on so few that the last one gets 4 * n at most. Ties go by doc_id; null values of by are a value; rows that repeat count each; an empty table gives an empty one."""
    nth = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("h", "doc_id"))
    some = rows.withColumn("salt", F.pmod("h", F.lit(salts))).withColumn("nth", nth(by, "salt")).filter(F.col("nth") <= -(-4 * n // salts))
    return some.withColumn("nth", nth(by)).filter(F.col("nth") <= n).drop("salt", "nth")


def levels(n: int) -> int:
    """How often n neighbours are halved until one is left."""
    return math.ceil(math.log2(n)) if n > 1 else 0


def tokenizer_file(name: str) -> str:
    """A path is taken as it is; a bare name is looked up among the public tokenizers, on the machine that asks."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
