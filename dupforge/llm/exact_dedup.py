"""Operator 6, exact dedup by deterministic block naming.

A text, folded to lower case in A-Z only, is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
numbered: a block's number is its name. Then the names of adjacent pairs are named in the same way, level by level, until
each document has one name. Two documents of as many bytes have equal names exactly if their texts are equal: a name is given
to a distinct block or pair, never to a hash. Names are carried back to the blocks by a 128-bit digest, so that the text is
shuffled once only; should two distinct blocks share a digest, those are joined by their bytes.

Defined results: a null text counts as empty; all empty texts are one group. Every input row gives one row. Of a group the row
with the largest doc_id stays; if that doc_id is repeated, one of its rows. Null doc_ids rank below all others. Extra columns
are ignored. An empty table gives an empty table.

All of it is DataFrame operations. Hot blocks, pairs and groups meet in partial aggregates first; joins back read written
tables, so that adaptive execution can split a hot key on its large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import Scratch, documents, fold_ascii, levels, numbered, steady

BLOCK_BYTES = 4096


def _names(spark: SparkSession, keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys, sorted and numbered: the number holds the partition and the place in its sorted order, so a task that runs again gives the same numbers."""
    return keys.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _digest(block, bits: int):
    mask = (1 << min(bits, 63)) - 1
    a, b = F.xxhash64(block), F.xxhash64(F.lit("second"), block)
    return (a, b) if bits >= 128 else (a.bitwiseAND(F.lit(mask)), F.lit(0).cast("long"))


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest_bits: int = 128, scratch: Scratch | None = None) -> DataFrame:
    """A row for each input row: row_id, doc_id, n_bytes, text_sha256, name. (n_bytes, name) identifies the folded text. digest_bits below 128 weakens the digests, to test what happens when they clash."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    base = docs.select("doc_id", F.coalesce(fold_ascii(F.col("text")), F.lit("")).alias("t")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("bytes")
    )
    cut = F.expr(f"transform(sequence(0L, greatest(n_bytes - 1, 0L) div {block_bytes}), i -> substring(bytes, int(i * {block_bytes} + 1), {block_bytes}))")
    blocks = base.select("row_id", "doc_id", "n_bytes", "sha", F.posexplode(cut).alias("pos", "block"))
    a, b = _digest(F.col("block"), digest_bits)
    names = scratch.save(_names(spark, blocks, "block").select(a.alias("a"), b.alias("b"), "name"), "names0")
    clashing = scratch.save(names.groupBy("a", "b").count().filter("count > 1").select("a", "b"), "clashes")
    placed = blocks.withColumns({"a": a, "b": b, "sha": F.when(F.col("pos") == 0, F.col("sha"))})
    kept = ("row_id", "doc_id", "n_bytes", "sha", "pos", "name")
    if clashing.isEmpty():
        level0 = placed.drop("block").join(names, ["a", "b"]).select(*kept)
    else:
        by_text = _names(spark, placed.join(clashing, ["a", "b"], "left_semi"), "block").withColumn("name", -F.col("name") - 2)
        level0 = (placed.drop("block").join(names.join(clashing, ["a", "b"], "left_anti"), ["a", "b"]).select(*kept)).unionByName(
            placed.join(clashing, ["a", "b"], "left_semi").join(scratch.save(by_text, "names0-by-text"), "block").select(*kept)
        )
    level0 = scratch.save(level0, "level0")
    longest = level0.agg(F.max("n_bytes")).first()[0] or 0
    many = F.col("n_bytes") > block_bytes
    done = level0.filter(~many).select("row_id", "name")
    now, left = level0.filter(many).select("row_id", "pos", "name", F.ceil(F.col("n_bytes") / block_bytes).alias("n")), levels(-(-longest // block_bytes))
    for k in range(1, left + 1):
        pairs = now.groupBy("row_id", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        # -1 stands for no right neighbour; names by text are below 0 only on level 0, where they are moved out of its way
        names = scratch.save(_names(spark, pairs, "l", "r"), f"names{k}")
        level = scratch.save(pairs.join(names, ["l", "r"]).select("row_id", "pos", "name", "n"), f"level{k}")
        one = F.col("n") <= 2**k
        done = done.unionByName(level.filter(one).select("row_id", "name"))
        now = level.filter(~one)
    info = level0.filter("pos = 0").select("row_id", "doc_id", "n_bytes", F.col("sha").alias("text_sha256"), F.col("name").alias("first"))
    if not left:
        return info.withColumnRenamed("first", "name")
    short = info.filter(~many).withColumnRenamed("first", "name")
    return scratch.save(short.unionByName(info.filter(many).drop("first").join(done, "row_id").select(*short.columns)), "identities")


def _grouped(docs: DataFrame, block_bytes: int, digest_bits: int = 128, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    named = name_documents(docs, block_bytes, digest_bits, scratch)
    key = ["n_bytes", "name"]
    groups = scratch.save(named.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("best")), "groups")
    return named.join(groups, key).select("row_id", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest_bits: int = 128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every input row."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    return _grouped(steady(docs.select("doc_id", "text"), scratch), block_bytes, digest_bits, scratch).drop("row_id")


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    docs = steady(docs, scratch)
    keep = _grouped(docs, block_bytes, scratch=scratch).filter("kept").select(F.col("row_id").alias("_row"))
    return numbered(docs).join(keep, "_row", "left_semi").select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
