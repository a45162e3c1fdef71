"""Operator 7, line dedup: repeated runs of lines, found in a suffix array over line ids.

Lines that hold a word are the letters of the sequences; blank lines stand beside them. Lines that are there once in all can't be
part of a repeated run and part the sequences. The others get ids in sorted order. Prefix doubling then ranks, at each step, the
stretches of twice as many lines by the pair of ranks that they are made of, over all documents at once; ranks are taken from a
distributed sort, so equal ranks are equal stretches, in their order. Suffixes whose ranks agree on a prefix are an interval of
the suffix array, and the prefix is common to them.

An interval counts if its common prefix has min_words words. Of each suffix in one the longest common prefix (lcp, in lines) with
a suffix before it, by doc_id and line, is sought. The least prefix with min_words words says whether there is one. How far it
goes on has to be asked only where the next suffix has none: elsewhere the next one's reaches as far. There fewer than min_words
words can follow the first line, so the ranks of a few doublings (50 lines at most for 50 words) cover it. The union of all lcp
stretches is that of all maximal repeated runs: of each run the first copy stays, and every later copy's lines are deleted whole.

All of it is DataFrame operations. Joins back read written tables, so that adaptive execution can split a hot line or run; ranks
come back to lines by a 128-bit digest of the line, and by the line itself should two distinct lines share one.

Defined results: null text is empty and has no lines; lines are compared without white space at their ends; texts with fewer than
min_words words lose nothing; of rows that repeat the first stays whole and the others lose what is repeated; null doc_ids come
first; extra columns are ignored; an empty table gives an empty table. Of ties, rows with equal doc_ids, the place in docs decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.llm.common import WORD, Scratch, documents, numbered, steady, with_text

MIN_WORDS = 50
BLANK = " \t\r\x0b\f"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_id", F.monotonically_increasing_id())


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, i (place among lines with a word), pos (line number), line."""
    cut = F.transform(_split(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(BLANK)).alias("line")))
    return _numbered(docs).select("row_id", "doc_id", F.posexplode(F.filter(cut, lambda s: s["line"] != "")).alias("i", "s")).select("row_id", "doc_id", "i", "s.pos", "s.line")


def _digest(line: Column, bits: int) -> dict[str, Column]:
    a, b = F.xxhash64(line), F.xxhash64(F.lit("second"), line)
    return {"a": a, "b": b} if bits >= 128 else {"a": a.bitwiseAND(F.lit((1 << bits) - 1)), "b": F.lit(0).cast("long")}


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with ranks that grow with them: a sort over all partitions, then the partition and the place in it."""
    return keys.select(*by).distinct().sort(*by).withColumn("rank", F.monotonically_increasing_id())


def _level0(docs: DataFrame, scratch: Scratch, digest_bits: int) -> DataFrame:
    """row_id, doc_id, i, pos, words, rank of lines that are there more than once."""
    lines = _lines(docs)
    digest = _digest(F.col("line"), digest_bits)
    distinct = scratch.save(lines.groupBy("line").agg(F.count("*").alias("n")).withColumns(digest).select("a", "b", "n", F.when(F.col("n") > 1, F.col("line")).alias("line")), "distinct-lines")
    clashes = scratch.save(distinct.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b"), "clashes")
    many = distinct.filter("n > 1")
    ranks = scratch.save(many.join(_ranked(many, "line"), "line"), "ranks0")
    found = lines.withColumns(digest).withColumn("words", F.regexp_count("line", F.lit(WORD)))
    kept = ("row_id", "doc_id", "i", "pos", "words", "rank")
    if clashes.isEmpty():
        return scratch.save(found.drop("line").join(ranks.select("a", "b", "rank"), ["a", "b"]).select(*kept), "level0")
    key = ["a", "b"]
    sure = found.drop("line").join(ranks.join(clashes, key, "left_anti").select("a", "b", "rank"), key).select(*kept)
    by_line = found.join(clashes, key, "left_semi").join(ranks.select("line", "rank"), "line").select(*kept)
    return scratch.save(sure.unionByName(by_line), "level0")


def _active(level0: DataFrame, min_words: int) -> DataFrame:
    """Unbroken stretches of at least min_words words, with the words before each line in its stretch; in n how many lines from here
    on have min_words words (null: they don't), and in room how many lines there are before min_words words follow the first."""
    here = W.partitionBy("row_id").orderBy("i")
    rows = level0.withColumn("stretch", F.col("i") - F.row_number().over(here))
    stretch = W.partitionBy("row_id", "stretch")
    rows = rows.withColumn("after", F.sum("words").over(stretch.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("total", F.sum("words").over(stretch))
    rows = rows.withColumn("before", F.col("after") - F.col("words")).filter(F.col("total") >= min_words)
    rows = rows.withColumn("n", F.count("*").over(stretch.orderBy("before").rangeBetween(W.currentRow, min_words - 1)).cast("int"))
    rows = rows.withColumn("room", F.count("*").over(stretch.orderBy("after").rangeBetween(W.currentRow, min_words - 1)).cast("int"))
    return rows.withColumn("n", F.when(F.col("total") - F.col("before") >= min_words, F.col("n"))).drop("total", "stretch", "after")


def _ranks_of(rows: DataFrame, levels: DataFrame, start: Column, n: Column, l: str, r: str) -> DataFrame:
    """rows with the pair of ranks that names the stretch of n lines from start on: of its first and of its last 2^k lines."""
    k = F.floor(F.log2(n + F.lit(0.5))).cast("int")
    begin = levels.select("row_id", "k", F.col("i").alias("_s"), F.col("rank").alias(l))
    end = levels.select("row_id", "k", F.col("i").alias("_e"), F.col("rank").alias(r))
    rows = rows.withColumn("k", k).withColumn("_s", start.cast("int")).withColumn("_e", (start + n - F.pow(F.lit(2), F.col("k"))).cast("int"))
    return rows.join(begin, ["row_id", "k", "_s"]).join(end, ["row_id", "k", "_e"]).drop("k", "_s", "_e")


def _later(members: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Of members with equal keys, an interval, all but the first, and that one's doc_id in first_id."""
    intervals = scratch.save(members.groupBy(*key).agg(F.min(F.struct("doc_id", "row_id", "i")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), name)
    return members.join(intervals, key).filter((F.col("row_id") != F.col("first.row_id")) | (F.col("i") != F.col("first.i"))).withColumn("first_id", F.col("first.doc_id")).drop("first")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, digest_bits: int = 128, scratch: Scratch | None = None) -> DataFrame:
    """row_id, doc_id, i, pos, words, first_id of each line that is to be deleted. first_id: the document with the first copy."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    docs = steady(docs.select("doc_id", "text"), scratch)
    active = scratch.save(_active(_level0(docs, scratch, digest_bits), min_words), "active")
    longest = active.agg(F.max(F.greatest("n", F.col("room") - F.coalesce("n", F.lit(0))))).first()[0] or 0  # min_words at most
    level = active.select("row_id", "i", "before", F.col("before").alias("last_before"), "rank")
    levels = level.select("row_id", F.lit(0).alias("k"), "i", "rank")
    for k in range(max(longest, 1).bit_length() - 1):
        ahead = level.select("row_id", (F.col("i") - 2**k).alias("i"), F.col("last_before").alias("end"), F.col("rank").alias("r"))
        # a stretch of which all lines but the last have min_words words is part of no prefix that is asked for
        pairs = level.join(ahead, ["row_id", "i"]).filter(F.col("end") - F.col("before") < min_words).select("row_id", "i", "before", F.col("end").alias("last_before"), F.col("rank").alias("l"), "r")
        pairs = scratch.save(pairs, f"pairs{k + 1}")
        ranks = scratch.save(_ranked(pairs, "l", "r"), f"ranks{k + 1}")
        level = scratch.save(pairs.join(ranks, ["l", "r"]).select("row_id", "i", "before", "last_before", "rank"), f"level{k + 1}")
        levels = levels.unionByName(level.select("row_id", F.lit(k + 1).alias("k"), "i", "rank"))
    least, longer = ["n", "l", "r"], ["n", "l", "r", "more", "l2", "r2"]
    starts = active.filter("n is not null").select("row_id", "doc_id", "i", "n", "room")
    keyed = scratch.save(_ranks_of(starts, levels, F.col("i"), F.col("n"), "l", "r"), "keyed")
    later = scratch.save(_later(keyed, least, scratch, "intervals").select("row_id", "i", *least, "first_id"), "later")
    last = later.join(later.select("row_id", (F.col("i") - 1).alias("i")), ["row_id", "i"], "left_anti")
    ends = scratch.save(last.select(*least).distinct(), "ends")
    onward = keyed.filter("room > n").join(ends, least, "left_semi").withColumn("more", F.explode(F.sequence(F.lit(1), F.col("room") - F.col("n")))).drop("room")
    onward = scratch.save(_ranks_of(onward, levels, F.col("i") + F.col("n"), F.col("more"), "l2", "r2"), "onward")
    reached = _later(onward, longer, scratch, "longer").groupBy("row_id", "i").agg(F.max("more").alias("more"))
    lcp = scratch.save(later.join(reached, ["row_id", "i"], "left").select("row_id", "i", (F.col("n") + F.coalesce("more", F.lit(0))).alias("lcp"), "first_id"), "lcp")
    so_far = W.partitionBy("row_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = active.join(lcp, ["row_id", "i"], "left").withColumn("reach", F.max(F.col("i") + F.col("lcp")).over(so_far)).withColumn("first_id", F.last("first_id", True).over(so_far))
    return scratch.save(covered.filter(F.col("reach") > F.col("i")).select("row_id", "doc_id", "i", "pos", "words", "first_id"), "deleted")


def deleted_runs(deleted: DataFrame) -> DataFrame:
    """row_id, doc_id, start_line, end_line, n_lines, n_words, first_id of each maximal run."""
    rows = deleted.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("row_id").orderBy("i")))
    return rows.groupBy("row_id", "doc_id", "run").agg(
        F.min("pos").alias("start_line"), F.max("pos").alias("end_line"), F.count("*").alias("n_lines"), F.sum("words").alias("n_words"), F.min_by("first_id", "i").alias("first_id")
    ).drop("run")


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines of repeated runs; texts that lose none stay as they are."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = steady(docs, scratch)
    gone = repeated_lines(docs, min_words, scratch=scratch).groupBy("row_id").agg(F.collect_set("pos").alias("_gone"))  # lines of one document
    left = F.array_join(F.filter(_split(F.col("doc.text")), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return numbered(docs).join(gone, F.col("_row") == F.col("row_id"), "left").select(*with_text(docs, left, F.col("_gone").isNotNull()))


def by_document(docs: DataFrame, min_words: int = MIN_WORDS, digest_bits: int = 128) -> DataFrame:
    """doc_id, n_lines (with a word), n_deleted_lines, n_deleted_words, runs (first:last line, comma-joined), first_ids for each row of docs."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = steady(docs.select("doc_id", "text"), scratch)
    runs = deleted_runs(repeated_lines(docs, min_words, digest_bits, scratch))
    listed = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "first_id")))  # runs of one document
    lost = scratch.save(runs.groupBy("row_id").agg(F.sum("n_lines").alias("d"), F.sum("n_words").alias("w"), listed.alias("runs")), "by-document")
    n_lines = F.size(F.filter(_split(F.col("text")), lambda x: F.btrim(x, F.lit(BLANK)) != "")).cast("long")
    rows = _numbered(docs).select("row_id", "doc_id", n_lines.alias("n_lines")).join(lost, "row_id", "left")
    texts = F.transform("runs", lambda r: F.concat_ws(":", r["start_line"].cast("string"), r["end_line"].cast("string")))
    return rows.select(
        "doc_id", "n_lines", F.coalesce("d", F.lit(0)).alias("n_deleted_lines"), F.coalesce("w", F.lit(0)).alias("n_deleted_words"),
        F.coalesce(F.array_join(texts, ","), F.lit("")).alias("runs"), F.coalesce(F.array_join(F.transform("runs", lambda r: r["first_id"].cast("string")), ","), F.lit("")).alias("first_ids"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(documents(spark, sf_dir))


ORACLE = r"""
WITH cut AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
lines AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM lines WHERE line <> ''),
many AS (SELECT line FROM seq GROUP BY line HAVING count(*) > 1),
s AS (SELECT * FROM seq SEMI JOIN many USING (line)),
pairs AS (SELECT a.doc_id AS ad, a.i AS ai, b.doc_id AS bd, b.i AS bi, b.words FROM s a JOIN s b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
parted AS (SELECT *, bi - row_number() OVER (PARTITION BY ad, bd, bi - ai ORDER BY bi) AS part FROM pairs),
maximal AS (SELECT *, sum(words) OVER (PARTITION BY ad, bd, bi - ai, part) AS total, sum(words) OVER (PARTITION BY ad, bd, bi - ai, part ORDER BY bi DESC) AS ahead FROM parted),
found AS (SELECT bd AS doc_id, bi AS i, min(CASE WHEN ahead >= 50 THEN {'d': ad, 'i': ai} END) AS first FROM maximal WHERE total >= 50 GROUP BY bd, bi),
gone AS (SELECT seq.*, found.first.d AS first_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM seq JOIN found USING (doc_id, i)),
runs AS (SELECT doc_id, run, min(pos) AS s, max(pos) AS e, count(*) AS n, sum(words) AS w, arg_min(first_id, i) AS first_id FROM gone GROUP BY doc_id, run),
docs AS (SELECT doc_id, sum(n)::BIGINT AS d, sum(w)::BIGINT AS w, string_agg(s || ':' || e, ',' ORDER BY s) AS runs, string_agg(first_id, ',' ORDER BY s) AS first_ids FROM runs GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM seq GROUP BY doc_id)
SELECT t.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(d.d, 0) AS n_deleted_lines, coalesce(d.w, 0) AS n_deleted_words, coalesce(d.runs, '') AS runs, coalesce(d.first_ids, '') AS first_ids
FROM documents t LEFT JOIN counts c USING (doc_id) LEFT JOIN docs d USING (doc_id)
"""
