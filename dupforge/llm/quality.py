"""Operator 4, quality rules with cross-document line frequency.

Each text gives its own figures (words, symbols, repeated lines, words in repeated windows) and the hashes of its lines,
normalised: ASCII letters in lower case, runs of digits as one 0, runs of white space as one space. For each host the distinct
documents with a line are counted, over all rows; documents whose normalised lines are all equal count once. A line that more
than max_docs documents of its host have is above the limit. It is removed, but for the document with the least doc_id that has
it, so that a group of near copies, whose lines are above the limit too, leaves one document. A document that has lost nearly all
of its words by that is depleted and rejected.

A line is known by one 64-bit hash of host and line, so counts are partial sums over longs and neither a host nor a line is
brought to one task.

Defined results: null text has no words (and so fails the base rule); null hosts are one host, apart from the host named ''; rows
without doc_id rank behind all others, and where no row with a line has one, all of them keep it; rows that repeat give rows that
repeat; of ties, rows with the least doc_id, all keep the line; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import Scratch, documents, numbered, steady, with_text

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
WHITE = " \t\n\x0b\x0c\r"
#: More distinct documents of a host than that have a line that is removed.
MAX_DOCS = 10
#: A document is depleted if less than this share of its words is left.
LEFT_PERCENT = 30

DIGITS, SYMBOL = re.compile(rb"[0-9]+"), re.compile(rb"[#*$%&|<>]")
FIGURES = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
LINES = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))


def _hash(line: bytes, host: int = 0) -> int:
    return xxhash.xxh64_intdigest(line, host) - (1 << 63)


def host_seed(host: str | None) -> int:
    return 0 if host is None else xxhash.xxh64_intdigest(host.encode(), 1)


def normalised(line: bytes) -> bytes:
    return b" ".join(DIGITS.sub(b"0", line.lower()).split())


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words in windows that are there twice or more in the text, the first one included."""
    if len(words) <= window or len({*words}) == len(words):
        return 0
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + len(windows)] |= starts
    return int(covered.sum())


def figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text. bytes.split() splits at \\x20 and \\x09-\\x0D."""
    words = text.split()
    joined = b"".join(words)
    # a code point has one byte that doesn't continue another
    chars = len(joined) if joined.isascii() else int((np.frombuffer(joined, np.uint8) & 0xC0 != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(SYMBOL.findall(text)), len(lines) - len({*lines}), repeated_words(words)


def line_hashes(text: bytes, host: int) -> tuple[list[dict], int]:
    """Each distinct normalised line: hash with its host, and the words in all of its occurrences. Then a hash of all lines."""
    lines: dict[int, int] = {}
    order = []
    for line in text.split(b"\n"):
        if line.strip():
            plain = normalised(line)
            h = _hash(plain, host)
            lines[h] = lines.get(h, 0) + plain.count(b" ") + 1
            order.append(h)
    return [{"h": h, "words": n} for h, n in lines.items()], _hash(np.array(order, "<i8").tobytes())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row_id", pa.int64()), *FIGURES, ("lines", LINES), ("lines_id", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, rows, lines, ids = batch.slice(at, 1024), [], [], []
            for doc_id, text, host in zip(part.column("doc_id"), part.column("text"), part.column("host"), strict=True):
                data = (text.as_py() or "").encode()
                rows.append((doc_id.as_py(), *figures(data)))
                found, lines_id = line_hashes(data, host_seed(host.as_py()))
                lines.append(found)
                ids.append(lines_id)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), *columns, pa.array(lines, LINES), pa.array(ids, pa.int64())], schema=schema)


def _measured(docs: DataFrame, host: str, scratch: Scratch) -> DataFrame:
    schema = "row_id long, " + ", ".join(f"{f.name} long" for f in FIGURES) + ", lines array<struct<h: long, words: long>>, lines_id long"
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host"))
    return scratch.save(rows.mapInArrow(_measure, schema), "measured")


def _frequent(measured: DataFrame, max_docs: int) -> DataFrame:
    """h of the lines above the limit, and in first the least doc_id that has it: distinct documents first, then their number, so that no task gets all rows of a hot line."""
    texts = measured.select("lines_id", "doc_id", F.explode("lines.h").alias("h")).groupBy("lines_id", "h").agg(F.min("doc_id").alias("first"))
    return texts.groupBy("h").agg(F.count("*").alias("docs"), F.min("first").alias("first")).filter(F.col("docs") > max_docs).select("h", "first")


def assess(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, left_percent: int = LEFT_PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """For each row of docs: doc_id, figures, n_frequent_words (those in lines that are removed), base_failed, kept, row_id (the place in docs), and in frequent the hashes of its lines that are removed (null: none)."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    measured = _measured(docs, host, scratch)
    frequent = scratch.save(_frequent(measured, max_docs), "frequent")
    lines = measured.select("row_id", "doc_id", F.explode("lines").alias("l")).select("row_id", "doc_id", "l.h", "l.words")
    # merged whatever its size: the table of lines grows with the corpus
    above = lines.join(frequent.hint("merge"), "h").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = above.groupBy("row_id").agg(F.sum("words").alias("lost"), F.collect_list("h").alias("frequent"))  # lines of one document
    n, lost_words = F.col("n_words"), F.coalesce("lost", F.lit(0))
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    depleted = (lost_words > 0) & (100 * (n - lost_words) < left_percent * n)
    rows = measured.drop("lines", "lines_id").join(scratch.save(lost, "lost").hint("merge"), "row_id", "left")
    return rows.select(*FIGURES.names, lost_words.alias("n_frequent_words"), base.alias("base_failed"), (~base & ~depleted).alias("kept"), "row_id", "frequent")


def without_lines(text: str, host: str | None, hashes: list[int]) -> str:
    gone, seed = {*hashes}, host_seed(host)
    return "\n".join(x for x in text.split("\n") if not x.strip(WHITE) or _hash(normalised(x.encode()), seed) not in gone)


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of docs that are kept, with their columns, without the lines that are removed."""
    scratch = Scratch(docs.sparkSession, "quality")
    docs = steady(docs, scratch)
    kept = assess(docs, host, scratch=scratch, **limits).filter("kept").select(F.col("row_id").alias("_row"), F.col("frequent").alias("_gone"))
    cut = F.udf(lambda text, host, gone: None if text is None else without_lines(text, host, gone), "string", useArrow=True)
    some = F.col("_gone").isNotNull()
    # only texts that lose lines go to Python
    rows = numbered(docs).join(kept, "_row").withColumn("_cut", cut(F.when(some, F.col("doc.text")), F.col(f"doc.`{host}`").cast("string"), "_gone"))
    return rows.select(*with_text(docs, F.col("_cut"), some))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir)).drop("row_id", "frequent")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (
  SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS win
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY rid),
raw AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT rid, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
same AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY rid),
plain AS (
  SELECT rid, array_to_string(list_filter(list_transform(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t
  FROM d),
above AS (
  SELECT l.source, l.plain, min(l.doc_id) AS first
  FROM lines l JOIN plain p USING (rid) GROUP BY l.source, l.plain HAVING count(DISTINCT p.t) > 10),
lost AS (
  SELECT l.rid, sum(l.words) AS lost FROM lines l JOIN above a ON l.plain = a.plain AND l.source IS NOT DISTINCT FROM a.source
  WHERE l.doc_id IS DISTINCT FROM a.first GROUP BY l.rid),
figures AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(s.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.lost, 0)::BIGINT AS n_frequent_words
  FROM d JOIN w USING (rid) LEFT JOIN same s USING (rid) LEFT JOIN repeated r USING (rid) LEFT JOIN lost l USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_frequent_words > 0 AND 100 * (n_words - n_frequent_words) < 30 * n_words) AS kept
FROM figures
"""
