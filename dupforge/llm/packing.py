"""Operator 5, packing by cutting-stock column generation.

A document is its ids and one id 0 behind them. Whole stretches of 1024 ids are sequences of their own. What is left of each
document, fewer than 1024 ids, is packed by length: a linear program over patterns of the length histogram (cutting_stock.py)
says how often each pattern is filled, columns being priced until none is left that would lower the price; its counts are rounded
down, what is left over is filled sequence by sequence, and the documents of a length take its places by rank. Documents for
which a cut is cheaper (it is priced as ten tokens of padding) are laid in one stream that is cut every 1024 ids.

Ranks are made without bringing a length together: each task ranks its own rows while it encodes them, and the counts of the
tasks before it are added. Only the histogram, at most 1023 numbers, comes to the driver.

Defined results: null text is empty: one piece, the id 0; rows that repeat are packed each; a null doc_id stays null; of ties,
documents of one length, the order of tasks and rows decides which place is taken; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.llm.byte_tokens import TOKENIZER, encoder
from dupforge.llm.common import Scratch, documents
from dupforge.llm.cutting_stock import Plan, plan

SEQUENCE = 1024
END = 0

ENCODED = pa.schema([("task", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("left", pa.int32()), ("rest", pa.binary()), ("nth_left", pa.int64()), ("nth_full", pa.int64())])
PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    bpe, seen, full = encoder(tokenizer), Counter(), 0
    narrow = np.dtype("<u2") if bpe.vocab_size <= 1 << 16 else np.dtype("<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, out = batch.slice(at, 512), {f.name: [] for f in ENCODED}
            for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                n, left = len(ids), len(ids) % size
                row = (task, doc_id.as_py(), n, [zlib.crc32(ids[k : k + size]) for k in range(0, n - left, size)], left, ids[n - left :].astype(narrow).tobytes(), seen[left], full)
                seen[left] += 1
                full += n // size
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in ENCODED], schema=ENCODED)


def _place(batches: Iterator[pa.RecordBatch], how: Plan) -> Iterator[pa.RecordBatch]:
    size, first_full = how.capacity, how.first_full()
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            n, left, doc_id = r["n"], r["left"], r["doc_id"]
            out += [(doc_id, k * size, size, crc, n, first_full + r["full_before"] + r["nth_full"] + k, 0) for k, crc in enumerate(r["crcs"])]
            if not left:
                continue
            ids = np.frombuffer(r["rest"], f"<u{len(r['rest']) // left}").astype("<u4")
            rank = r["left_before"] + r["nth_left"]
            if rank < how.used[left]:
                first, copies, sequence, offset = how.slots[left]
                j = int(np.searchsorted(first, rank, "right")) - 1
                copy, inside = divmod(rank - int(first[j]), int(copies[j]))
                out.append((doc_id, n - left, left, zlib.crc32(ids), n, int(sequence[j]) + copy, int(offset[j]) + inside * left))
                continue
            at, start = how.base[left] + (rank - how.used[left]) * left, 0
            while start < left:
                sequence, offset = divmod(at, size)
                take = min(left - start, size - offset)
                out.append((doc_id, n - left + start, take, zlib.crc32(ids[start : start + take]), n, how.sequences + sequence, offset))
                at, start = at + take, start + take
        columns = zip(*out, strict=True) if out else [[]] * len(PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECES)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    schema = "task long, doc_id long, n long, crcs array<long>, left int, rest binary, nth_left long, nth_full long"
    encoded = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encode(b, tokenizer, size), schema), "encoded")
    counts = scratch.save(encoded.groupBy("task", "left").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / size)).alias("full")), "counts")
    histogram = {r["left"]: r["docs"] for r in counts.groupBy("left").agg(F.sum("docs").alias("docs")).collect()}  # size rows at most
    before = lambda c, w: (F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(c)).cast("long")
    tasks = counts.groupBy("task").agg(F.sum("full").alias("full"))  # a row a task
    full_before = tasks.select("task", before("full", W.orderBy("task")).alias("full_before"))
    left_before = counts.select("task", "left", before("docs", W.partitionBy("left").orderBy("task")).alias("left_before"))
    offsets = scratch.save(left_before.join(full_before, "task"), "offsets")
    how = plan(histogram, size)
    # merged whatever its size: the offsets grow with the tasks
    placed = encoded.join(offsets.hint("merge"), ["task", "left"]).select("doc_id", "n", "crcs", "left", "rest", "nth_left", "nth_full", "left_before", "full_before")
    return placed.mapInArrow(lambda b: _place(b, how), ", ".join(f"`{f.name}` long" for f in PIECES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
