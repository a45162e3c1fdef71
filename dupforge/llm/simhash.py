"""Operator 9, SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64 bits from the XXH64 (seed 42) of a text's 3-word shingles, repeats included; a bit is set if it is set in over
half of the hashes. Documents are linked where fingerprints differ in 3 bits or fewer; groups are the connected components.

Equal fingerprints are one node, so a group of copies of any size costs one comparison partner. The bits are parted into m + 3
bands: two fingerprints in reach agree on m bands at least, so a table for each choice of m bands meets every pair. m follows
from the number of distinct fingerprints, so that chance meetings stay few. Each table is sorted by its bands; runs of whole
buckets are compared as blocks: bit planes are stored vertically, 64 fingerprints to a word, distances are counted by carry-save
counters, and a row is abandoned once all of its counters have passed the radius. A bucket too large for a block is dealt
into tiles, each pair of tiles compared by a task of its own. A block gives a spanning forest of its links, never its pairs.

Defined results: null text and text without words have fingerprint zero, linked like any other; a null doc_id gets its group's
id, which is null only if all doc_ids of the group are; rows that repeat give rows that repeat; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import Scratch, documents, numbered, steady
from dupforge.operators.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints compared as one block at least; a bucket over LARGEST_BLOCK is dealt into tiles of about half of that.
BLOCK = 1024
LARGEST_BLOCK = 16384
#: Chance meetings for each fingerprint and table, above which one more band has to agree.
CHANCE = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """text: UTF-8. bytes.lower() and bytes.split() know ASCII only, as asked."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.cast(batch.column("text"), pa.binary())
        fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["row_id", "doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id (the place in docs), doc_id, fp (the 64 bits as a long) for each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle), "row_id long, doc_id long, fp long")


def forest(fps: np.ndarray, radius: int = RADIUS, rows: int = 128) -> np.ndarray:
    """For each of the fingerprints the place of another one that it is connected with through links among them, or its own: places of a component's fingerprints are all led to its least place. radius is 1, 3, 7 or so."""
    n, counters = len(fps), (radius + 1).bit_length() - 1
    if radius + 1 != 1 << counters:
        raise ValueError("radius has to be one less than a power of two")
    label = np.arange(n)
    width = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, width * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view("<u8")
    pad = np.zeros(width, np.uint64)
    if n % 64:
        pad[-1] = np.uint64((1 << 64) - (1 << (n % 64)))
    sign = (-(bits.astype(np.int64))).view(np.uint64).T.copy()
    for top in range(0, n, rows):
        end, lo = min(n, top + rows), top // 64
        shape = (end - top, width - lo)
        count = [np.zeros(shape, np.uint64) for _ in range(counters)]
        over = np.broadcast_to(pad[lo:], shape).copy()
        # a row meets the columns after it; those before it have met it
        own = np.arange(top, end)
        for i in own.tolist():
            over[i - top, : i // 64 - lo] = FULL
            over[i - top, i // 64 - lo] |= np.uint64((2 << (i % 64)) - 1)
        carry, spare = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
        for b in range(64):
            np.bitwise_xor(planes[b, lo:], sign[b, own, None], out=carry)
            for c in count:
                np.bitwise_and(c, carry, out=spare)
                np.bitwise_xor(c, carry, out=c)
                carry, spare = spare, carry
            np.bitwise_or(over, carry, out=over)
            if b >= 12 and b % 4 == 0:
                left = np.flatnonzero(np.bitwise_and.reduce(over, axis=1) != FULL)
                if 4 * len(left) <= 3 * len(own):
                    own, over, count = own[left], over[left], [c[left] for c in count]
                    carry, spare = np.empty_like(over), np.empty_like(over)
                if not len(left):
                    break
        near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
        for i in np.flatnonzero(near.any(1)).tolist():
            met = np.flatnonzero(near[i]) + lo * 64
            roots = np.unique(label[np.append(met, own[i])])
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    return label


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(fps: np.ndarray, radius: int) -> pa.RecordBatch:
    label = forest(fps.view(np.uint64), radius)
    at = np.flatnonzero((label != np.arange(len(fps))) & (fps[label] != fps))
    return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[label[at]])], schema=EDGES)


def _compare_runs(batches: Iterator[pa.RecordBatch], radius: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by table and key. Whole buckets are gathered up to a block. A fingerprint alone in its bucket meets nobody there and is left out."""
    held: list[np.ndarray] = []
    n, tail_key, tail = 0, None, np.array([], np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        keys = np.stack([batch.column("t").to_numpy().astype(np.int64), batch.column("key").to_numpy()], 1)
        if not len(fps):
            continue
        if len(tail):
            fps, keys = np.concatenate([tail, fps]), np.concatenate([np.repeat(tail_key[None], len(tail), 0), keys])
        cuts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
        tail_key, tail = keys[cuts[-1]], fps[cuts[-1] :]
        sizes = np.diff(cuts)
        keep = np.repeat(sizes > 1, sizes)
        fps, sizes = fps[: cuts[-1]][keep], sizes[sizes > 1]
        ends, start = np.cumsum(sizes), 0
        while start < len(fps):
            # up to the end of the bucket with which the block is full
            k = min(int(np.searchsorted(ends, start + block - n)), len(ends) - 1)
            held.append(fps[start : ends[k]])
            n += int(ends[k]) - start
            start = int(ends[k])
            if n >= block:
                yield _edges(np.concatenate(held), radius)
                held, n = [], 0
    if len(tail) > 1:
        held.append(tail)
    if held:
        yield _edges(np.concatenate(held), radius)


def _tables(n: int, radius: int) -> list[int]:
    """Masks: each choice of m among m + radius bands."""
    m = next(m for m in range(1, 64 - radius) if n / 2 ** (64 * m / (m + radius)) <= CHANCE)
    at = np.linspace(0, 64, m + radius + 1).round().astype(int).tolist()
    bands = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]
    return [sum(x) for x in combinations(bands, m)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, block: int = BLOCK, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """distinct: fp. Edges a, b with the same connected components as all pairs of fingerprints in reach."""
    spark = distinct.sparkSession
    masks = _tables(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key")) for t, m in enumerate(masks)))).alias("k")).select("k.t", "k.key", "fp")
    hot = scratch.save(keyed.groupBy("t", "key").count().filter(F.col("count") > largest_block), "hot")
    large = not hot.isEmpty()
    usual = keyed.join(hot, ["t", "key"], "left_anti") if large else keyed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = usual.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda b: _compare_runs(b, radius, block), "a long, b long")
    if large:
        tile = F.ceil(F.col("count") / (largest_block // 2)).cast("int")
        placed = keyed.join(hot.withColumn("tiles", tile), ["t", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        dealt = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("t", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")

        def compare(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_edges(table.column("fp").to_numpy(), radius)], EDGES)

        found = found.unionByName(dealt.groupBy("t", "key", "lo", "hi").applyInArrow(compare, "a long, b long"))
    return found


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """row_id, doc_id, fp, component_id (the least doc_id of the group) for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), scratch, radius, block, largest_block), "a", "b", scratch)
    linked = scratch.save(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "component", "least"), "linked")
    least = scratch.save(linked.groupBy("component").agg(F.min("least").alias("of_group")), "groups")
    of_linked = linked.join(least, "component").select("fp", "of_group")
    classes = scratch.save(distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("of_group", "least").alias("component_id")), "classes")
    return fps.join(classes, "fp").select("row_id", "doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group the document with the least doc_id, once. Rows without doc_id stay."""
    docs = steady(docs, Scratch(docs.sparkSession, "simhash"))
    groups = near_groups(docs, shingle, radius)
    least = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("row_id").alias("_row")).select("_row")
    keep = least.unionByName(groups.filter("doc_id is null").select(F.col("row_id").alias("_row")))
    return numbered(docs).join(keep, "_row", "left_semi").select("doc.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
