"""Exact duplicates by content: size buckets, then a fingerprint of three spans, then the MD5 of all, each only where the step before
found company.

With the content in a column all of this is DataFrame operations: contents are hashed where they are read, and never shuffled; what a
step may leave out it knows by marks of bounded size. Files on disk are read by read_fingerprints() and read_md5(), the latter only
where it is needed. Buckets are counted with partial aggregates and written before they are joined back, so that adaptive execution
can split a size that a third of all files share.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupforge.functions import fixed
from dupforge.operators.scopes import group_aggregates, group_allowed, partition_key
from dupforge.scratch import Scratch

OFF, SMART, DEEP = MODES = ("off", "smart", "deep")
READ_BYTES = 4 << 20


def checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"no such hash mode: {mode}")
    return mode


def spans(size: Column) -> Column:
    """Offsets and lengths that the fingerprint looks at: all of a small file, else head, middle and tail."""
    s = fixed.SAMPLE_BYTES
    part = lambda at: F.struct(at.cast("long").alias("offset"), F.lit(s).cast("long").alias("length"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), size.cast("long").alias("length")))
    return F.when(size <= 3 * s, whole).otherwise(F.array(part(F.lit(0)), part(F.floor((size - s) / 2)), part(size - s)))


def sample_bytes(size: Column) -> Column:
    return F.least(size, F.lit(3 * fixed.SAMPLE_BYTES)).cast("long")


def keyed_groups(files: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """keys (and part, the scope's own) of groups that the scope allows, with n_files."""
    return files.withColumn("part", partition_key(scope)).groupBy(*keys, "part").agg(*group_aggregates()).filter(group_allowed(scope)).select(*keys, "part", "n_files")


def members(files: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Files of such groups."""
    groups = Scratch(files.sparkSession, "members").save(keyed_groups(files, keys, scope).drop("n_files"), "groups")
    return files.withColumn("part", partition_key(scope)).join(groups, [*keys, "part"], "left_semi")


def size_buckets(files: DataFrame, scope: str = "all") -> DataFrame:
    return keyed_groups(files, ["size"], scope)


def workload(files: DataFrame, mode: str = SMART, scope: str = "all") -> DataFrame:
    """One row: groups, candidate files, bytes of samples and of everything that might be read."""
    if checked(mode) == OFF:
        return files.limit(0).agg(*(F.count("*").alias(c) for c in ("groups", "candidates", "sample_bytes", "max_bytes")))
    b = size_buckets(files, scope)
    n = F.col("n_files")
    return b.agg(F.count("*").alias("groups"), F.coalesce(F.sum(n), F.lit(0)).alias("candidates"), F.coalesce(F.sum(n * sample_bytes(F.col("size"))), F.lit(0)).alias("sample_bytes"), F.coalesce(F.sum(n * F.col("size")), F.lit(0)).alias("max_bytes"))


def quick_of_content(content: Column, size: Column) -> Column:
    """A fingerprint of the sampled bytes of a content column, by functions that the JVM has (files use BLAKE2b)."""
    data = content.cast("binary")
    s = fixed.SAMPLE_BYTES
    at = lambda o: F.hex(F.substring(data, (o + 1).cast("int"), F.lit(s)))
    text = F.when(size <= 3 * s, F.hex(data)).otherwise(F.concat(at(F.lit(0)), at(F.floor((size - s) / 2)), at(size - s)))
    return F.md5(F.concat_ws(":", size.cast("string"), text))


@F.pandas_udf(T.StringType())
def blake2_of_content(content: pd.Series, size: pd.Series) -> pd.Series:
    """The fingerprint that files have, of a content column."""

    def one(data: bytes, n: int) -> str:
        h = hashlib.blake2b(int(n).to_bytes(8, "little"), digest_size=16)
        for offset, length in file_spans(int(n)):
            h.update(offset.to_bytes(8, "little"))
            h.update(data[offset : offset + length])
        return h.hexdigest()

    return pd.Series([one(c or b"", n) for c, n in zip(content, size, strict=True)])


#: Places in a set of marks, unless others are asked for. It is made of pieces of 4 KB, so it may be broadcast whatever it was made of.
MARKS = 1 << 20


def _place(*keys: str, places: int = MARKS) -> dict[str, Column]:
    h = F.pmod(F.xxhash64(*keys), F.lit(places))
    return {"_piece": F.bitmap_bucket_number(h), "_bit": F.bitmap_bit_position(h)}


def maybe_in(rows: DataFrame, keys: DataFrame, *by: str, places: int = MARKS) -> DataFrame:
    """rows and maybe: whether keys may have the row's values of by. It is never false where they have them, and seldom true where they don't; nothing of rows is shuffled."""
    marks = keys.select(*by).withColumns(_place(*by, places=places)).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_marks"))  # as many bits as there are places, at most
    met = rows.withColumns(_place(*by, places=places)).join(F.broadcast(marks), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return met.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("_piece", "_bit", "_marks")


def with_hashes(files: DataFrame, mode: str = SMART, scope: str = "all", quick: Column | None = None) -> DataFrame:
    """files without content, and quick, content_md5, hash_source. First sizes are counted, without contents. Then contents are looked
    at where a size isn't alone: fingerprints, and of small files the MD5 too. Last, of large files the MD5 where fingerprints agree
    (smart) or of all candidates (deep). Paths are unique."""
    if checked(mode) == OFF:
        return files.drop("content").withColumns({"quick": F.lit(None).cast("string"), "content_md5": F.lit(None).cast("string"), "hash_source": F.lit(fixed.HASH_NONE)})
    scratch = Scratch(files.sparkSession, "hashes")
    groups = lambda r, *keys: r.groupBy(*keys, "part").agg(*group_aggregates()).filter(group_allowed(scope)).select(*keys, "part")
    files = files.withColumn("part", partition_key(scope))
    small, md5 = F.col("size") <= 3 * fixed.SAMPLE_BYTES, F.md5(F.col("content").cast("binary"))
    taken = quick if quick is not None else quick_of_content(F.col("content"), F.col("size"))
    buckets = scratch.save(groups(files, "size").withColumn("same_size", F.lit(True)), "sizes")
    looked = maybe_in(files, buckets, "size", "part").withColumns({"_quick": F.when(F.col("maybe"), taken), "_md5": F.when(F.col("maybe") & small, md5)})
    rows = scratch.save(looked.drop("content", "maybe"), "looked-at").join(buckets, ["size", "part"], "left")
    alike = scratch.save(groups(rows.filter("same_size"), "size", "_quick").withColumn("same_quick", F.lit(True)), "fingerprints")
    rows = rows.join(alike, ["size", "_quick", "part"], "left")
    candidate = F.coalesce("same_size", F.lit(False))
    wanted = candidate & (F.coalesce("same_quick", F.lit(False)) | small | F.lit(mode == DEEP))
    rows = scratch.save(rows.withColumns({"candidate": candidate, "wanted": wanted}), "judged")
    large = rows.filter(F.col("wanted") & ~small)
    if not large.isEmpty():
        again = maybe_in(files.filter(~small), large, "path").filter("maybe").select("path", md5.alias("_full"))
        rows = rows.join(scratch.save(again, "full"), "path", "left").withColumn("_md5", F.coalesce("_md5", "_full")).drop("_full")
    source = F.when(~F.col("candidate"), fixed.HASH_NONE).when(small, fixed.HASH_SMALL).when(F.col("wanted"), fixed.HASH_FULL).otherwise(fixed.HASH_DIFFERENT)
    out = {"quick": F.when(F.col("candidate"), F.col("_quick")), "content_md5": F.when(F.col("wanted"), F.col("_md5")), "hash_source": source}
    return rows.withColumns(out).drop("same_size", "same_quick", "part", "_quick", "_md5", "candidate", "wanted")


def exact_groups(hashed: DataFrame, scope: str = "all") -> DataFrame:
    """size, content_md5, part, n_files, savings (bytes that deleting all but one frees)."""
    g = keyed_groups(hashed.filter("content_md5 is not null"), ["size", "content_md5"], scope)
    return g.withColumn("savings", (F.col("n_files") - 1) * F.col("size"))


def hash_statistics(hashed: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    quick, full = F.col("quick").isNotNull(), F.col("content_md5").isNotNull()
    small = F.col("hash_source") == fixed.HASH_SMALL
    return hashed.agg(
        n(quick).alias("candidate_files"), F.coalesce(F.sum(F.when(quick, sample_bytes(F.col("size")))), F.lit(0)).alias("quick_bytes"),
        F.coalesce(F.sum(F.when(full & ~small, F.col("size"))), F.lit(0)).alias("full_bytes"), n(full).alias("md5_computed"),
    )


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, mtime_ns, ctime_ns, quick) and cached_md5, where the cache has the path in the same state and the fresh fingerprint agrees."""
    c = cache.select("path", *(F.col(x).alias(f"c_{x}") for x in ("size", "mtime_ns", "ctime_ns", "quick")), F.col("md5").alias("c_md5"))
    same = F.lit(True)
    for x in ("size", "mtime_ns", "ctime_ns", "quick"):
        same = same & F.col(x).eqNullSafe(F.col(f"c_{x}"))
    return files.join(c, "path", "left").withColumn("cached_md5", F.when(same, F.col("c_md5"))).drop("c_size", "c_mtime_ns", "c_ctime_ns", "c_quick", "c_md5")


def merge_cache(old: DataFrame, new: DataFrame, newest: int = 20_000) -> DataFrame:
    """The newest entries of both, one for each path."""
    both = old.unionByName(new)
    latest = both.groupBy("path").agg(F.max(F.struct("updated", *(c for c in both.columns if c not in ("path", "updated")))).alias("e"))
    return latest.select("path", "e.*").orderBy(F.col("updated").desc(), "path").limit(newest)


def file_spans(size: int) -> list[tuple[int, int]]:
    s = fixed.SAMPLE_BYTES
    return [(0, size)] if size <= 3 * s else [(0, s), ((size - s) // 2, s), (size - s, s)]


READ = pa.schema([("path", pa.string()), ("quick", pa.string()), ("md5", pa.string()), ("error", pa.string())])


def _state(path: str) -> tuple[int, int]:
    s = os.stat(path, follow_symlinks=False)
    return s.st_size, s.st_mtime_ns


def _read(path: str, size: int, mtime_ns: int, full: bool) -> tuple[str, str | None, str | None, str | None]:
    try:
        if _state(path) != (size, mtime_ns):
            return path, None, None, "changed since the scan"
        small, md5 = size <= 3 * fixed.SAMPLE_BYTES, hashlib.md5(usedforsecurity=False)
        quick = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16)
        with open(path, "rb") as f:
            if full:
                while data := f.read(READ_BYTES):
                    md5.update(data)
            else:
                for offset, length in file_spans(size):
                    f.seek(offset)
                    data = f.read(length)
                    quick.update(offset.to_bytes(8, "little") + data)
                    if small:
                        md5.update(data)
        if _state(path) != (size, mtime_ns):
            return path, None, None, "changed while it was read"
        return path, None if full else quick.hexdigest(), md5.hexdigest() if full or small else None, None
    except OSError as e:
        return path, None, None, str(e)


def _read_batches(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_read(r["path"], r["size"], r["mtime_ns"], full) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, schema=READ)


def read_fingerprints(files: DataFrame) -> DataFrame:
    """path, quick, md5 (of small files), error of files on disk."""
    return files.select("path", "size", "mtime_ns").mapInArrow(lambda b: _read_batches(b, False), "path string, quick string, md5 string, error string")


def read_md5(files: DataFrame) -> DataFrame:
    return files.select("path", "size", "mtime_ns").mapInArrow(lambda b: _read_batches(b, True), "path string, quick string, md5 string, error string")


def exact_duplicates_on_disk(files: DataFrame, mode: str = SMART, scope: str = "all", cache: DataFrame | None = None) -> DataFrame:
    """files that are candidates, with quick, content_md5, hash_source, error. Fingerprints are read before the cache is believed."""
    if checked(mode) == OFF:
        return files.limit(0).withColumns({c: F.lit(None).cast("string") for c in ("quick", "content_md5", "hash_source", "error")})
    scratch = Scratch(files.sparkSession, "hashes")
    some = scratch.save(members(files, ["size"], scope), "candidates")
    rows = scratch.save(some.join(read_fingerprints(some), "path"), "fingerprints")  # files are read once
    rows = cached(rows, cache) if cache is not None else rows.withColumn("cached_md5", F.lit(None).cast("string"))
    small = F.col("size") <= 3 * fixed.SAMPLE_BYTES
    alike = rows.filter("error is null").groupBy("size", "quick", "part").agg(*group_aggregates()).filter(group_allowed(scope)).select("size", "quick", "part", F.lit(True).alias("same"))
    rows = rows.join(alike, ["size", "quick", "part"], "left")
    wanted = F.col("error").isNull() & ~small & F.col("cached_md5").isNull() & (F.coalesce("same", F.lit(False)) | F.lit(mode == DEEP))
    rows = scratch.save(rows.withColumn("wanted", wanted), "judged")
    full = scratch.save(read_md5(rows.filter("wanted")).select("path", F.col("md5").alias("full_md5"), F.col("error").alias("full_error")), "full")
    rows = rows.join(full, "path", "left").withColumn("error", F.coalesce("error", "full_error"))
    source = F.when(F.col("error").isNotNull(), fixed.HASH_FAILED).when(small, fixed.HASH_SMALL).when(F.col("cached_md5").isNotNull(), fixed.HASH_CACHED).when(F.col("full_md5").isNotNull(), fixed.HASH_FULL).otherwise(fixed.HASH_DIFFERENT)
    return rows.withColumns({"content_md5": F.coalesce("md5", "cached_md5", "full_md5"), "hash_source": source}).drop("md5", "cached_md5", "full_md5", "full_error", "same", "part", "wanted")


def with_relation(members_: DataFrame) -> DataFrame:
    """members (group_id, content_md5, …) and how many of the group share the md5."""
    same = F.count("content_md5").over(W.partitionBy("group_id", "content_md5"))
    return members_.withColumn("same_md5", F.when(F.col("content_md5").isNotNull(), same).otherwise(0))
