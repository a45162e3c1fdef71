"""Sizes, codecs and lengths of media files. A file is probed once for each content; the others of the same MD5 share what it gave."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROBED, SHARED, FAILED, UNREAD = "ffprobe", "同 MD5 文件共享", "读取失败", "未读取"
TIMEOUT = 20
FIELDS = ("width", "height", "codec", "duration_seconds")
PAYLOAD = "struct<streams: array<struct<width: int, height: int, codec_name: string>>, format: struct<duration: string>>"


def find_ffprobe(explicit: str | None = None, bundled: tuple[str, ...] = ()) -> str | None:
    for path in (explicit, *(os.path.join(d, n) for d in bundled for n in ("ffprobe", "ffprobe.exe"))):
        if path and os.path.isfile(path):
            return path
    return shutil.which("ffprobe")


def run_ffprobe(path: str, tool: str, timeout: int = TIMEOUT) -> str | None:
    """The tool's JSON, or null if it fails or takes too long."""
    command = [tool, "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,codec_name:format=duration", "-of", "json", path]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return None
    return (done.stdout or "{}") if done.returncode == 0 else None


def payloads(files: DataFrame, run: Callable[[str], str | None]) -> DataFrame:
    """path, payload. run is called on the executors, so they have to see the files."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(run, paths), pa.string())], names=["path", "payload"])

    return files.select("path").mapInArrow(probe, "path string, payload string")


def fields(payload: Column) -> dict[str, Column]:
    """What a payload says; zero and nothing are null."""
    p = F.from_json(payload, PAYLOAD)
    first = F.get(p["streams"], F.lit(0))
    some = lambda c: F.when(c > 0, c)
    return {"width": some(first["width"]), "height": some(first["height"]), "codec": F.nullif(first["codec_name"], F.lit("")), "duration_seconds": F.nullif(p["format"]["duration"], F.lit("")).try_cast("double")}


def with_metadata(files: DataFrame, run: Callable[[str], str | None] | None = None, table: DataFrame | None = None) -> DataFrame:
    """files (path, content_md5) and width, height, codec, duration_seconds, metadata_source. table: payloads that were captured before (path, payload), instead of running a tool."""
    rows = files.drop(*FIELDS, "metadata_source")
    key = F.coalesce(F.nullif("content_md5", F.lit("")), F.concat(F.lit("path:"), "path"))
    rows = rows.withColumn("_key", key)
    chosen = rows.groupBy("_key").agg(F.min("path").alias("path"))
    got = (payloads(chosen, run) if run else chosen.join(table, "path", "left").select("path", "payload")).withColumns(fields(F.col("payload")))
    told = chosen.join(got, "path").select("_key", F.col("path").alias("_probed"), *FIELDS, (F.col("payload").isNotNull() & F.try_parse_json("payload").isNotNull()).alias("_ok"))
    met = rows.join(told, "_key", "left")
    own = F.col("path") == F.col("_probed")
    source = F.when(~F.coalesce("_ok", F.lit(False)), FAILED).when(own, PROBED).otherwise(SHARED)
    return met.withColumn("metadata_source", source).drop("_key", "_probed", "_ok")


def latest(tables: DataFrame) -> DataFrame:
    """The newest payload of each path, of captures (path, payload, at)."""
    return tables.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.col("at").desc()))).filter("_n = 1").drop("_n")


def as_json(width: int, height: int, codec: str, duration: float) -> str:
    return json.dumps({"streams": [{"width": width, "height": height, "codec_name": codec}], "format": {"duration": str(duration)}})
