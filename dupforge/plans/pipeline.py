"""All of it in one call: names and contents, merged, assessed, decided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupforge.functions.names import with_path_info
from dupforge.operators import clusters, content, merge, quality
from dupforge.operators.order import positions
from dupforge.scratch import Scratch


@dataclass
class Found:
    """Tables of one run: files with their hashes, groups, members with actions, and a one-row summary."""

    files: DataFrame
    groups: DataFrame
    members: DataFrame
    summary: DataFrame


def indexed(files: DataFrame) -> DataFrame:
    """files and idx, their place in the order of paths."""
    return positions(files, "path", name="idx", first=0)


def find_duplicates(files: DataFrame, threshold: float = clusters.THRESHOLD, scope: str = "all", mode: str = content.SMART, by_name: bool = True) -> Found:
    """files: path, root, folder, name, size, mtime, content, and width, height, duration_seconds where known."""
    if not by_name and mode == content.OFF:
        raise ValueError("both channels are off")
    scratch = Scratch(files.sparkSession, "duplicates")
    for c, kind in (("width", "int"), ("height", "int"), ("duration_seconds", "double")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    rows = scratch.save(indexed(with_path_info(content.with_hashes(files, mode, scope))), "files")
    spark = rows.sparkSession
    if by_name:
        name_groups, name_members = clusters.name_groups(rows, threshold, scope)
    else:
        name_groups, name_members = spark.createDataFrame([], "group long, confidence double, reason string, n_files long, match_kind string"), spark.createDataFrame([], "group long, idx long")
    keys = content.exact_groups(rows, scope).select("size", "content_md5", "part")
    of_hash = content.members(rows.filter("content_md5 is not null"), ["size", "content_md5"], scope)
    hash_members = of_hash.join(keys, ["size", "content_md5", "part"], "left_semi").select(F.concat_ws("-", "size", "content_md5", F.md5("part")).alias("group"), "idx")
    members = scratch.save(merge.merged_members(name_members, hash_members), "members")
    groups = merge.merged_groups(members, name_groups).drop("metadata_note", "safety_warning")
    full = members.join(rows, "idx").join(groups.select("group", "match_kind"), "group")
    assessed = quality.assess(full)
    groups = scratch.save(groups.join(assessed, "group").join(quality.savings(full).drop("n_files"), "group"), "groups")
    actions = quality.smart_choice(full, groups)
    members = members.join(actions.select("group", "idx", "action"), ["group", "idx"])
    summary = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("estimated_savings"), F.lit(0)).alias("savings"), F.count_if(F.col("match_kind") != "name").alias("with_equal_content"))
    return Found(rows, groups, members, summary)
