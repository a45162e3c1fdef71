"""Groups by name and groups by content made one. Groups of equal content are islands: a name may extend one island, never bridge two.

Input groups are disjoint within their kind, as both channels make them; otherwise unique_members() makes them so. group columns
may hold any values; the result's group is 'hash:<group>' or 'name:<group>'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupforge.functions.fixed import REASONS


def unique_members(members: DataFrame, order: str) -> DataFrame:
    """Each file in the first group that has it."""
    return members.withColumn("_n", F.row_number().over(W.partitionBy("idx").orderBy(order))).filter("_n = 1").drop("_n")


def merged_members(name_members: DataFrame, hash_members: DataFrame) -> DataFrame:
    """group, idx, from_name (the name group that brought a file, or null) of the merged groups."""
    n = name_members.select(F.col("group").cast("string").alias("name_group"), "idx")
    h = hash_members.select(F.col("group").cast("string").alias("hash_group"), "idx")
    met = n.join(h, "idx", "left")
    # one island, several, or none: least and greatest tell
    seen = met.groupBy("name_group").agg(F.min("hash_group").alias("island"), F.max("hash_group").alias("other"), F.count_if(F.col("hash_group").isNull()).alias("extras"))
    extra = met.filter("hash_group is null").select("name_group", "idx").join(seen, "name_group")
    joins = F.col("island").isNotNull() & (F.col("island") == F.col("other"))
    extended = extra.filter(joins).select(F.concat(F.lit("hash:"), "island").alias("group"), "idx", F.col("name_group").alias("from_name"))
    alone = extra.filter(~F.coalesce(joins, F.lit(False)) & (F.col("extras") >= 2)).select(F.concat(F.lit("name:"), "name_group").alias("group"), "idx", F.col("name_group").alias("from_name"))
    islands = h.select(F.concat(F.lit("hash:"), "hash_group").alias("group"), "idx", F.lit(None).cast("string").alias("from_name"))
    return islands.unionByName(extended).unionByName(alone)


def _remarks(groups: DataFrame, column: str) -> DataFrame:
    """group as text, metadata_note and safety_warning where groups have them, and _o, the order of the groups."""
    note = F.nullif(F.col("metadata_note"), F.lit("")) if "metadata_note" in groups.columns else F.lit(None).cast("string")
    warning = F.coalesce("safety_warning", F.lit(False)) if "safety_warning" in groups.columns else F.lit(False)
    return groups.select(F.col("group").cast("string").alias(column), F.col("group").alias("_o"), note.alias("note"), warning.alias("warning"))


def merged_groups(members: DataFrame, name_groups: DataFrame, hash_groups: DataFrame | None = None) -> DataFrame:
    """group, match_kind, confidence, reason, n_files, and of the groups that were merged metadata_note (different notes, in the order of
    groups, that of equal contents first) and safety_warning (any of them)."""
    names = _remarks(name_groups, "from_name").join(name_groups.select(F.col("group").cast("string").alias("from_name"), F.col("confidence").alias("c"), F.col("reason").alias("r")), "from_name")
    met = members.join(names, "from_name", "left")
    g = met.groupBy("group").agg(F.count("*").alias("n_files"), F.count("from_name").alias("by_name"), F.min("c").alias("c"), F.min("r").alias("r"), F.coalesce(F.bool_or("warning"), F.lit(False)).alias("w"))
    said = met.filter("note is not null").groupBy("group", "note").agg(F.min("_o").alias("at"))
    notes = said.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("notes")).select("group", F.transform("notes", lambda x: x["note"]).alias("notes"))  # different notes of one group
    g = g.join(notes, "group", "left")
    if hash_groups is not None:
        own = _remarks(hash_groups, "hash_group").select(F.concat(F.lit("hash:"), "hash_group").alias("group"), F.col("note").alias("own_note"), F.col("warning").alias("own_warning"))
        g = g.join(own, "group", "left")
    else:
        g = g.withColumns({"own_note": F.lit(None).cast("string"), "own_warning": F.lit(False)})
    island = F.col("group").startswith("hash:")
    mixed = island & (F.col("by_name") > 0)
    kind = F.when(mixed, "mixed").when(island, "hash").otherwise("name")
    reason = F.when(mixed, REASONS["mixed"]).when(island, REASONS["same_content"]).otherwise(F.col("r"))
    all_notes = F.array_distinct(F.array_compact(F.concat(F.array("own_note"), F.coalesce("notes", F.array().cast("array<string>")))))
    return g.select(
        "group", kind.alias("match_kind"), F.when(kind == "hash", 1.0).otherwise(F.col("c")).alias("confidence"), reason.alias("reason"), "n_files",
        F.array_join(all_notes, "；").alias("metadata_note"), (F.col("w") | F.coalesce("own_warning", F.lit(False))).alias("safety_warning"),
    )
