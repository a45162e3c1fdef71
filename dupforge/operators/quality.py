"""Which file of a group is best, what deleting the others frees, and whether lengths speak against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupforge.functions import fixed
from dupforge.functions.labels import fixed_point, guessed_height, identity_label, quality_rank
from dupforge.functions.names import extension
from dupforge.operators.order import positions


def with_rank(members: DataFrame) -> DataFrame:
    for c in ("width", "height"):
        if c not in members.columns:
            members = members.withColumn(c, F.lit(None).cast("int"))
    return members.withColumn("quality", quality_rank(F.col("name"), F.col("size"), F.col("width"), F.col("height")))


def best(members: DataFrame, tie: str = "idx") -> DataFrame:
    """group, keep: the file of the highest rank, of equal ones the one with the least tie. By an aggregate, so large groups are combined before the shuffle."""
    return with_rank(members).groupBy("group").agg(F.max(F.struct("quality", (-F.col(tie)).alias("back"))).alias("b")).select("group", (-F.col("b.back")).alias("keep"), F.col("b.quality").alias("quality"))


def savings(members: DataFrame) -> DataFrame:
    """group, n_files, total_size, estimated_savings, duration_span."""
    rows = with_rank(members)
    lasting = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")) if "duration_seconds" in rows.columns else F.lit(None).cast("double")
    g = rows.groupBy("group").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max("quality").alias("q"), F.count(lasting).alias("n"), (F.max(lasting) - F.min(lasting)).alias("span"))
    return g.select("group", "n_files", "total_size", F.when(F.col("n_files") >= 2, F.col("total_size") - F.col("q.size")).otherwise(0).alias("estimated_savings"), F.when(F.col("n") >= 2, F.col("span")).alias("duration_span"))


def display_names(members: DataFrame) -> DataFrame:
    """group, display_name: what a report says (display_name_override, the first that isn't blank); else a catalog key in capitals, that of the first file with one; else the shortest title, the first of equally short ones. members: group, pos, name_info."""
    key = F.when(F.col("name_info.catalog_key").isNotNull(), F.col("pos"))
    shown = F.col("name_info.cleaned_display")
    said = F.nullif(F.trim("display_name_override"), F.lit("")) if "display_name_override" in members.columns else F.lit(None).cast("string")
    g = members.groupBy("group").agg(
        F.min_by("name_info.catalog_key", key).alias("k"), F.min_by(shown, F.struct(F.length(shown).alias("n"), F.col("pos"))).alias("d"), F.min_by(said, F.when(said.isNotNull(), F.col("pos"))).alias("o")
    )
    return g.select("group", F.coalesce("o", F.upper("k"), "d").alias("display_name"))


def numbered(groups: DataFrame, tie: str = "group") -> DataFrame:
    """groups and number, from 1 on: largest savings first, then most files. groups: estimated_savings, n_files."""
    return positions(groups, F.desc("estimated_savings"), F.desc("n_files"), F.asc(tie), name="number")


def assess(members: DataFrame) -> DataFrame:
    """group, safety_warning, metadata_note. members: group, match_kind, content_md5, duration_seconds, height."""
    d = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    h, md5 = F.when(F.col("height") > 0, F.col("height")), F.nullif("content_md5", F.lit(""))
    g = members.groupBy("group", "match_kind").agg(*(f(c).alias(n) for n, f, c in (("d0", F.min, d), ("d1", F.max, d), ("dn", F.count, d), ("h0", F.min, h), ("h1", F.max, h), ("hn", F.count, h), ("m0", F.min, md5), ("m1", F.max, md5))))
    same = (F.col("match_kind") == "hash") & F.coalesce(F.col("m0") == F.col("m1"), F.lit(False))
    gap, several = F.col("d1") - F.col("d0"), F.col("dn") >= 2
    close = several & (gap <= F.greatest(F.lit(8.0), F.col("d0") * 0.01))
    far = several & ~close & (gap > F.greatest(F.lit(30.0), F.col("d0") * 0.03))
    text = F.when(gap >= 60, F.concat(fixed_point(gap / 60, 1), F.lit(" 分钟"))).otherwise(F.concat(fixed_point(gap, 0), F.lit(" 秒")))
    length_note = F.when(close, "视频时长接近").when(far, F.concat(F.lit("片长相差约 "), text, F.lit("，可能不是同一内容或存在缺失"))).when(several, "片长存在小幅差异，建议播放复核")
    height_note = F.when((F.col("hn") >= 2) & (F.col("h1") >= 2 * F.col("h0")), "分辨率差异较大")
    note = F.when(same, "同尺寸且完整 MD5 相同").otherwise(F.concat_ws("；", length_note, height_note))
    return g.select("group", (~same & F.coalesce(far, F.lit(False))).alias("safety_warning"), note.alias("metadata_note"))


def smart_choice(members: DataFrame, assessed: DataFrame, tie: str = "idx") -> DataFrame:
    """group, idx, action: the best is kept; the others are marked for deletion, unless a warning leaves them undecided."""
    rows = members.join(best(members, tie), "group").join(assessed.select("group", "safety_warning"), "group", "left")
    protected = F.coalesce("safety_warning", F.lit(False)) & (F.col("match_kind") != "hash")
    action = F.when(F.col(tie) == F.col("keep"), fixed.KEEP).when(protected, fixed.UNDECIDED).otherwise(fixed.DELETE)
    return rows.select("group", tie, "size", action.alias("action"))


def mark(members: DataFrame, chosen: DataFrame, action: str) -> DataFrame:
    """members with action set on the chosen (group, idx). Keeping one lets go of what was kept before. Deletion isn't marked in groups that it would leave without a file; refused() tells them."""
    hit = members.join(chosen.select("group", "idx", F.lit(True).alias("_hit")).distinct(), ["group", "idx"], "left")
    if action == fixed.KEEP:
        groups = chosen.select("group").distinct().withColumn("_group", F.lit(True))
        hit = hit.join(groups, "group", "left")
        old = F.when(F.col("_group") & (F.col("action") == fixed.KEEP), fixed.UNDECIDED).otherwise(F.col("action"))
        return hit.withColumn("action", F.when(F.col("_hit"), action).otherwise(old)).drop("_hit", "_group")
    if action == fixed.DELETE:
        hit = hit.join(refused(members, chosen).withColumn("_refused", F.lit(True)), "group", "left").withColumn("_hit", F.when(F.col("_refused").isNull(), F.col("_hit"))).drop("_refused")
    return hit.withColumn("action", F.when(F.col("_hit"), action).otherwise(F.col("action"))).drop("_hit")


def refused(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Groups that would have no file left if the chosen were marked for deletion beside those that are."""
    left = members.join(chosen.select("group", "idx"), ["group", "idx"], "left_anti").filter(F.col("action") != fixed.DELETE)
    return chosen.select("group").distinct().join(left.select("group").distinct(), "group", "left_anti")


def without_survivor(members: DataFrame) -> DataFrame:
    """Groups of which every file is marked for deletion."""
    return members.groupBy("group").agg(F.count_if(F.col("action") != fixed.DELETE).alias("left")).filter("left = 0").select("group")


def action_summary(members: DataFrame) -> DataFrame:
    marked = F.col("action") == fixed.DELETE
    return members.agg(F.count_if(marked).alias("marked"), F.coalesce(F.sum(F.when(marked, F.col("size"))), F.lit(0)).alias("bytes"))


def display_order(rows: DataFrame, key: str | Column, tie: str | Column, descending: bool = False) -> DataFrame:
    """rows and position: known values in order, unknown ones always last, in order of tie."""
    rows = rows.withColumns({"_key": F.col(key) if isinstance(key, str) else key, "_tie": F.col(tie) if isinstance(tie, str) else tie})
    known = F.col("_key").isNotNull()
    values = (F.desc_nulls_last("_key") if descending else F.asc_nulls_last("_key"), F.when(known & F.lit(descending), F.col("_tie")).desc(), F.col("_tie").asc())
    return positions(rows, (~known).asc(), *values).drop("_key", "_tie")


def file_key(column: str) -> Column:
    """What files are ordered by where a list is sorted by one of its columns. Columns that aren't known sort by name."""
    height = F.coalesce(F.nullif("height", F.lit(0)), guessed_height(F.col("name")))
    order = F.create_map(*(F.lit(x) for k, a in enumerate((fixed.UNDECIDED, fixed.KEEP, fixed.DELETE, fixed.IGNORE)) for x in (a, k)))
    info = lambda f: F.col(f"name_info.{f}")
    keys = {
        "action": lambda: F.coalesce(F.try_element_at(order, F.col("action")), F.lit(0)), "name": lambda: F.lower("name"), "work": lambda: F.lower(info("cleaned_display")), "identity": lambda: identity_label(info("identity_kind")),
        "source": lambda: info("identity_source"), "segment": lambda: F.coalesce(info("part_marker"), F.lit("")), "relation": lambda: F.coalesce(F.nullif("content_md5", F.lit("")), F.col("hash_source")), "size": lambda: F.col("size"),
        "resolution": lambda: F.coalesce(F.nullif("width", F.lit(0)), F.floor(height * 16 / 9).cast("int")) * height, "duration": lambda: F.col("duration_seconds"), "format": lambda: extension(F.col("name")),
        "codec": lambda: F.nullif(F.lower("codec"), F.lit("")), "md5": lambda: F.nullif("content_md5", F.lit("")), "hash_status": lambda: F.col("hash_source"), "modified": lambda: F.col("mtime"), "folder": lambda: F.lower("folder"),
    }
    return keys.get(column, keys["name"])()


def group_key(column: str) -> Column:
    """The same for groups: display_name, basis, n_files, exact_sets, estimated_savings, duration_span, confidence."""
    keys = {"kind": "basis", "count": "n_files", "exact_sets": "exact_sets", "saving": "estimated_savings", "duration_span": "duration_span", "confidence": "confidence"}
    return F.col(keys[column]) if column in keys else F.lower("display_name")


def sorted_files(members: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Files in the order of a column, ties by path."""
    return display_order(members, file_key(column), F.lower("path"), descending)


def sorted_groups(groups: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Groups in the order of a column, ties by name."""
    return display_order(groups, group_key(column), F.lower("display_name"), descending)


def exact_sets(members: DataFrame) -> DataFrame:
    """group, exact_sets: how many digests two files of a group or more share."""
    md5 = F.nullif("content_md5", F.lit(""))
    sets = members.filter(md5.isNotNull()).groupBy("group", "content_md5").agg(F.count("*").alias("n"))
    return members.select("group").distinct().join(sets.filter("n >= 2").groupBy("group").agg(F.count("*").alias("s")), "group", "left").select("group", F.coalesce("s", F.lit(0)).alias("exact_sets"))
