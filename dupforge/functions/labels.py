"""Derived columns of files and groups, and how they are written for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dupforge.functions import fixed
from dupforge.functions.names import extension, stem

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def fixed_point(x: Column, digits: int) -> Column:
    """A number of 0 or more with so many decimals, rounded as it is in binary, halves to even. (Java's formatter rounds the
    shortest decimal that reads back the same.) The product with a power of ten is compared in two parts, each exact."""
    scale = 10**digits
    high = x.cast("float").cast("double")
    q = F.floor(x * scale)
    over = (high * scale - (q + 0.5)) + (x - high) * scale
    n = q + F.when(over > 0, 1).when(over == 0, q % 2).otherwise(0)
    whole = F.floor(n / scale).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")) if digits else whole


def format_bytes(size: Column) -> Column:
    size = F.greatest(size.cast("double"), F.lit(0.0))
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        text = F.concat(fixed_point(size / 1024.0**k, 2), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == UNITS[-1] else out.when(size < 1024.0 ** (k + 1), text)
    return out


def format_duration(seconds: Column) -> Column:
    total = F.greatest(F.bround(seconds, 0), F.lit(0.0)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(total / 3600)
    hour_text = F.when(hours >= 100, hours.cast("string")).otherwise(two(hours))
    rest = F.concat_ws(":", two(F.floor(total % 3600 / 60)), two(total % 60))
    return F.when(seconds.isNull(), "未知").when(hours > 0, F.concat_ws(":", hour_text, rest)).otherwise(rest)


def guessed_height(name: Column) -> Column:
    s = F.lower(stem(name))
    out = F.when(F.contains(s, F.lit("8k")), 4320).when(F.contains(s, F.lit("4k")) | F.contains(s, F.lit("2160p")), 2160)
    for height in (1440, 1080, 720, 576, 480, 360):
        out = out.when(s.rlike(f"(?<![0-9]){height}[pi]?(?![0-9])"), height)
    return out


def resolution(width: Column, height: Column, guess: Column) -> Column:
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return F.when(known, F.concat(width.cast("string"), F.lit("×"), height.cast("string"))).when(guess.isNotNull(), F.concat(F.lit("约 "), guess.cast("string"), F.lit("P（文件名）"))).otherwise("未知")


def extension_rank(name: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in fixed.EXTENSION_RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, extension(name)), F.lit(0))


def quality_rank(name: Column, size: Column, width: Column, height: Column) -> Column:
    """A struct that compares as quality does: pixels, whether they are measured, the container, the size."""
    known = F.coalesce(F.nullif(height, F.lit(0)), guessed_height(name), F.lit(0)).cast("long")
    wide = F.coalesce(F.nullif(width.cast("long"), F.lit(0)), F.floor(known * 16 / 9))
    measured = F.when(F.coalesce(height, F.lit(0)) > 0, 1).otherwise(0)
    return F.struct((wide * known).alias("pixels"), measured.alias("measured"), extension_rank(name).alias("container"), size.cast("long").alias("size"))


def part_label(marker: Column) -> Column:
    value = F.regexp_extract(marker, "^[^:]*:(.*)$", 1)
    return (
        F.when(F.coalesce(marker, F.lit("")) == "", "未标分段")
        .when(marker.rlike("^part[0-9]+$"), F.concat(F.lit("第 "), F.regexp_replace(F.substring(marker, 5, 20), "^0+(?=.)", ""), F.lit(" 段")))
        .when(marker.startswith("segment:"), F.when(value.isin("A", "B"), F.concat(value, F.lit(" 段"))).otherwise(value))
        .when(marker.startswith("disc:"), F.concat(F.lit("光盘段 "), F.upper(value)))
        .otherwise(marker)
    )


def identity_label(kind: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in fixed.IDENTITY_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, kind), kind)


def match_label(kind: Column) -> Column:
    return F.when(kind == "hash", "MD5").when(kind == "mixed", "混合").otherwise("作品身份")


def basis_label(match_kind: Column, least_label: Column, greatest_label: Column) -> Column:
    return F.when(match_kind == "hash", "完整 MD5").when(match_kind == "mixed", "身份 + MD5").when(least_label == greatest_label, least_label).otherwise("多种身份")


def content_relation(md5: Column, same: Column, hash_source: Column) -> Column:
    """same: how many of the group have this md5."""
    twin = F.concat(F.lit("MD5相同 ×"), same.cast("string"), F.lit("（"), F.substring(md5, 1, 8), F.lit("…）"))
    return F.when(F.coalesce(md5, F.lit("")) != "", F.when(same >= 2, twin).otherwise("MD5已验证（组内不同）")).when(hash_source == fixed.HASH_DIFFERENT, "快速指纹不同").otherwise("作品身份相似（内容未确认）")


def file_id(path: Column) -> Column:
    return F.substring(F.sha1(F.lower(path)), 1, 16)


def group_id(paths: Column) -> Column:
    """paths: all paths of a group, as an array."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.transform(paths, F.lower)), "\n")), 1, 12)


def column_order(saved: list[str] | None, known: list[str]) -> list[str]:
    """Known columns, each once: as saved, then those that weren't."""
    return list(dict.fromkeys([c for c in (saved or []) if c in known] + known))
