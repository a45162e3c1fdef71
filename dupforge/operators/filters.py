"""The scan's filters: for each file the first reason to leave it out, and counts of them. One pass, no shuffle but for the counts."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupforge.functions import fixed
from dupforge.functions.names import extension, fold

INCLUDED, HIDDEN, EXTENSION, INCOMPLETE, KEYWORD, SMALL, LARGE = "included", "hidden_system", "extension", "incomplete", "keyword", "too_small", "too_large"
#: In the order in which they are tried.
REASONS = (HIDDEN, EXTENSION, INCOMPLETE, KEYWORD, SMALL, LARGE)
MAX_MB = 10_000_000


@dataclass(frozen=True)
class ScanOptions:
    recursive: bool = True
    #: None: videos; empty: all files.
    extensions: tuple[str, ...] | None = None
    min_size: int = 0
    #: 0: no limit.
    max_size: int = 0
    skip_hidden: bool = True
    skip_incomplete: bool = True
    keywords: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def checked(self) -> ScanOptions:
        if self.min_size < 0 or self.max_size < 0:
            raise ValueError("sizes can't be negative")
        if self.max_size and self.max_size < self.min_size:
            raise ValueError("the largest size is below the smallest")
        return replace(self, keywords=keywords(self.keywords), extensions=None if self.extensions is None else tuple("." + x.lower().lstrip(".") for x in self.extensions))


def keywords(values: Iterable[str]) -> tuple[str, ...]:
    """NFKC, stripped and case-folded, each once."""
    return tuple(dict.fromkeys(x for v in values if (x := unicodedata.normalize("NFKC", str(v)).strip().casefold())))


def parse_keywords(text: str) -> tuple[str, ...]:
    return keywords(re.split(r"[,;，；\n\r]", str(text)))


def parse_extensions(text: str) -> tuple[str, ...]:
    out = []
    for raw in re.split(r"[,;，；\s]", str(text)):
        value = raw.casefold().lstrip("*").lstrip(".")
        if value and not re.fullmatch("[a-z0-9]{1,12}", value):
            raise ValueError(f"not an extension: {raw}")
        if value:
            out.append(f".{value}")
    return tuple(dict.fromkeys(out))


def parse_megabytes(value: object) -> float:
    """A size as people write it: blank is 0, a comma may stand for the point."""
    text = str(value).strip().replace(",", ".")
    number = float(text) if text else 0.0
    if not math.isfinite(number) or not 0 <= number <= MAX_MB:
        raise ValueError(f"not a size between 0 and {MAX_MB} MB: {value}")
    return number


def megabytes_to_bytes(value: float) -> int:
    return max(0, int(float(value) * (1 << 20)))


def format_megabytes(value: object) -> str:
    try:
        number = parse_megabytes(value)
    except ValueError:
        return "0"
    return f"{number:.3f}".rstrip("0").rstrip(".")


def is_hidden(name: Column, attributes: Column) -> Column:
    return name.startswith(".") | (F.coalesce(attributes, F.lit(0)).bitwiseAND(F.lit(fixed.HIDDEN | fixed.SYSTEM)) != 0)


def is_incomplete(name: Column) -> Column:
    low = F.lower(name)
    out = low.startswith("~$")
    for suffix in fixed.INCOMPLETE_SUFFIXES:
        out = out | low.endswith(suffix)
    return out


def has_keyword(name: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    folded = fold(name)
    for word in words:
        out = out | F.contains(folded, F.lit(word))
    return out


def has_extension(name: Column, extensions: tuple[str, ...] | None) -> Column:
    allowed = fixed.VIDEO_EXTENSIONS if extensions is None else extensions
    return extension(name).isin(*allowed) if allowed else F.lit(True)


def reason(options: ScanOptions) -> Column:
    """Why a file (name, size, attributes) is left out, or that it is included."""
    o, name, size = options.checked(), F.col("name"), F.col("size")
    tests = [
        (HIDDEN, is_hidden(name, F.col("attributes")) if o.skip_hidden else None),
        (EXTENSION, ~has_extension(name, o.extensions)),
        (INCOMPLETE, is_incomplete(name) if o.skip_incomplete else None),
        (KEYWORD, has_keyword(name, o.keywords) if o.keywords else None),
        (SMALL, size < o.min_size if o.min_size else None),
        (LARGE, size > o.max_size if o.max_size else None),
    ]
    out = None
    for label, test in tests:
        if test is not None:
            out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(INCLUDED)


def in_folder(folder: Column, excluded: str) -> Column:
    top = excluded.rstrip("/")
    return (folder == top) | folder.startswith(f"{top}/")


def not_excluded(files: DataFrame, excluded: Iterable[str]) -> DataFrame:
    for folder in excluded:
        files = files.filter(~in_folder(F.col("folder"), folder))
    return files


def not_in(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files outside of all folders of a table (folder), however many: each file is asked for by all folders above it."""
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    hit = files.select("path", F.explode(above).alias("folder")).join(folders.select(F.regexp_replace("folder", "/+$", "").alias("folder")), "folder", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def waterfall(files: DataFrame, options: ScanOptions) -> DataFrame:
    return not_excluded(files, options.excluded).withColumn("reason", reason(options))


def statistics(judged: DataFrame) -> DataFrame:
    """One row: files seen, included, and left out for each reason."""
    counts = [F.count_if(F.col("reason") == r).alias(f"skipped_{r}") for r in REASONS]
    return judged.agg(F.count("*").alias("regular_files_seen"), F.count_if(F.col("reason") == INCLUDED).alias("included_files"), *counts, F.count_if(F.col("reason") != INCLUDED).alias("filtered_files"))


LABELS = {SMALL: "小文件", LARGE: "超大文件", EXTENSION: "非目标类型", HIDDEN: "隐藏/系统文件", INCOMPLETE: "临时/未完成文件", KEYWORD: "关键字排除"}


def summary(stats: DataFrame) -> DataFrame:
    parts = [F.when(F.col(f"skipped_{r}") > 0, F.concat(F.lit(f"{label} "), F.col(f"skipped_{r}").cast("string"))) for r, label in LABELS.items()]
    return stats.withColumn("summary", F.coalesce(F.nullif(F.concat_ws("、", *parts), F.lit("")), F.lit("未筛除文件")))
