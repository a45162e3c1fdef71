"""Which files may be compared: all, of one folder, of different folders, or of different roots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL, SAME_FOLDER, DIFFERENT_FOLDER, DIFFERENT_ROOT = SCOPES = ("all", "same_folder", "different_folder", "different_root")


def checked(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    return scope


def pair_allowed(scope: str, left: str = "l", right: str = "r") -> Column:
    """On a join of two file tables under these aliases."""
    of = lambda c: (F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
    (a, b), (c, d) = of("folder"), of("root")
    return {ALL: F.lit(True), SAME_FOLDER: a == b, DIFFERENT_FOLDER: a != b, DIFFERENT_ROOT: c != d}[checked(scope)]


def partition_key(scope: str) -> Column:
    return F.col("folder") if checked(scope) == SAME_FOLDER else F.lit("")


def group_aggregates() -> list[Column]:
    """What group_allowed() asks for. Least and greatest tell whether there is more than one; they combine before the shuffle, which a distinct count wouldn't."""
    return [F.count("*").alias("n_files"), *(f(c).alias(f"{name}_{c}") for c in ("folder", "root") for name, f in (("least", F.min), ("greatest", F.max)))]


def group_allowed(scope: str) -> Column:
    many = lambda c: F.col(f"least_{c}") != F.col(f"greatest_{c}")
    two = F.col("n_files") >= 2
    return {ALL: two, SAME_FOLDER: two & ~many("folder"), DIFFERENT_FOLDER: two & many("folder"), DIFFERENT_ROOT: two & many("root")}[checked(scope)]
