"""Options of a run, kept as JSON; places to scan; and the hash cache as JSON. All on the driver, all small or bounded."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.functions import fixed
from dupforge.operators import content, filters, scopes

DEFAULTS = fixed.SETTINGS
CACHE_VERSION, CACHE_ENTRIES = 1, 20_000
CACHE = "path string, size long, mtime_ns long, ctime_ns long, quick string, md5 string, updated long"


def load(path: str) -> dict:
    """Known keys of a file, over the defaults. A file that can't be read counts as none; the older switch detect_hash says smart or off."""
    try:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
    except (OSError, ValueError):
        said = None
    if not isinstance(said, dict):
        return dict(DEFAULTS)
    if "hash_mode" not in said and "detect_hash" in said:
        said["hash_mode"] = content.SMART if said["detect_hash"] else content.OFF
    return {k: said.get(k, v) for k, v in DEFAULTS.items()}


def _replace(path: str, data: object, **how) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, **how)
    os.replace(f"{path}.tmp", path)


def save(settings: dict, path: str) -> None:
    _replace(path, {k: settings.get(k, v) for k, v in DEFAULTS.items()}, indent=2)


def check_start(roots: list[str], settings: dict, threshold: float = 0.92) -> filters.ScanOptions:
    """Settings as the scan takes them; ValueError where a run can't begin."""
    if not roots:
        raise ValueError("no folder to scan")
    if gone := [r for r in roots if not os.path.isdir(r)]:
        raise ValueError(f"folders that can't be read: {', '.join(gone)}")
    if scopes.checked(settings["comparison_scope"]) == scopes.DIFFERENT_ROOT and len({identity(r) for r in roots}) < 2:
        raise ValueError("different roots ask for two of them")
    if content.checked(settings["hash_mode"]) == content.OFF and not settings["name_matching_enabled"]:
        raise ValueError("both channels are off")
    extensions = {"全部文件": (), "自定义扩展名": filters.parse_extensions(settings["custom_extensions"])}.get(settings["file_mode"])
    if settings["file_mode"] == "自定义扩展名" and not extensions:
        raise ValueError("no extension is given")
    low, high = (filters.megabytes_to_bytes(filters.parse_megabytes(settings[k])) for k in ("min_size_mb", "max_size_mb"))
    return filters.ScanOptions(settings["recursive"], extensions, low, high, settings["skip_hidden_system"], settings["skip_incomplete"], filters.parse_keywords(settings["exclude_name_keywords"]), tuple(settings["excluded_directories"])).checked()


def drive_roots(mask: Column) -> Column:
    """Drives of a bit mask, A: from the lowest bit on."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(25)), lambda i: F.getbit(mask.cast("long"), i) == 1)
    return F.transform(bits, lambda i: F.concat(F.char(i + 65), F.lit(":\\")))


def pasted_paths(text: Column) -> Column:
    """One path a line, without blanks and quotes around it."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2"))), lambda x: x != "")


def normal(path: str) -> str:
    return os.path.abspath(os.path.normpath(os.path.expandvars(os.path.expanduser(path.strip()))))


def identity(path: str) -> str:
    return os.path.normcase(normal(path))


def new_paths(candidates: Iterable[str], known: Iterable[str] = ()) -> list[str]:
    """Candidates in normal form that aren't known yet, each once, in their order."""
    seen = {identity(p) for p in known if p.strip()}
    fresh = {identity(p): normal(p) for p in reversed([p for p in candidates if p.strip()])}
    return [fresh[i] for i in dict.fromkeys(identity(p) for p in candidates if p.strip()) if i not in seen]


def load_cache(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Entries of a cache file, and a warning if it couldn't be read. Other versions and entries with wrong fields are left out."""
    warning, rows = None, []
    try:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if isinstance(said, dict) and said.get("version") == CACHE_VERSION and isinstance(said.get("entries"), dict):
            for key, e in said["entries"].items():
                try:
                    rows.append((key, *(int(e[k]) for k in ("size", "mtime_ns", "ctime_ns")), str(e["quick"]), None if e.get("md5") is None else str(e["md5"]), int(e.get("updated", 0))))
                except (KeyError, TypeError, ValueError):
                    continue
    except FileNotFoundError:
        pass
    except (OSError, ValueError) as e:
        warning = f"MD5 缓存无法读取，将重新计算：{e}"
    return spark.createDataFrame(rows, CACHE), warning


def save_cache(cache: DataFrame, path: str) -> int:
    """The newest CACHE_ENTRIES entries."""
    newest = cache.orderBy(F.col("updated").desc(), "path").limit(CACHE_ENTRIES).collect()
    _replace(path, {"version": CACHE_VERSION, "entries": {r["path"]: {k: r[k] for k in ("size", "mtime_ns", "ctime_ns", "quick", "md5", "updated")} for r in newest}}, separators=(",", ":"))
    return len(newest)
