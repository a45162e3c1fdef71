"""Deletion plans: what of the marked files may go, given how things stand now. Plans are tables; nothing here deletes. execute() is
the driver's alone: a task may be run twice, and a file must not be."""

from __future__ import annotations

import contextlib
import datetime
import itertools
import json
import math
import os
import stat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupforge.functions import fixed
from dupforge.operators import report
from dupforge.sources.directory import OWN_PREFIX

READY, IGNORED, CONFLICT, SURVIVOR = "ready", "ignored", "conflict", "survivor_issue"


def issue() -> Column:
    """Of a snapshot row joined with the current state: the first thing that is wrong, or null. Times with precision seconds count in whole seconds."""
    exists = F.coalesce(F.col("exists"), F.lit(False))
    whole = F.col("time_precision") == "seconds"
    moved = F.when(whole, F.floor("mtime_now") != F.floor("mtime")).otherwise(F.col("mtime_now") != F.col("mtime"))
    was, now, end = map(F.lit, fixed.RESIZED)
    resized = F.concat(was, F.col("size").cast("string"), now, F.col("size_now").cast("string"), end)
    return F.when(~exists, fixed.MISSING).when(F.col("is_symlink"), fixed.LINK).when(~F.col("is_regular"), fixed.NOT_REGULAR).when(F.col("size_now") != F.col("size"), resized).when(moved, fixed.MODIFIED)


def inspected(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """snapshot (path, size, mtime, time_precision) and issue. current: path, exists, is_regular, is_symlink, size, mtime."""
    now = current.select("path", "exists", "is_regular", "is_symlink", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    return snapshot.join(now, "path", "left").withColumn("issue", issue()).drop("exists", "is_regular", "is_symlink", "size_now", "mtime_now")


def plan(members: DataFrame, current: DataFrame, conflicts: str = "ignore") -> DataFrame:
    """members (group, path, size, mtime, time_precision, action) of groups with marks, and status, message. conflicts: what becomes of marked
    files whose group has no intact survivor: ignore, continue (they are ready) or report."""
    rows = inspected(members, current)
    marked, fine = F.col("action") == fixed.DELETE, F.col("issue").isNull()
    g = rows.groupBy("group").agg(F.count_if(marked & fine).alias("ready"), F.count_if(~marked).alias("others"), F.count_if(~marked & fine).alias("intact"))
    met = rows.join(g, "group")
    clash = (F.col("others") > 0) & (F.col("intact") == 0) & (F.col("ready") > 0)
    resolved = {"ignore": IGNORED, "continue": READY, "report": CONFLICT}[conflicts]
    status = F.when(marked & ~fine, IGNORED).when(marked & (F.col("others") == 0), IGNORED).when(marked & clash, resolved).when(marked, READY).when(clash & ~fine, SURVIVOR)
    message = (
        F.when(marked & ~fine, F.col("issue")).when(marked & (F.col("others") == 0), fixed.NO_SURVIVOR).when(marked & clash & F.lit(conflicts == "ignore"), fixed.NONE_INTACT)
        .when(~marked & clash, F.concat(F.lit(fixed.SURVIVOR_CHANGED), F.col("issue")))
    )
    return met.withColumns({"status": status, "message": message}).filter("status is not null").drop("ready", "others", "intact", "issue")


def resolved(planned: DataFrame, choices: DataFrame) -> DataFrame | None:
    """A plan whose conflicts were reported, with what was chosen for each group, in their order. choices: group, choice (ignore, continue,
    continue_all, which holds for all groups behind it, or cancel). Groups without a choice are ignored. None: cancelled, nothing is to be done."""
    everything = choices.filter("choice = 'continue_all'").agg(F.min("group").alias("g")).first()["g"]
    reached = choices if everything is None else choices.filter(F.col("group") < everything)
    if not reached.filter("choice = 'cancel'").isEmpty():
        return None
    onward = F.lit(False) if everything is None else F.col("group") >= everything
    rows = planned.join(choices.select("group", "choice"), "group", "left").withColumn("choice", F.when(onward, "continue_all").otherwise(F.coalesce("choice", F.lit("ignore"))))
    clash, goes_on = F.col("status") == CONFLICT, F.col("choice") != "ignore"
    said = F.when(F.col("choice") == "continue_all", fixed.CHOSE_ALL).when(goes_on, fixed.CHOSE_GROUP).otherwise(fixed.CHOSE_IGNORE)
    message = F.when(clash & ~goes_on, fixed.CHOSEN_TO_IGNORE).when(F.col("status") == SURVIVOR, F.concat("message", said)).otherwise(F.col("message"))
    status = F.when(clash, F.when(goes_on, READY).otherwise(IGNORED)).otherwise(F.col("status"))
    return rows.withColumns({"status": status, "message": message}).drop("choice")


def preview(ready: DataFrame, groups: DataFrame, names: int = 8) -> DataFrame:
    """One row: files, bytes, groups with a warning, the first names by group and path, and how many more there are. ready: group, path, size; groups: group, safety_warning."""
    warned = ready.select("group").distinct().join(groups.filter("safety_warning"), "group").agg(F.count("*").alias("warning_groups"))
    shown = ready.orderBy("group", "path").limit(names).agg(F.array_sort(F.collect_list(F.struct("group", "path"))).alias("s"))  # names rows at most
    shown = shown.select(F.array_join(F.transform("s", lambda x: F.element_at(F.split(x["path"], "/"), -1)), "\n").alias("names"))
    sums = ready.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(sums).join(one(warned), "_one").join(one(shown), "_one")  # a row each
    return out.select("files", "bytes", "warning_groups", "names", F.greatest(F.col("files") - names, F.lit(0)).alias("more"))


def after(members: DataFrame, outcome: DataFrame) -> DataFrame:
    """members once a plan has been carried out: succeeded ones are gone, ignored and failed ones are marked so, and groups of one go. outcome: path, result (succeeded, ignored, failed)."""
    gone = outcome.filter("result = 'succeeded'").select("path")
    left = members.join(gone, "path", "left_anti").join(outcome.filter("result <> 'succeeded'").select("path", "result"), "path", "left")
    action = F.when(F.col("result") == "ignored", fixed.IGNORE).when(F.col("result") == "failed", fixed.UNDECIDED).otherwise(F.col("action"))
    left = left.withColumn("action", action).drop("result")
    groups = left.groupBy("group").agg(F.count("*").alias("n")).filter("n >= 2").select("group")
    return left.join(groups, "group", "left_semi")


def is_unc(path: str) -> bool:
    return path.startswith(("\\\\", "//"))


def state_of(path: str) -> dict | None:
    """A row of the current state of a file, without its path; None: it isn't there."""
    try:
        now = os.stat(path, follow_symlinks=False)
    except FileNotFoundError:
        return None
    kind = stat.S_IFMT(now.st_mode)
    return {"is_symlink": kind == stat.S_IFLNK, "is_regular": kind == stat.S_IFREG, "size_now": now.st_size, "mtime_now": now.st_mtime}


def wrong_with(file: dict, now: dict | None) -> str | None:
    """The same rule as issue(), for one file."""
    if now is None:
        return fixed.MISSING
    unit = math.floor if file["time_precision"] == "seconds" else float
    was, is_, end = fixed.RESIZED
    tests = {
        fixed.LINK: now["is_symlink"], fixed.NOT_REGULAR: not now["is_regular"], f"{was}{file['size']}{is_}{now['size_now']}{end}": now["size_now"] != file["size"],
        fixed.MODIFIED: unit(now["mtime_now"]) != unit(file["mtime"]),
    }
    return next((said for said, found in tests.items() if found), None)


def quarantine(path: str, stamp: str) -> str:
    """Moves a file into a folder of ours beside it. Nothing is deleted, and nothing is overwritten: the name is taken by creating it."""
    folder, name = os.path.split(path)
    stem, suffix = os.path.splitext(name)
    to = os.path.join(folder, f"{OWN_PREFIX}Recycle", stamp)
    os.makedirs(to, exist_ok=True)
    for target in (os.path.join(to, name if not k else f"{stem}_{k}{suffix}") for k in itertools.count()):
        with contextlib.suppress(FileExistsError):
            os.close(os.open(target, os.O_CREAT | os.O_EXCL))
            os.replace(path, target)
            return target
    raise AssertionError


def _carry_out(file: dict, stamp: str) -> dict:
    """path, result, message, and the state that was found."""
    out = {"path": file["path"], "result": "ignored", "size_now": None, "mtime_now": None}
    if is_unc(file["path"]):
        return out | {"message": fixed.NETWORK}
    try:
        now = state_of(file["path"])
    except OSError as e:
        return out | {"message": f"{fixed.UNREADABLE}{e}"}
    if said := wrong_with(file, now):
        return out | {k: v for k, v in (now or {}).items() if k in out} | {"message": said}
    try:
        return out | {"result": "succeeded", "message": fixed.MOVED + quarantine(file["path"], stamp)}
    except OSError as e:
        return out | {"result": "failed", "message": f"{fixed.NOT_MOVED}{e}"}


def execute(ready: DataFrame, history: str | None = None, ignored: DataFrame | None = None, folders: list[str] | None = None, source: str | None = None) -> list[dict]:
    """On the driver, one file after the other: looked at again, then moved to quarantine. Rows stream in. ready: path, size, mtime,
    time_precision, and group_name if there is one. What is ignored here, and the rows of ignored, which the plan has ignored (as
    report.ignored_rows() takes them), are listed in the first of folders that takes a file, if folders are given."""
    stamp, out, left = datetime.datetime.now().strftime("%Y%m%d_%H%M%S"), [], []
    for r in ready.toLocalIterator():
        file = r.asDict()
        done = _carry_out(file, stamp)
        out.append({k: done[k] for k in ("path", "result", "message")})
        if done["result"] == "ignored":
            left.append((file.get("group_name"), file["path"], done["message"], False, file["size"], done["size_now"], float(file["mtime"]), done["mtime_now"]))
    if folders:
        rows = ready.sparkSession.createDataFrame(left, report.IGNORED_ITEMS)
        if ignored is not None:
            rows = ignored.select(*rows.columns).unionByName(rows)
        report.write_ignored(report.ignored_rows(rows, datetime.datetime.now().isoformat(timespec="seconds"), source), folders, stamp)
    if history:
        with contextlib.suppress(OSError), open(history, "a", encoding="utf-8") as f:  # the log is a convenience
            f.write(json.dumps({"at": stamp, "items": out}, ensure_ascii=False) + "\n")
    return out
