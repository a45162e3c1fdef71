"""Files on disk: scanning, hashing, planning, reports."""

import os

import pytest
from pyspark.sql import functions as F

from dupforge.functions import fixed, labels
from dupforge.functions import names as N
from dupforge.operators import content, filters, planning, quality, report
from dupforge.plans.pipeline import find_duplicates
from dupforge.sources import directory
from dupforge.streaming import arrivals


def put(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def found(spark, roots, options=filters.ScanOptions()):  # noqa: B008
    rows = directory.scan(spark, [str(r) for r in roots], options)
    judged = filters.waterfall(rows.filter("status = 'file'"), options)
    return {r["name"]: r["reason"] for r in judged.collect()}, sorted((r["name"], r["status"]) for r in rows.filter("status <> 'file'").collect())


def test_scan(spark, tmp_path):
    put(tmp_path, {"A.mp4": b"x", "notes.txt": b"x", "nested/A-4k.mkv": b"x", ".Dupforge_Recycle/old.mp4": b"x", ".secret/b.mp4": b"x", "cache/c.mp4": b"x"})
    os.symlink(tmp_path / "A.mp4", tmp_path / "link.mp4")
    got, other = found(spark, [tmp_path, tmp_path / "nested", tmp_path / "gone"], filters.ScanOptions(excluded=(str(tmp_path / "cache"),)))
    assert got == {"A.mp4": "included", "notes.txt": "extension", "A-4k.mkv": "included"}
    assert other == [(".secret", "hidden_directory"), ("cache", "excluded_directory"), ("gone", "missing")]
    rows = directory.scan(spark, [str(tmp_path), str(tmp_path / "nested")]).filter("name = 'A-4k.mkv'").collect()
    assert [r["root"] for r in rows] == [str(tmp_path)]


def test_scan_filters(spark, tmp_path):
    put(tmp_path, {".hidden.mp4": b"x", "movie.mp4.part": b"x", "movie-sample.mp4": b"x", "movie-full.mp4": b"12345", "big.mp4": b"x" * 11})
    got, _ = found(spark, [tmp_path], filters.ScanOptions(extensions=(), keywords=("Sample",), min_size=1, max_size=10))
    assert got == {".hidden.mp4": "hidden_system", "movie.mp4.part": "incomplete", "movie-sample.mp4": "keyword", "movie-full.mp4": "included", "big.mp4": "too_large"}
    with pytest.raises(ValueError):
        filters.ScanOptions(min_size=5, max_size=2).checked()


def test_parsers():
    assert [filters.parse_megabytes(x) for x in ("50", "100.5", "1,25", "")] == [50, 100.5, 1.25, 0]
    for bad in ("-1", "nan", "inf", "abc", "10000001"):
        with pytest.raises(ValueError):
            filters.parse_megabytes(bad)
    assert filters.parse_keywords(" Sample;预告，TRAILER\nsample ") == ("sample", "预告", "trailer")
    assert filters.parse_extensions("*.MP4; mkv，.vob mp4") == (".mp4", ".mkv", ".vob")
    assert labels.column_order(["b", "x", "b"], ["a", "b"]) == ["b", "a"]


def scanned(spark, root):
    return directory.scan(spark, [str(root)]).filter("status = 'file'")


def test_hash_modes_on_disk(spark, tmp_path):
    big = fixed.SAMPLE_BYTES * 4 + 17
    a = bytearray(b"a" * big)
    b = bytearray(a)
    b[1_300_000] = 98  # outside of the spans
    put(tmp_path, {"a.mp4": a, "b.mp4": b, "c.mp4": b"A" * big, "d.mp4": b"same", "e.mp4": b"same", "f.mp4": b"other", "g.mp4": b""})
    rows = {r["name"]: r for r in content.exact_duplicates_on_disk(scanned(spark, tmp_path)).collect()}
    assert {n: r["hash_source"] for n, r in rows.items()} == {"a.mp4": fixed.HASH_FULL, "b.mp4": fixed.HASH_FULL, "c.mp4": fixed.HASH_DIFFERENT, "d.mp4": fixed.HASH_SMALL, "e.mp4": fixed.HASH_SMALL}
    assert rows["a.mp4"]["quick"] == rows["b.mp4"]["quick"] and rows["a.mp4"]["content_md5"] != rows["b.mp4"]["content_md5"]
    deep = {r["name"]: r["hash_source"] for r in content.exact_duplicates_on_disk(scanned(spark, tmp_path), "deep").collect()}
    assert deep["c.mp4"] == fixed.HASH_FULL
    entries = [(r["path"], r["size"], r["mtime_ns"], r["ctime_ns"], r["quick"], r["content_md5"], 1) for r in rows.values()]
    cache = spark.createDataFrame(entries, "path string, size long, mtime_ns long, ctime_ns long, quick string, md5 string, updated long")
    again = {r["name"]: r["hash_source"] for r in content.exact_duplicates_on_disk(scanned(spark, tmp_path), cache=cache).collect()}
    assert again["a.mp4"] == again["b.mp4"] == fixed.HASH_CACHED
    assert content.exact_duplicates_on_disk(scanned(spark, tmp_path), "off").count() == 0


def test_only_candidates_are_hashed(spark):
    """A content that is looked at without need is an error."""
    big = 3 * fixed.SAMPLE_BYTES
    rows = [("/a", 4, "same"), ("/b", 4, "same"), ("/c", 4, "diff"), ("/lone", 5, None), *((f"/big{k}", big + 9, x) for k, x in enumerate("xxy")), ("/lone-big", big + 10, None)]
    df = spark.createDataFrame(rows, "path string, size long, seed string").withColumns({"root": F.lit("/"), "folder": F.lit("/"), "name": F.substring("path", 2, 99)})
    df = df.withColumn("content", F.when(F.col("size") > 99, F.rpad(F.coalesce("seed", F.lit("")), big + 9, ".")).otherwise(F.coalesce("seed", F.lit("12345")))).drop("seed")
    quick = F.when(F.contains(F.col("path"), F.lit("lone")), F.raise_error(F.lit("looked at"))).otherwise(content.quick_of_content(F.col("content"), F.col("size")))
    with pytest.raises(Exception, match="looked at"):
        df.select(quick).collect()
    got = {m: {r["path"]: (r["quick"] is not None, r["content_md5"] is not None, r["hash_source"]) for r in content.with_hashes(df, m, quick=quick).collect()} for m in content.MODES}
    alone, full, small = (False, False, fixed.HASH_NONE), (True, True, fixed.HASH_FULL), (True, True, fixed.HASH_SMALL)
    smart = {"/a": small, "/b": small, "/c": small, "/lone": alone, "/big0": full, "/big1": full, "/big2": (True, False, fixed.HASH_DIFFERENT), "/lone-big": alone}
    assert got == {"off": dict.fromkeys(smart, alone), "smart": smart, "deep": smart | {"/big2": full}}


def test_plan_and_execute(spark, tmp_path):
    put(tmp_path, {"keep.mp4": b"1", "del.mp4": b"1", "lone1.mp4": b"1", "lone2.mp4": b"1"})
    files = {r["name"]: r for r in scanned(spark, tmp_path).collect()}
    row = lambda g, n, action, grown=0: (g, files[n]["path"], files[n]["size"] + grown, files[n]["mtime"], "exact", action)
    members = spark.createDataFrame([row("g", "keep.mp4", fixed.KEEP), row("g", "del.mp4", fixed.DELETE), row("h", "lone1.mp4", fixed.DELETE), row("h", "lone2.mp4", fixed.KEEP, 1)], "group string, path string, size long, mtime double, time_precision string, action string")
    current = scanned(spark, tmp_path).select("path", F.lit(True).alias("exists"), F.lit(True).alias("is_regular"), F.lit(False).alias("is_symlink"), "size", "mtime")
    status = {os.path.basename(r["path"]): r["status"] for r in planning.plan(members, current).collect()}
    assert status == {"del.mp4": "ready", "lone1.mp4": "ignored", "lone2.mp4": "survivor_issue"}
    assert planning.plan(members, current, "continue").filter("status = 'ready'").count() == 2
    conflict = planning.plan(members, current, "report")
    choose = lambda c: planning.resolved(conflict, spark.createDataFrame([("h", c)], "group string, choice string"))
    assert choose("cancel") is None and choose("ignore").filter("status = 'ready'").count() == 1 and choose("continue").filter("status = 'ready'").count() == 2
    ready = planning.plan(members, current).filter("status = 'ready'")
    ready = spark.createDataFrame(ready.collect(), ready.schema)
    done = planning.execute(ready, str(tmp_path / "log.jsonl"))
    assert [r["result"] for r in done] == ["succeeded"]
    assert done[0]["message"].startswith(fixed.MOVED) and os.path.exists(done[0]["message"][len(fixed.MOVED) :])
    assert not (tmp_path / "del.mp4").exists() and (tmp_path / "keep.mp4").exists()
    again = planning.execute(ready, folders=[str(tmp_path / "lists")], ignored=spark.createDataFrame([("w", "/v/1", "why", True, 1, None, 0.5, None)], report.IGNORED_ITEMS))
    assert [(r["result"], r["message"]) for r in again] == [("ignored", fixed.MISSING)]
    (listed,) = (tmp_path / "lists").iterdir()
    lines = listed.read_text(encoding="utf-8-sig").splitlines()
    assert len(lines) == 3 and "/v/1" in lines[1] and fixed.MISSING in lines[2]
    put(tmp_path, {"del.mp4": b"22"})
    assert planning.execute(ready)[0]["message"] == "文件大小已变化（扫描时 1 字节，当前 2 字节）"
    put(tmp_path, {"q/a.mp4": b"1"})
    places = [planning.quarantine(str(tmp_path / "q" / "a.mp4"), "s")]
    put(tmp_path, {"q/a.mp4": b"2"})
    places.append(planning.quarantine(str(tmp_path / "q" / "a.mp4"), "s"))
    assert [os.path.basename(p) for p in places] == ["a.mp4", "a_1.mp4"] and open(places[0], "rb").read() == b"1"
    assert quality.without_survivor(spark.createDataFrame([("x", fixed.DELETE), ("x", fixed.DELETE), ("y", fixed.KEEP)], "group string, action string")).collect()[0]["group"] == "x"


def test_metadata(spark):
    cases = [("near", 7200, 7210, "name"), ("far", 3600, 7200, "name"), ("mid", 3600, 3750, "name"), ("same", 3600, 7200, "hash")]
    rows = [(g, 2 * k + j, kind, "m", float(d), 720, f"f{j}.mkv", 100 + j) for k, (g, a, b, kind) in enumerate(cases) for j, d in enumerate((a, b))]
    members = spark.createDataFrame(rows, "group string, idx long, match_kind string, content_md5 string, duration_seconds double, height int, name string, size long")
    got = {r["group"]: (r["safety_warning"], r["metadata_note"]) for r in quality.assess(members).collect()}
    assert got["near"] == (False, "视频时长接近") and got["far"][0] and "2.5 分钟" in got["mid"][1] and got["same"] == (False, "同尺寸且完整 MD5 相同")
    actions = {}
    for r in quality.smart_choice(members, quality.assess(members)).collect():
        actions.setdefault(r["group"], []).append(r["action"])
    assert sorted(actions["far"]) == sorted([fixed.KEEP, fixed.UNDECIDED]) and sorted(actions["same"]) == sorted([fixed.KEEP, fixed.DELETE])


def test_formats(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 163184640: "155.62 MB", 3 << 40: "3.00 TB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    assert {r["s"]: r["t"] for r in df.select("s", labels.format_bytes(F.col("s")).alias("t")).collect()} == sizes
    times = {0.5: "00:00", 1.5: "00:02", 3661.0: "01:01:01", 360000.0: "100:00:00", None: "未知"}
    df = spark.createDataFrame([(s,) for s in times], "s double")
    assert {r["s"]: r["t"] for r in df.select("s", labels.format_duration(F.col("s")).alias("t")).collect()} == times
    values = [7.05, 2.675, 0.125, 0.375, 1e6 + 0.005, 9.995]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", labels.fixed_point(F.col("v"), 2).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == {v: f"{v:.2f}" for v in values}


def test_report_round_trip(spark, tmp_path):
    rows = [(n, k, f"/a/{n}", "/a", n, 1000 + k, 1000.5 + k, fixed.DELETE if k else fixed.KEEP, "exact" if k else "seconds") for k, n in enumerate(["Some Film 1999.mkv", "Some Film.mp4"])]
    m = spark.createDataFrame(rows, "stem0 string, pos int, path string, folder string, name string, size long, mtime double, action string, time_precision string").withColumn("group", F.lit("g"))
    m = N.with_name_info(m.withColumn("stem", N.stem(F.col("name"))), "stem").withColumns({"content_md5": F.lit(None).cast("string"), "hash_source": F.lit(fixed.HASH_NONE), "same_md5": F.lit(0), "width": F.lit(1920), "height": F.lit(1080), "duration_seconds": F.lit(60.25), "codec": F.lit("h264")})
    g = spark.createDataFrame([("g", 1, "some film", "name", "r", "", False, 0.96)], "group string, number int, display_name string, match_kind string, reason string, metadata_note string, safety_warning boolean, confidence double")
    path = str(tmp_path / "r.csv")
    assert report.write(report.rows(m, g), path) == 2
    files, bad = report.load(report.read(spark, path))
    got = {r["path"]: r for r in files.collect()}
    assert bad.count() == 0 and {p: r["action"] for p, r in got.items()} == {"/a/Some Film 1999.mkv": fixed.KEEP, "/a/Some Film.mp4": fixed.DELETE}
    one = got["/a/Some Film.mp4"]
    assert (one["size"], one["mtime"], one["time_precision"], one["width"], one["height"], one["duration_seconds"], one["confidence"], one["group"], one["name_info"]["primary"]) == (1001, 1001.5, "exact", 1920, 1080, 60.25, 0.96, "report-000001", "somefilm")
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(report.ReportError):
        report.read(spark, str(tmp_path / "x.csv"))
    head = ",".join(fixed.REQUIRED_REPORT_COLUMNS)
    (tmp_path / "gbk.csv").write_bytes((head + "\n1,删除,/电影/a.mp4,\"1,000\",2020/01/02 03:04:05\n1,保留,,5,x\n,x,/b.mp4,-1,2020-01-02 03:04:05\n1,删除,/电影/a.mp4,7,2020-01-02T03:04:05\n").encode("gb18030"))
    files, bad = report.load(report.read(spark, str(tmp_path / "gbk.csv")))
    assert [(r["path"], r["size"], r["time_precision"]) for r in files.collect()] == [("/电影/a.mp4", 1000, "seconds")]
    assert sorted(r["row_no"] for r in bad.collect()) == [3, 4, 5]


def test_whole_pipeline(spark):
    rows = [("/m/a/寒战.mp4", "1" * 50), ("/m/a/寒战1.mkv", "2" * 60), ("/m/a/different-name.mkv", "1" * 50), ("/m/b/Lonely Film Title.mkv", "z")]
    files = spark.createDataFrame([(p, "/m", os.path.dirname(p), os.path.basename(p), len(c), 1.0, c) for p, c in rows], "path string, root string, folder string, name string, size long, mtime double, content string")
    found = find_duplicates(files)
    g = found.groups.collect()
    assert [(r["match_kind"], r["n_files"]) for r in g] == [("mixed", 3)]
    assert sorted(r["action"] for r in found.members.collect()) == sorted([fixed.KEEP, fixed.DELETE, fixed.DELETE])
    with pytest.raises(ValueError):
        find_duplicates(files, mode="off", by_name=False)


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "content string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = arrivals.first_arrivals(stream).writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["content"] for r in spark.table("first").collect()) == ["a", "b"]
