"""Media metadata, settings, places, caches, lists of what was ignored."""

import json

import pytest
from pyspark.sql import functions as F

from dupforge.operators import report
from dupforge.sources import media, settings


def test_media(spark):
    files = spark.createDataFrame([("/a", "m1"), ("/b", "m1"), ("/c", None), ("/d", None), ("/e", None)], "path string, content_md5 string")
    said = {"/a": media.as_json(1920, 1080, "h264", 60.5), "/c": "{}", "/d": None, "/e": "not json"}
    got = {r["path"]: (r["metadata_source"], r["width"], r["height"], r["codec"], r["duration_seconds"]) for r in media.with_metadata(files, said.get).collect()}
    full = (1920, 1080, "h264", 60.5)
    none = (None,) * 4
    assert got == {"/a": (media.PROBED, *full), "/b": (media.SHARED, *full), "/c": (media.PROBED, *none), "/d": (media.FAILED, *none), "/e": (media.FAILED, *none)}
    table = spark.createDataFrame([(k, v) for k, v in said.items()], "path string, payload string")
    again = {r["path"]: r["metadata_source"] for r in media.with_metadata(files, table=table).collect()}
    assert again == {k: v[0] for k, v in got.items()}
    assert media.run_ffprobe("/nothing", "/no/such/tool") is None


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert settings.load(path) == settings.DEFAULTS
    settings.save({"recursive": False, "unknown": 1}, path)
    assert settings.load(path) == settings.DEFAULTS | {"recursive": False}
    for old, mode in ((True, "smart"), (False, "off")):
        (tmp_path / "s.json").write_text(json.dumps({"detect_hash": old}))
        assert settings.load(path)["hash_mode"] == mode
    (tmp_path / "s.json").write_text("[")
    assert settings.load(path) == settings.DEFAULTS


def test_start(tmp_path):
    s, root = settings.DEFAULTS, str(tmp_path)
    assert settings.check_start([root], s | {"min_size_mb": "1,5"}).min_size == 1572864
    for roots, change in (([], {}), ([f"{root}/no"], {}), ([root, root], {"comparison_scope": "different_root"}), ([root], {"hash_mode": "off", "name_matching_enabled": False}), ([root], {"min_size_mb": "5", "max_size_mb": "2"}), ([root], {"file_mode": "自定义扩展名", "custom_extensions": ""})):
        with pytest.raises(ValueError):
            settings.check_start(roots, s | change)


def test_places(spark, tmp_path):
    df = spark.createDataFrame([(1 << 2 | 1 << 3 | 1 << 25, "\"/a b\"\n\n '/c' \r\n/d")], "mask long, text string")
    r = df.select(settings.drive_roots(F.col("mask")).alias("d"), settings.pasted_paths(F.col("text")).alias("p")).first()
    assert r["d"] == ["C:\\", "D:\\", "Z:\\"] and r["p"] == ["/a b", "/c", "/d"]
    assert settings.new_paths(["/x/../a", " ", "/b", "/a"], ["/b/"]) == ["/a"]


def test_cache_file(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert settings.load_cache(spark, path)[0].count() == 0
    rows = spark.createDataFrame([("/a", 1, 2, 3, "q", "m", 5), ("/b", 1, 2, 3, "q", None, 6)], settings.CACHE)
    assert settings.save_cache(rows, path) == 2
    again, warning = settings.load_cache(spark, path)
    assert warning is None and sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "c.json").write_text(json.dumps({"version": 9, "entries": {"/a": {}}}))
    assert settings.load_cache(spark, path)[0].count() == 0
    (tmp_path / "c.json").write_text("{")
    assert settings.load_cache(spark, path)[1]


def test_ignored_list(spark, tmp_path):
    items = spark.createDataFrame([("g", "/a/b.mp4", "gone", False, 5, None, 10.0, None), ("g", "/a/c.mp4", "other", True, 5, 6, 10.0, 11.0)], "group_name string, path string, message string, preserve_action boolean, size long, size_now long, mtime double, mtime_now double")
    rows = report.ignored_rows(items, "2024-01-01T00:00:00")
    (tmp_path / "file").write_text("")
    first, second = (report.write_ignored(rows, [str(tmp_path / "file" / "x"), str(tmp_path)], "1") for _ in range(2))
    assert (first, second) == (str(tmp_path / "ignored_1.csv"), str(tmp_path / "ignored_1_2.csv"))
    lines = open(first, encoding="utf-8-sig").read().splitlines()
    assert len(lines) == 3 and "删除标记已忽略,g,b.mp4,/a/b.mp4,gone,5,,1970-01-01T00:00:10," in lines[1]
    assert report.write_ignored(rows.limit(0), [str(tmp_path)], "2") is None
