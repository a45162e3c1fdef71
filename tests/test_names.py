"""Names and what is read from them."""

import pytest
from pyspark.sql import functions as F

from dupforge.functions import names as N

CASES = {
    "MIDA-630.MP4": {"catalog_key": "mida-630"}, "MIDA-630-C.MP4": {"catalog_key": "mida-630", "part_marker": None}, "MIDA-630-4k.MOV": {"catalog_key": "mida-630"},
    "ABC-001.mp4": {"catalog_key": "abc-1"}, "ABC-1.mkv": {"catalog_key": "abc-1"}, "S2MBD-001.mp4": {"catalog_key": "s2mbd-1"},
    "MIDA-630-CD2.mp4": {"part_marker": "part2"}, "kavr-253-2.mp4": {"catalog_key": "kavr-253", "part_marker": "part2"}, "kavr-253-8.mp4": {"part_marker": "part8"},
    "kavr-253-A.mp4": {"part_marker": "segment:A"}, "kavr-253-B.mp4": {"part_marker": "segment:B"},
    "RVR-15 long descriptive title with many words_4.mp4": {"catalog_key": "rvr-15", "part_marker": "part4"},
    "寒战.mp4": {"aliases": ["寒战"]}, "经典剧情《寒战1》.mkv": {"primary": "寒战1", "aliases": ["寒战1", "寒战"]}, "寒战2.mp4": {"aliases": ["寒战2"]}, "寒战Ⅱ.mp4": {"primary": "寒战2"},
    "無間道Ⅱ.2003.1080p.BluRay.mkv": {"primary": "无间道22003", "aliases": ["无间道22003", "无间道2"]}, "無間道.mkv": {"primary": "无间道"},
    "I.Robot.2004.mkv": {"primary": "irobot2004"}, "Movie.Title.2020.1080p.mkv": {"catalog_key": None, "primary": "movietitle2020"}, "IT.2017.1080p.mkv": {"catalog_key": None, "aliases": ["it2017", "it"]},
    "The Thing 2011.mkv": {"years": [2011], "aliases": ["thething2011", "thething"]}, "2001.A.Space.Odyssey.1968.1080p.mkv": {"years": [1968], "aliases": ["2001aspaceodyssey1968", "2001aspaceodyssey"]},
    "2001.A.Space.Odyssey.1080p.mkv": {"years": []}, "1917.1080p.mkv": {"years": [], "primary": "1917"}, "[www.example.com]寒战.1080p-RARBG.mp4": {"primary": "寒战"},
    "[电影天堂www.example.com]流浪地球.2019.2160p.mkv": {"primary": "流浪地球2019"}, "流浪地球【国语中字】4K.mkv": {"primary": "流浪地球"},
    "The.Show.S02E07.1080p.mkv": {"identity_kind": "series_episode", "series_key": "theshow", "episode_id": "s02e07"}, "The.Show.2x07.mkv": {"episode_id": "s02e07"}, "The.Show.E07.1080p.mkv": {"episode_id": "e007"},
    "纪录片.第12集.4K.mp4": {"episode_id": "e012"}, "Series.15.07.28.Two.Words.mp4": {"identity_kind": "dated_episode", "episode_date": "2015-07-28", "tokens": ["series", "20150728", "two", "words"]},
    "Series.20150728.Two.Words.mp4": {"episode_date": "2015-07-28"}, "Series.15.02.30.Two.mp4": {"episode_date": None}, "www.example.com@longseriesname567.mp4": {"episode_id": "e000567", "series_key": "longseriesname"},
    "Some Show Name (12)_mkv_hd720.mp4": {"episode_id": "e012"}, "Terminator2.mp4": {"identity_kind": "title"}, "BladeRunner2049.mkv": {"identity_kind": "title"}, "VD-1080.mp4": {"primary": "", "catalog_key": None},
    "HD-720.mkv": {"primary": ""}, "上海滩.mp4": {"part_marker": None}, "电影-上.mp4": {"part_marker": "segment:上"}, "寒战01.mp4": {"aliases": ["寒战01", "寒战0"]}, "a_b_1080p.mkv": {"tokens": ["ab1080p"]},
    "ﬁlm ①.mkv": {"primary": "film1"}, "Straße.mkv": {"primary": "strasse"}, "": {"primary": "", "cleaned_display": ""},
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in CASES], "name string").withColumn("stem", N.stem(F.col("name")))
    got = {r["name"]: r["name_info"].asDict() for r in N.with_name_info(df, "stem").collect()}
    assert len(got) == len(CASES)
    for name, fields in CASES.items():
        assert {k: got[name][k] for k in fields} == fields, name


@pytest.mark.parametrize(
    ("path", "root", "fields"),
    [
        ("X:/library/STARS-140/VIDEO_TS/VTS_01_1.VOB", "X:/library", {"catalog_key": "stars-140", "part_marker": "disc:vts01-01", "identity_source": N.FROM_FOLDER}),
        ("X:/VIDEO_TS/VTS_01_1.VOB", "X:/", {"primary": "", "identity_kind": "generic_media", "identity_source": N.FROM_NOWHERE}),
        ("/m/lib/Some Film 1999/disc2/BDMV/STREAM/00001.m2ts", "/m/lib", {"primary": "somefilm1999", "part_marker": "disc:disc2-stream-000001"}),
        ("/m/lib/00001.mkv", "/m/lib", {"primary": "00001", "part_marker": None}),
    ],
)
def test_discs(spark, path, root, fields):
    r = N.with_path_info(spark.createDataFrame([(path, root)], "path string, root string")).first()["name_info"].asDict()
    assert {k: r[k] for k in fields} == fields


def test_stems_and_extensions(spark):
    names = {"a.b.mkv": ("a.b", ".mkv"), ".hidden": (".hidden", ""), "plain": ("plain", ""), "A.MKV": ("A", ".mkv"), "x.mp4.part": ("x.mp4", ".part")}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: (r["s"], r["e"]) for r in df.select("n", N.stem(F.col("n")).alias("s"), N.extension(F.col("n")).alias("e")).collect()} == names
