"""Catalogues of files made of the benchmark tables, so that the operators can run on them. One task's rows never depend on another's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_files(df: DataFrame, root, folder, name, size, mtime) -> DataFrame:
    """df and path, root, folder, name, size, mtime (seconds), attributes."""
    return df.select("*", F.concat_ws("/", folder, name).alias("path"), root.alias("root"), folder.alias("folder"), name.alias("name"), size.cast("long").alias("size"), mtime.cast("double").alias("mtime"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files with content: /lib/<source>/<lang>/doc_<id>.txt."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    root = F.concat(F.lit("/lib/"), F.coalesce("source", F.lit("none")))
    folder = F.concat(root, F.lit("/"), F.coalesce("lang", F.lit("none")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.coalesce("text", F.lit(""))
    return with_files(d.select("doc_id", content.alias("content"), "lang", "source"), root, folder, name, F.octet_length("content"), F.col("doc_id") % 1000).select("doc_id", "content", "path", "root", "folder", "name", "size", "mtime")


def messy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as files of which many are to be filtered out: hidden, system, incomplete, of other types, sampled, too small or too large."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    root = F.concat(F.lit("/media/r"), (F.col("l_suppkey") % 4).cast("string"))
    folder = F.concat(root, F.lit("/"), F.when(F.col("l_suppkey") % 7 == 0, "cache").when(F.col("l_suppkey") % 11 == 0, ".trash").otherwise("films"), F.lit("/"), (F.col("l_partkey") % 50).cast("string"))
    ext = F.when(F.col("l_linenumber") == 1, ".mp4").when(F.col("l_linenumber") == 2, ".MKV").when(F.col("l_linenumber") == 3, ".txt").when(F.col("l_linenumber") == 4, ".mp4.part").otherwise(".avi")
    prefix = F.when(F.col("l_orderkey") % 13 == 0, ".").when(F.col("l_orderkey") % 17 == 0, "~$").otherwise("")
    word = F.when(F.col("l_partkey") % 19 == 0, "_Sample").when(F.col("l_partkey") % 23 == 0, "_TRAILER").otherwise("")
    rows = with_files(li, root, folder, F.concat(prefix, F.lit("film"), key, word, ext), F.floor(F.col("l_extendedprice") * 100), F.col("l_orderkey") % 100000)
    return rows.select("path", "root", "folder", "name", "size", "mtime", F.when(F.col("l_orderkey") % 29 == 0, 4).otherwise(0).alias("attributes"))


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as films: the part's name, a quality tag and an extension."""
    p = table(spark, sf_dir, "part")
    tag = F.when(F.col("p_size") % 4 == 0, ".1080p").when(F.col("p_size") % 4 == 1, ".720p.BluRay").when(F.col("p_size") % 4 == 2, ".x265").otherwise("")
    ext = F.when(F.col("p_size") % 3 == 0, ".mkv").when(F.col("p_size") % 3 == 1, ".mp4").otherwise(".avi")
    title = F.translate(F.coalesce("p_name", F.lit("")), " ", ".")
    root = F.concat(F.lit("/films/"), F.translate(F.lower("p_brand"), "#", ""))
    folder = F.concat(root, F.lit("/"), (F.col("p_partkey") % 10).cast("string"))
    name = F.concat(title, tag, F.lit("."), F.lit("k"), F.col("p_partkey").cast("string"), ext)
    rows = with_files(p, root, folder, F.concat(title, tag, ext), F.floor(F.col("p_retailprice") * 1000), F.col("p_partkey"))
    # the key in the folder keeps paths apart without touching titles
    return rows.select("p_partkey", F.concat_ws("/", "folder", F.concat(F.lit("v"), F.col("p_partkey").cast("string")), "name").alias("path"), "root", F.concat_ws("/", "folder", F.concat(F.lit("v"), F.col("p_partkey").cast("string"))).alias("folder"), "name", "size", "mtime")


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated episodes: type.yyyy.MM.dd.user<id>."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.coalesce("event_type", F.lit("x")), F.date_format(F.col("ts"), ".yyyy.MM.dd"), F.lit(".user"), F.col("user_id").cast("string"), F.lit(".mkv")).alias("name"))


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as catalogued discs: ABC-<part, padded>-<line>."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("ABC-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".mp4")).alias("name"))


def order_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as titles with a year: <segment> <nation> <year>."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.select("o_orderkey", F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("n_name"), F.year("o_orderdate").cast("string")).alias("stem"))


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")
