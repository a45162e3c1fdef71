"""Named queries over the benchmark tables, each with SQL that says the same for DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.functions import fixed, labels
from dupforge.functions import names as N
from dupforge.operators import blocking, clusters, components, content, filters, merge, planning, quality, report, scopes, scoring, works
from dupforge.plans.pipeline import find_duplicates, indexed
from dupforge.scratch import Scratch, merged
from dupforge.sources import media, settings, tables
from dupforge.sources.directory import first_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- catalogues in SQL

DOCS = """docs AS (
  SELECT doc_id, coalesce(text, '') AS content, '/lib/' || coalesce(source, 'none') AS root, '/lib/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder,
    'doc_' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS size, (doc_id % 1000)::DOUBLE AS mtime,
    '/lib/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS h
  FROM documents WHERE doc_id IS NOT NULL)"""

MESSY = """messy AS (
  SELECT *, folder || '/' || name AS path FROM (
    SELECT '/media/r' || (l_suppkey % 4) AS root,
      '/media/r' || (l_suppkey % 4) || '/' || CASE WHEN l_suppkey % 7 = 0 THEN 'cache' WHEN l_suppkey % 11 = 0 THEN '.trash' ELSE 'films' END || '/' || (l_partkey % 50) AS folder,
      CASE WHEN l_orderkey % 13 = 0 THEN '.' WHEN l_orderkey % 17 = 0 THEN '~$' ELSE '' END || 'film' || l_orderkey || '_' || l_linenumber
        || CASE WHEN l_partkey % 19 = 0 THEN '_Sample' WHEN l_partkey % 23 = 0 THEN '_TRAILER' ELSE '' END
        || CASE l_linenumber WHEN 1 THEN '.mp4' WHEN 2 THEN '.MKV' WHEN 3 THEN '.txt' WHEN 4 THEN '.mp4.part' ELSE '.avi' END AS name,
      floor(l_extendedprice * 100)::BIGINT AS size, CASE WHEN l_orderkey % 29 = 0 THEN 4 ELSE 0 END AS attributes
    FROM lineitem))"""

_EXT = "lower(regexp_extract(name, '.(\\.[^.]+)$', 1))"
_VIDEO = ", ".join(f"'{x}'" for x in fixed.VIDEO_EXTENSIONS)
_PARTIAL = "(name LIKE '~$%' OR " + " OR ".join(f"lower(name) LIKE '%{x}'" for x in fixed.INCOMPLETE_SUFFIXES) + ")"
OPTIONS = filters.ScanOptions(min_size=500_000, max_size=8_000_000, keywords=("Sample", "trailer"))
JUDGED = f"""{MESSY}, judged AS (
  SELECT path, folder, CASE WHEN name LIKE '.%' OR attributes & 6 <> 0 THEN 'hidden_system' WHEN {_EXT} NOT IN ({_VIDEO}) THEN 'extension' WHEN {_PARTIAL} THEN 'incomplete'
    WHEN contains(lower(name), 'sample') OR contains(lower(name), 'trailer') THEN 'keyword' WHEN size < 500000 THEN 'too_small' WHEN size > 8000000 THEN 'too_large' ELSE 'included' END AS reason
  FROM messy)"""


# ---- filters


@query("scan_filter_waterfall", f"WITH {JUDGED} SELECT path, reason FROM judged")
def scan_filter_waterfall(spark, d):
    return filters.waterfall(tables.messy_files(spark, d), OPTIONS).select("path", "reason")


@query("scan_filter_stats", f"""WITH {JUDGED} SELECT count(*) AS regular_files_seen, count_if(reason = 'included')::BIGINT AS included_files, {", ".join(f"count_if(reason = '{r}')::BIGINT AS skipped_{r}" for r in filters.REASONS)},
  count_if(reason <> 'included')::BIGINT AS filtered_files FROM judged WHERE NOT (folder = '/media/r1/cache' OR folder LIKE '/media/r1/cache/%')""")
def scan_filter_stats(spark, d):
    from dataclasses import replace

    return filters.statistics(filters.waterfall(tables.messy_files(spark, d), replace(OPTIONS, excluded=("/media/r1/cache",))))


@query("excluded_dirs_anti", f"WITH {MESSY} SELECT path FROM messy WHERE NOT (folder LIKE '%/cache/%' OR folder LIKE '%/cache')")
def excluded_dirs_anti(spark, d):
    files = tables.messy_files(spark, d)
    return filters.not_in(files, files.select(F.concat("root", F.lit("/cache")).alias("folder")).distinct()).select("path")


@query("root_dedup", f"WITH {DOCS} SELECT path, root FROM docs")
def root_dedup(spark, d):
    files = tables.doc_files(spark, d).select("path", "root")
    return first_root(files.withColumn("root_pos", F.lit(1)).unionByName(files.withColumns({"root": F.lit("/lib"), "root_pos": F.lit(2)}))).select("path", "root")


@query("keyword_exclusion", f"WITH {MESSY} SELECT path, contains(lower(name), 'sample') OR contains(lower(name), 'trailer') AS excluded FROM messy")
def keyword_exclusion(spark, d):
    return tables.messy_files(spark, d).select("path", filters.has_keyword(F.col("name"), filters.parse_keywords(" Sample;TRAILER\nsample ")).alias("excluded"))


@query("keyword_folding", "SELECT p_partkey, p_partkey % 4 < 3 AS excluded FROM part")
def keyword_folding(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("film "), k.cast("string"), F.when(k % 4 == 0, "ｓａｍｐｌｅ").when(k % 4 == 1, "SAMPLE").when(k % 4 == 2, "Straße").otherwise("other"), F.lit(".mp4"))
    return tables.table(spark, d, "part").select("p_partkey", filters.has_keyword(name, filters.parse_keywords("sample;STRASSE")).alias("excluded"))


@query("name_folding", "SELECT p_partkey, lower(p_name) || 'abc12 ss ' || p_partkey AS folded FROM part")
def name_folding(spark, d):
    k = F.col("p_partkey")
    return tables.table(spark, d, "part").select("p_partkey", N.fold(F.concat(F.lit(" "), F.initcap("p_name"), F.when(k % 2 == 0, "ＡＢｃ１２").otherwise("abc12"), F.lit(" ß "), k.cast("string"), F.lit("\u3000"))).alias("folded"))


@query("incomplete_names", f"WITH {MESSY} SELECT path, {_PARTIAL} AS incomplete FROM messy")
def incomplete_names(spark, d):
    return tables.messy_files(spark, d).select("path", filters.is_incomplete(F.col("name")).alias("incomplete"))


@query("extension_filter", f"WITH {MESSY} SELECT path, {_EXT} AS extension FROM messy WHERE {_EXT} IN ('.mp4', '.mkv', '.vob')")
def extension_filter(spark, d):
    name = F.col("name")
    return tables.messy_files(spark, d).filter(filters.has_extension(name, filters.parse_extensions("*.MP4; mkv，.vob mp4"))).select("path", N.extension(name).alias("extension"))


@query("size_bounds", f"WITH {MESSY} SELECT path, size FROM messy WHERE size BETWEEN 1048576 AND 5242880")
def size_bounds(spark, d):
    low, high = (filters.megabytes_to_bytes(filters.parse_megabytes(x)) for x in ("1", "5,0"))
    return tables.messy_files(spark, d).filter(F.col("size").between(low, high)).select("path", "size")


# ---- content


def _hashed(spark, d, scope="all"):
    return content.with_hashes(tables.doc_files(spark, d), content.SMART, scope)


_HAVING = {"all": "count(*) >= 2", "same_folder": "count(*) >= 2", "different_folder": "count(DISTINCT folder) >= 2", "different_root": "count(DISTINCT root) >= 2"}


def _scope_query(scope: str) -> None:
    part = "folder" if scope == "same_folder" else "''"

    @query(f"scope_{scope}_hash", f"WITH {DOCS} SELECT size, h AS content_md5, {part} AS part, count(*) AS n_files, (count(*) - 1) * size AS savings FROM docs GROUP BY size, h, {part} HAVING {_HAVING[scope]}")
    def run(spark, d):
        return content.exact_groups(_hashed(spark, d, scope), scope)


for _scope in scopes.SCOPES:
    _scope_query(_scope)


@query("size_buckets", f"WITH {DOCS} SELECT size, count(*) AS n_files FROM docs GROUP BY size HAVING count(*) >= 2")
def size_buckets(spark, d):
    return content.size_buckets(tables.doc_files(spark, d)).drop("part")


@query("hash_workload", f"""WITH {DOCS}, b AS (SELECT size, count(*) AS n FROM docs GROUP BY size HAVING count(*) >= 2)
  SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS candidates, coalesce(sum(n * least(size, 3145728)), 0)::BIGINT AS sample_bytes, coalesce(sum(n * size), 0)::BIGINT AS max_bytes FROM b""")
def hash_workload(spark, d):
    return content.workload(tables.doc_files(spark, d))


@query("sample_spans", """WITH f AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 100)::BIGINT AS size FROM lineitem), s AS (
  SELECT *, 0 AS pos, 0 AS start, size AS length FROM f WHERE size <= 3145728 UNION ALL SELECT *, 0, 0, 1048576 FROM f WHERE size > 3145728
  UNION ALL SELECT *, 1, (size - 1048576) // 2, 1048576 FROM f WHERE size > 3145728 UNION ALL SELECT *, 2, size - 1048576, 1048576 FROM f WHERE size > 3145728)
  SELECT l_orderkey, l_linenumber, pos, start, length FROM s""")
def sample_spans(spark, d):
    size = F.floor(F.col("l_extendedprice") * 100)
    rows = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(content.spans(size)).alias("pos", "s"))
    return rows.select("l_orderkey", "l_linenumber", "pos", F.col("s.offset").alias("start"), F.col("s.length").alias("length"))


@query("exact_groups", f"""WITH {DOCS} SELECT size, h AS content_md5, count(*) AS n_files, (count(*) - 1) * size AS savings FROM docs GROUP BY size, h HAVING count(*) >= 2""")
def exact_groups(spark, d):
    return content.exact_groups(_hashed(spark, d)).drop("part")


@query("exact_members", f"""WITH {DOCS} SELECT path, size, h AS content_md5 FROM docs QUALIFY count(*) OVER (PARTITION BY size, h) >= 2""")
def exact_members(spark, d):
    return content.members(_hashed(spark, d).filter("content_md5 is not null"), ["size", "content_md5"], "all").select("path", "size", "content_md5")


@query("hash_stats", f"""WITH {DOCS}, c AS (SELECT * FROM docs QUALIFY count(*) OVER (PARTITION BY size) >= 2)
  SELECT count(*) AS candidate_files, coalesce(sum(least(size, 3145728)), 0)::BIGINT AS quick_bytes, coalesce(sum(size) FILTER (WHERE size > 3145728), 0)::BIGINT AS full_bytes, count(*) AS md5_computed FROM c""")
def hash_stats(spark, d):
    return content.hash_statistics(_hashed(spark, d))


@query("quick_then_full", f"""WITH {DOCS}, c AS (SELECT *, count(*) OVER (PARTITION BY size) >= 2 AS cand FROM docs)
  SELECT path, CASE WHEN cand THEN md5(size || ':' || hex(content)) END AS quick, CASE WHEN cand THEN h END AS content_md5, CASE WHEN cand THEN '{fixed.HASH_SMALL}' ELSE '{fixed.HASH_NONE}' END AS hash_source FROM c""")
def quick_then_full(spark, d):
    return _hashed(spark, d).select("path", "quick", "content_md5", "hash_source")


@query("blake2_fingerprint")
def blake2_fingerprint(spark, d):
    return tables.doc_files(spark, d).select("path", content.blake2_of_content(F.col("content").cast("binary"), F.col("size")).alias("quick"))


def _cache(files):
    """Entries for two of three files; of those one in five is stale."""
    changed = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    rows = files.filter("doc_id % 3 <> 0").withColumn("quick", F.md5("content"))
    return rows.select("path", "size", (F.col("doc_id") * 1000 + changed).alias("mtime_ns"), F.lit(0).cast("long").alias("ctime_ns"), "quick", F.md5("content").alias("md5"), (F.col("doc_id") * 7919 % 100003).alias("updated"))


@query("cache_lookup_left_join", f"WITH {DOCS} SELECT path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN h END AS cached_md5 FROM docs")
def cache_lookup_left_join(spark, d):
    files = tables.doc_files(spark, d)
    now = files.select("path", "size", (F.col("doc_id") * 1000).alias("mtime_ns"), F.lit(0).cast("long").alias("ctime_ns"), F.md5("content").alias("quick"))
    return content.cached(now, _cache(files)).select("path", "cached_md5")


@query("cache_newest_topk", f"WITH {DOCS} SELECT path, doc_id * 7919 % 100003 + 1 AS updated FROM docs WHERE doc_id % 3 <> 0 ORDER BY updated DESC, path LIMIT 300")
def cache_newest_topk(spark, d):
    old = _cache(tables.doc_files(spark, d))
    return content.merge_cache(old, old.withColumn("updated", F.col("updated") + 1), 300).select("path", "updated")


@query("content_relation", f"""WITH {DOCS}, g AS (SELECT *, size % 97 AS g, count(*) OVER (PARTITION BY size % 97, h) AS n FROM docs)
  SELECT path, CASE WHEN n >= 2 THEN 'MD5相同 ×' || n || '（' || substr(h, 1, 8) || '…）' ELSE 'MD5已验证（组内不同）' END AS relation FROM g""")
def content_relation(spark, d):
    rows = tables.doc_files(spark, d).select("path", (F.col("size") % 97).alias("group_id"), F.md5("content").alias("content_md5"), F.lit(fixed.HASH_SMALL).alias("hash_source"))
    return content.with_relation(rows).select("path", labels.content_relation(F.col("content_md5"), F.col("same_md5"), F.col("hash_source")).alias("relation"))


@query("md5_subgroups", f"WITH {DOCS}, c AS (SELECT size % 97 AS g, h, count(*) AS n FROM docs GROUP BY 1, 2) SELECT g, count_if(n >= 2)::BIGINT AS subgroups FROM c GROUP BY g")
def md5_subgroups(spark, d):
    c = tables.doc_files(spark, d).groupBy((F.col("size") % 97).alias("g"), F.md5("content").alias("h")).count()
    return c.groupBy("g").agg(F.count_if(F.col("count") >= 2).alias("subgroups"))


# ---- names

_FROM, _TO = "無間風雲東", "无间风云东"


@query("norm_translate_cjk", f"SELECT p_partkey, translate('無間風雲東 ' || p_name, '{_FROM}', '{_TO}') AS title FROM part")
def norm_translate_cjk(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", N.to_simplified(F.concat(F.lit("無間風雲東 "), "p_name"), N.simplified(spark)).alias("title"))


@query("norm_domains", rf"SELECT page_id, translate(regexp_replace(lower(url) || ' at@home', '{N.DOMAIN.replace('?:', '?:')}', ' ', 'g'), '@', ' ') AS cleaned FROM pages")
def norm_domains(spark, d):
    return tables.page_names(spark, d).select("page_id", N.without_domains(F.concat(F.lower("url"), F.lit(" at@home"))).alias("cleaned"))


@query("norm_brackets", "SELECT p_partkey, translate('《' || p_name || '》[x](y)', '《》[]()', '      ') AS title FROM part")
def norm_brackets(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", N.unbracketed(F.concat(F.lit("《"), "p_name", F.lit("》[x](y)"))).alias("title"))


@query("norm_noise_phrases", rf"SELECT p_partkey, regexp_replace(p_name || '.web-dl.Blu ray国语中字'.lower(), '{fixed.NOISE_PHRASES}|国语中字', ' ', 'g') AS title FROM part")
def norm_noise_phrases(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", N.without_phrases(F.concat("p_name", F.lit(".web-dl.blu ray国语中字"))).alias("title"))


_KEPT = r"[^0-9a-z\x{3400}-\x{9FFF}]+"
_TAG = "CASE p_size % 4 WHEN 0 THEN '.1080p' WHEN 1 THEN '.720p.BluRay' WHEN 2 THEN '.x265' ELSE '' END"
TITLES = rf"""titles AS (
  SELECT *, list_filter(string_split_regex(lower(translate(coalesce(p_name, ''), ' ', '.') || {_TAG}), '{_KEPT}'), lambda t: t <> '' AND NOT regexp_full_match(t, '{N.NOISE}')) AS tokens FROM part)"""


def _infos(spark, d):
    """part_titles with idx and name_info, written once: the parse is read many times."""
    files = indexed(tables.part_titles(spark, d))
    return Scratch(spark, "titles").save(N.with_name_info(files.withColumn("stem", N.stem(F.col("name"))), "stem"), "titles")


@query("norm_tokens", f"WITH {TITLES} SELECT p_partkey, array_to_string(tokens, '|') AS tokens FROM titles")
def norm_tokens(spark, d):
    rows = tables.part_titles(spark, d)
    return rows.select("p_partkey", F.array_join(N.raw_tokens(N.without_phrases(N.without_domains(F.lower(N.stem(F.col("name")))))), "|").alias("tokens"))


@query("norm_primary", f"WITH {TITLES} SELECT p_partkey, array_to_string(tokens, '') AS title FROM titles")
def norm_primary(spark, d):
    rows = N.with_name_info(tables.part_titles(spark, d).withColumn("stem", N.stem(F.col("name"))), "stem")
    return rows.select("p_partkey", F.col("name_info.primary").alias("title"))


ORDERS = """o AS (SELECT o_orderkey, lower(c_mktsegment) AS s, lower(n_name) AS n, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("norm_years", f"WITH {ORDERS} SELECT o_orderkey, y::VARCHAR AS years FROM o")
def norm_years(spark, d):
    return tables.order_titles(spark, d).select("o_orderkey", F.array_join(N.release_years(F.col("stem"), F.lit(None).cast("string")).cast("array<string>"), "|").alias("years"))


@query("norm_aliases", rf"""WITH {ORDERS}, p AS (SELECT o_orderkey, s || replace(n, '_', '') AS b, y FROM o)
  SELECT o_orderkey, b || y || '|' || b || CASE WHEN regexp_matches(b, '^.{{2,}}1$') THEN '|' || regexp_extract(b, '^(.{{2,}})0?1$', 1) ELSE '' END AS aliases FROM p""")
def norm_aliases(spark, d):
    return N.with_name_info(tables.order_titles(spark, d), "stem").select("o_orderkey", F.array_join("name_info.aliases", "|").alias("aliases"))


@query("norm_full_struct", rf"""WITH {ORDERS}, p AS (SELECT *, s || replace(n, '_', '') AS b FROM o)
  SELECT o_orderkey, b || y AS title, s || ' ' || n || ' ' || y AS display, s || '|' || replace(n, '_', '') || '|' || y AS tokens, 'title' AS kind, NULL::VARCHAR AS catalog_key, NULL::VARCHAR AS part_marker FROM p""")
def norm_full_struct(spark, d):
    i = lambda f: F.col(f"name_info.{f}")
    rows = N.with_name_info(tables.order_titles(spark, d), "stem")
    return rows.select("o_orderkey", i("primary").alias("title"), i("cleaned_display").alias("display"), F.array_join(i("tokens"), "|").alias("tokens"), i("identity_kind").alias("kind"), i("catalog_key").alias("catalog_key"), i("part_marker").alias("part_marker"))


@query("norm_catalog_key", "SELECT l_orderkey, l_linenumber, 'abc-' || l_partkey AS catalog_key FROM lineitem")
def norm_catalog_key(spark, d):
    return tables.catalog_names(spark, d).select("l_orderkey", "l_linenumber", N.catalog(F.lower(N.stem(F.col("name"))))["key"].alias("catalog_key"))


@query("norm_part_marker", "SELECT l_orderkey, l_linenumber, 'part' || l_linenumber AS part_marker FROM lineitem")
def norm_part_marker(spark, d):
    text = F.lower(N.stem(F.col("name")))
    return tables.catalog_names(spark, d).select("l_orderkey", "l_linenumber", N.let(text, lambda t: N.part_marker(t, N.catalog(t)["tail"])).alias("part_marker"))


@query("norm_dated_episode", "SELECT event_id, event_type AS series, strftime(ts, '%Y-%m-%d') AS date, 'user' || user_id AS title FROM events")
def norm_dated_episode(spark, d):
    rows = tables.event_episodes(spark, d).withColumn("e", N.let(F.lower(N.stem(F.col("name"))), N.dated_episode))
    return rows.select("event_id", F.array_join("e.series", "").alias("series"), F.col("e.date").alias("date"), F.array_join("e.title", "|").alias("title"))


@query("norm_season_episode", "SELECT l_orderkey, l_linenumber, 'theshow' AS series, 's' || lpad(l_linenumber::VARCHAR, 2, '0') || 'e' || CASE WHEN l_partkey % 1000 < 10 THEN '0' ELSE '' END || (l_partkey % 1000) AS id FROM lineitem")
def norm_season_episode(spark, d):
    li = tables.table(spark, d, "lineitem")
    name = F.concat(F.lit("the.show.s"), F.col("l_linenumber").cast("string"), F.lit("e"), (F.col("l_partkey") % 1000).cast("string"), F.lit(".1080p"))
    rows = li.select("l_orderkey", "l_linenumber", N.let(name, N.season_episode).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("e.series", "").alias("series"), F.col("e.id").alias("id"))


@query("norm_episode_only", "SELECT l_orderkey, l_linenumber, 'e' || CASE WHEN l_partkey % 1000 < 100 THEN lpad((l_partkey % 1000)::VARCHAR, 3, '0') ELSE (l_partkey % 1000)::VARCHAR END AS id FROM lineitem")
def norm_episode_only(spark, d):
    li = tables.table(spark, d, "lineitem")
    name = F.concat(F.lit("the show ep "), (F.col("l_partkey") % 1000).cast("string"))
    return li.select("l_orderkey", "l_linenumber", N.let(name, N.numbered_episode)["id"].alias("id"))


@query("norm_roman_suffix", "SELECT p_partkey, p_name || ' ' || (p_size % 10 + 1) || ' 1999' AS title FROM part")
def norm_roman_suffix(spark, d):
    roman = F.get(F.array(*map(F.lit, fixed.ROMAN)), F.col("p_size") % 10)
    return tables.table(spark, d, "part").select("p_partkey", N.arabic_suffix(F.concat_ws(" ", "p_name", roman, F.lit("1999"))).alias("title"))


@query("disc_parent_identity", "SELECT p_partkey, 'disc:vts' || lpad((p_size % 9 + 1)::VARCHAR, 2, '0') || '-01' AS segment, CASE WHEN p_partkey + 100 NOT BETWEEN 1900 AND 2099 THEN 'stars-' || (p_partkey + 100) END AS catalog_key, '上级影片目录' AS identity_source FROM part")
def disc_parent_identity(spark, d):
    p = tables.table(spark, d, "part")
    path = F.concat(F.lit("/lib/STARS-"), (F.col("p_partkey") + 100).cast("string"), F.lit("/VIDEO_TS/VTS_0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("_1.VOB"))
    # numbers of four digits that look like a year are kept by the hyphen only for short prefixes
    rows = N.with_path_info(p.select("p_partkey", path.alias("path"), F.lit("/lib").alias("root")))
    return rows.select("p_partkey", F.col("name_info.part_marker").alias("segment"), F.col("name_info.catalog_key").alias("catalog_key"), F.col("name_info.identity_source").alias("identity_source"))


# ---- blocks, pairs, groups

INFO = rf"""{TITLES}, f AS (
  SELECT row_number() OVER (ORDER BY '/films/' || replace(lower(p_brand), '#', '') || '/' || (p_partkey % 10) || '/v' || p_partkey || '/') - 1 AS idx, tokens, array_to_string(tokens, '') AS p FROM titles),
gram AS (SELECT idx, unnest(list_slice(list_sort(list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2)))), 1, 12)) AS g FROM f),
keys AS (
  SELECT idx, 'alias:' || p AS key FROM f UNION ALL SELECT idx, 'token:' || t FROM (SELECT idx, unnest(list_distinct(tokens)) AS t FROM f) WHERE length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')
  UNION ALL SELECT idx, 'gram:' || g FROM gram)"""

PAIRS = f"""{INFO}, sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY idx) AS r FROM keys),
near AS (SELECT idx, row_number() OVER (ORDER BY p, idx) AS r FROM f),
pairs AS (
  SELECT a.idx AS i, b.idx AS j FROM sized a JOIN sized b ON a.key = b.key AND a.r < b.r WHERE a.n <= 300 OR b.r <= a.r + 50
  UNION SELECT least(a.idx, b.idx), greatest(a.idx, b.idx) FROM near a JOIN near b ON b.r > a.r AND b.r <= a.r + 20)"""


@query("block_keys", f"WITH {INFO} SELECT idx, key FROM keys")
def block_keys(spark, d):
    return blocking.block_keys(_infos(spark, d))


@query("block_bucket_counts", f"WITH {INFO} SELECT key, count(*) AS n FROM keys GROUP BY key HAVING count(*) >= 2")
def block_bucket_counts(spark, d):
    return blocking.blocks(blocking.block_keys(_infos(spark, d)))


@query("candidate_pairs_capped", f"WITH {PAIRS} SELECT i, j FROM pairs")
def candidate_pairs_capped(spark, d):
    return blocking.candidate_pairs(_infos(spark, d))


@query("sorted_neighbourhood", f"WITH {INFO}, near AS (SELECT idx, row_number() OVER (ORDER BY p, idx) AS r FROM f) SELECT a.idx AS i, b.idx AS j FROM near a JOIN near b ON b.r > a.r AND b.r <= a.r + 20")
def sorted_neighbourhood(spark, d):
    return blocking.neighbours(blocking.title_order(_infos(spark, d), Scratch(spark, "order")))


RULED = f"""{PAIRS}, ruled AS (
  SELECT i, j, CASE WHEN a.p = b.p THEN 1.0 WHEN len(list_distinct(a.tokens)) >= 2 AND list_sort(list_distinct(a.tokens)) = list_sort(list_distinct(b.tokens)) THEN 0.96 WHEN len(a.tokens) <> len(b.tokens) THEN 0.0
    WHEN len(a.tokens) < 2 AND (least(length(a.p), length(b.p)) < 4 OR least(length(a.p), length(b.p)) / greatest(length(a.p), length(b.p)) < 0.85) THEN 0.0 END::DOUBLE AS score
  FROM pairs JOIN f a ON i = a.idx JOIN f b ON j = b.idx)"""


def _ruled(files, pairs):
    a, b = files.select(F.col("idx").alias("i"), F.col("name_info").alias("a")), files.select(F.col("idx").alias("j"), F.col("name_info").alias("b"))
    return pairs.join(merged(a), "i").join(merged(b), "j").select("i", "j", scoring.rules(F.col("a"), F.col("b"))["score"].alias("score"))


@query("pair_veto_scores", f"WITH {RULED} SELECT i, j, score FROM ruled")
def pair_veto_scores(spark, d):
    files = _infos(spark, d)
    return _ruled(files, blocking.candidate_pairs(files))


@query("bigram_jaccard", f"""WITH {INFO}, near AS (SELECT idx, p, row_number() OVER (ORDER BY p, idx) AS r, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS g FROM f)
  SELECT a.idx AS i, b.idx AS j, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS jaccard FROM near a JOIN near b ON b.r > a.r AND b.r <= a.r + 20""")
def bigram_jaccard(spark, d):
    files = _infos(spark, d)
    pairs = blocking.neighbours(blocking.title_order(files, Scratch(spark, "order")))
    a, b = files.select(F.col("idx").alias("i"), F.col("name_info.primary").alias("p")), files.select(F.col("idx").alias("j"), F.col("name_info.primary").alias("q"))
    return pairs.join(merged(a), "i").join(merged(b), "j").select("i", "j", F.round(scoring.bigram_jaccard(F.col("p"), F.col("q")), 9).alias("jaccard"))


@query("pair_similarity")
def pair_similarity(spark, d):
    return works.similarity(_infos(spark, d))


#: Two names, and what the rules say of them.
_JUDGED = [
    ("ABC-123", "abc-123 1080p", 1.0, "作品编号完全相同"), ("ABC-123", "ABC-124", 0.0, "作品编号不同"), ("ABC-123", "some film", 0.0, "一侧为作品编号，另一侧为普通标题"), ("the.show.s01e02", "the.show.s01e03", 0.0, "同一系列但季集编号不同"),
    ("the.show.s01e02", "The.Show.S01E02.720p", 1.0, "系列名称与季集编号完全相同"), ("the.show.s01e02", "other.show.s01e02", 0.0, "系列名称不同"), ("studio.2023.01.02.red.door", "studio.2023.01.03.red.door", 0.0, "同一系列但作品日期不同"),
    ("studio.2023.01.02.red.door", "studio.2023.01.02.door.red", 0.98, "系列、日期和单集标题相同，仅词语顺序不同"), ("studio.2023.01.02", "studio.2023.01.02.red.door", 0.94, "系列与日期相同，其中一侧缺少单集标题"),
    ("studio.2023.01.02.red.door", "studio.2023.01.02.red.door", 1.0, "系列、日期和单集标题完全相同"), ("studio.2023.01.02.red.door", "studio.2023.01.02.red.blue.door", 0.0, "系列与日期相同，但单集标题包含不同实质词语"),
    ("studio.2023.01.02.red.door", "the.show.s01e02", 0.0, "作品身份类型不同"), ("great film part1", "great film part2", 0.0, "同一作品的分段标记不同，不作为可互删的重复文件"), ("great film 1999", "great film 2005", 0.0, "标题年份不同，为防止合并同名翻拍作品"),
    ("great film 1999", "great film", 0.96, "标题相同，其中一侧包含发行年份"), ("great film 2", "great film 3", 0.0, "作品标题中的数字或续集编号不同"), ("great film", "Great.Film.1080p.BluRay", 1.0, "清理画质/格式标签后标题相同"),
    ("quiet red door", "red quiet door", 0.96, "标题词语相同，仅排列顺序不同"), ("quiet red door", "quiet door", 0.0, "作品标题包含不同的实质词语"), ("wonderful picture", "zebra mountain", 0.0, "作品标题共享系列词，但包含不同的实质词语"),
]


@query("pair_rules", "SELECT p_partkey AS k, CASE p_partkey % 20 " + " ".join(f"WHEN {k} THEN {score}::DOUBLE" for k, (_, _, score, _) in enumerate(_JUDGED)) + " END AS score, CASE p_partkey % 20 " + " ".join(f"WHEN {k} THEN '{said}'" for k, (*_, said) in enumerate(_JUDGED)) + " END AS reason FROM part")
def pair_rules(spark, d):
    k = F.col("p_partkey")
    pick = lambda side: F.get(F.array(*(F.lit(x[side]) for x in _JUDGED)), (k % 20).cast("int"))
    p = tables.table(spark, d, "part")
    names = p.select((2 * k).alias("idx"), pick(0).alias("stem")).unionByName(p.select((2 * k + 1).alias("idx"), pick(1).alias("stem")))
    pairs = p.select((2 * k).alias("i"), (2 * k + 1).alias("j"))
    return scoring.scored(pairs, N.with_name_info(names, "stem")).select(F.floor(F.col("i") / 2).alias("k"), "score", "reason")


# equal scores of 0.96 or more join titles with the same set of words; within it candidates are connected
@query("name_components", f"""WITH RECURSIVE {RULED}, e AS (SELECT i AS a, j AS b FROM ruled WHERE score >= 0.9 UNION SELECT j, i FROM ruled WHERE score >= 0.9),
  ways AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, w.low FROM ways w JOIN e ON e.a = w.node WHERE w.low < e.b)
  SELECT node, min(low) AS component FROM ways GROUP BY node""")
def name_components(spark, d):
    files = _infos(spark, d)
    scratch = Scratch(spark, "components")
    edges = scratch.save(_ruled(files, blocking.candidate_pairs(files)).filter("score >= 0.9").select("i", "j"), "edges")
    return components.components(edges, "i", "j", scratch)


@query("anchor_split_groups")
def anchor_split_groups(spark, d):
    groups, members = clusters.name_groups(_infos(spark, d))
    return members.join(merged(groups), "group").select("group", "idx", "confidence", "reason")


@query("group_ids", """WITH g AS (SELECT p_name, list_sort(list(lower('/films/' || replace(lower(p_brand), '#', '') || '/' || (p_partkey % 10) || '/v' || p_partkey || '/'))) AS paths FROM part GROUP BY p_name)
  SELECT p_name AS "group", substr(sha1(array_to_string(paths, chr(10))), 1, 12) AS group_id FROM g""")
def group_ids(spark, d):
    p = tables.part_titles(spark, d).join(tables.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = p.select("p_name", F.col("p_partkey").alias("idx"), F.concat("folder", F.lit("/")).alias("path"))
    return clusters.with_group_ids(rows.select(F.col("p_name").alias("group"), "idx"), rows)


MERGE = f"""{DOCS}, nm AS (SELECT doc_id AS idx, substr(root, 6) || '-' || doc_id // 4 AS g FROM docs WHERE doc_id % 5 <> 0), hm AS (SELECT doc_id AS idx, size || '-' || h AS g FROM docs QUALIFY count(*) OVER (PARTITION BY size, h) >= 2),
  m AS (SELECT nm.g AS ng, nm.idx, hm.g AS hg FROM nm LEFT JOIN hm USING (idx)), s AS (SELECT ng, min(hg) AS one, max(hg) AS other, count_if(hg IS NULL)::BIGINT AS extras FROM m GROUP BY ng),
  merged AS (
    SELECT 'hash:' || g AS "group", idx, NULL AS from_name FROM hm
    UNION ALL SELECT 'hash:' || one, idx, ng FROM m JOIN s USING (ng) WHERE hg IS NULL AND one = other
    UNION ALL SELECT 'name:' || ng, idx, ng FROM m JOIN s USING (ng) WHERE hg IS NULL AND (one IS NULL OR one <> other) AND extras >= 2)"""


def _merged(spark, d):
    files = tables.doc_files(spark, d)
    source = F.regexp_extract("root", "/lib/(.*)", 1)
    names = files.filter("doc_id % 5 <> 0").select(F.concat_ws("-", source, F.floor(F.col("doc_id") / 4).cast("string")).alias("group"), F.col("doc_id").alias("idx"))
    hashes = content.members(files.withColumn("h", F.md5("content")), ["size", "h"], "all").select(F.concat_ws("-", "size", "h").alias("group"), F.col("doc_id").alias("idx"))
    return names, merge.merged_members(names, hashes)


@query("merged_members", f'WITH {MERGE} SELECT "group", idx, from_name FROM merged')
def merged_members(spark, d):
    return _merged(spark, d)[1]


@query("merged_groups", f"""WITH {MERGE} SELECT "group", count(*) AS n_files, CASE WHEN "group" LIKE 'hash:%' AND count(from_name) > 0 THEN 'mixed' WHEN "group" LIKE 'hash:%' THEN 'hash' ELSE 'name' END AS match_kind FROM merged GROUP BY "group" """)
def merged_groups(spark, d):
    names, members = _merged(spark, d)
    groups = names.select("group").distinct().withColumns({"confidence": F.lit(0.95), "reason": F.lit("x")})
    return merge.merged_groups(members, groups).select("group", "n_files", "match_kind")


@query("merged_notes", f"""WITH {MERGE}, n AS (SELECT *, CASE WHEN length(from_name) % 3 = 0 THEN 'note ' || length(from_name) WHEN length(from_name) % 3 = 1 THEN '' END AS note, length(from_name) % 5 = 0 AS warned FROM merged),
  d AS (SELECT "group", note, min(from_name) AS least FROM n WHERE note <> '' GROUP BY ALL), t AS (SELECT "group", string_agg(note, '；' ORDER BY least) AS notes FROM d GROUP BY 1)
  SELECT n."group", concat_ws('；', CASE WHEN n."group" LIKE 'hash:%' AND length(n."group") % 2 = 0 THEN 'same' END, any_value(t.notes)) AS metadata_note,
    coalesce(bool_or(n.warned), false) OR (n."group" LIKE 'hash:%' AND length(n."group") % 7 = 0) AS safety_warning
  FROM n LEFT JOIN t ON n."group" = t."group" GROUP BY n."group" """)
def merged_notes(spark, d):
    names, members = _merged(spark, d)
    n = F.length("group")
    groups = names.select("group").distinct().withColumns({"confidence": F.lit(0.95), "reason": F.lit("x"), "metadata_note": F.when(n % 3 == 0, F.concat(F.lit("note "), n.cast("string"))).when(n % 3 == 1, ""), "safety_warning": n % 5 == 0})
    hashes = members.filter("group like 'hash:%'").select(F.substring("group", 6, 1000).alias("group")).distinct()
    hashes = hashes.withColumns({"metadata_note": F.when((F.length("group") + 5) % 2 == 0, "same"), "safety_warning": (F.length("group") + 5) % 7 == 0})
    return merge.merged_groups(members, groups, hashes).select("group", "metadata_note", "safety_warning")


# ---- quality and decisions

_HEIGHT = "CASE p_size % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 END"
_CONTAINER = "CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 9 ELSE 6 END"
RANKED = f"""r AS (SELECT *, coalesce({_HEIGHT}, 0) AS h, (coalesce({_HEIGHT}, 0) * 16 // 9) * coalesce({_HEIGHT}, 0) AS pixels, {_CONTAINER} AS container, floor(p_retailprice * 1000)::BIGINT AS size FROM part)"""


def _films(spark, d):
    """part_titles grouped by the part's name, with made-up lengths and heights."""
    p = tables.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("group"), "p_size")
    rows = tables.part_titles(spark, d).join(p, "p_partkey").withColumn("idx", F.col("p_partkey"))
    return rows.withColumns({
        "duration_seconds": F.when(F.col("p_size") % 7 != 0, F.lit(3600.0) + (F.col("p_partkey") % 1000) * 0.5), "measured": F.when(F.col("p_size") % 5 == 0, 2160).when(F.col("p_size") % 5 == 1, 720),
        "match_kind": F.when(F.length("group") % 3 == 0, "hash").otherwise("name"), "content_md5": F.md5(F.when(F.length("group") % 2 == 0, F.col("group")).otherwise(F.col("path"))),
    })


@query("quality_rank_top1", f'WITH {RANKED} SELECT p_name AS "group", p_partkey AS keep FROM r QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY pixels DESC, container DESC, size DESC, p_partkey) = 1')
def quality_rank_top1(spark, d):
    return quality.best(_films(spark, d)).select("group", "keep")


@query("estimated_savings", f"""WITH {RANKED}, g AS (SELECT p_name, count(*) AS n, sum(size)::BIGINT AS total, arg_max(size, (pixels, container, size)) AS kept FROM r GROUP BY p_name)
  SELECT p_name AS "group", n AS n_files, total AS total_size, CASE WHEN n >= 2 THEN total - kept ELSE 0 END AS estimated_savings FROM g""")
def estimated_savings(spark, d):
    return quality.savings(_films(spark, d)).drop("duration_span")


@query("guessed_height", f"SELECT p_partkey, coalesce({_HEIGHT}, 0) AS height, CASE p_size % 4 WHEN 0 THEN '约 1080P（文件名）' WHEN 1 THEN '约 720P（文件名）' ELSE '未知' END AS resolution FROM part")
def guessed_height(spark, d):
    guess, none = labels.guessed_height(F.col("name")), F.lit(None).cast("int")
    return tables.part_titles(spark, d).select("p_partkey", F.coalesce(guess, F.lit(0)).alias("height"), labels.resolution(none, none, guess).alias("resolution"))


@query("display_name", f"""WITH {TITLES}, t AS (SELECT p_name, p_partkey, array_to_string(tokens, ' ') AS shown FROM titles) SELECT p_name AS "group", arg_min(shown, (length(shown), p_partkey)) AS display_name FROM t GROUP BY p_name""")
def display_name(spark, d):
    rows = tables.part_titles(spark, d).join(tables.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").withColumn("stem", N.stem(F.col("name")))
    return quality.display_names(N.with_name_info(rows, "stem").select(F.col("p_name").alias("group"), F.col("p_partkey").alias("pos"), "name_info"))


ASSESSED = f"""{RANKED}, x AS (
  SELECT *, CASE WHEN p_size % 7 <> 0 THEN (3600.0 + (p_partkey % 1000) * 0.5)::DOUBLE END AS d, CASE p_size % 5 WHEN 0 THEN 2160 WHEN 1 THEN 720 END AS mh, CASE WHEN length(p_name) % 3 = 0 THEN 'hash' ELSE 'name' END AS kind,
    CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS m FROM r),
g AS (SELECT p_name, any_value(kind) AS kind, min(d) AS d0, max(d) AS d1, count(d) AS dn, min(mh) AS h0, max(mh) AS h1, count(mh) AS hn, count(DISTINCT m) AS ms FROM x GROUP BY p_name),
a AS (SELECT *, kind = 'hash' AND ms = 1 AS same, dn >= 2 AND d1 - d0 <= greatest(8.0, d0 * 0.01) AS close, dn >= 2 AND d1 - d0 > greatest(30.0, d0 * 0.03) AS far FROM g),
assessed AS (
  SELECT p_name, kind, NOT same AND far AND NOT close AS safety_warning, CASE WHEN same THEN '同尺寸且完整 MD5 相同' ELSE concat_ws('；',
    CASE WHEN close THEN '视频时长接近' WHEN far THEN '片长相差约 ' || CASE WHEN d1 - d0 >= 60 THEN printf('%.1f', (d1 - d0) / 60) || ' 分钟' ELSE round_even(d1 - d0, 0)::BIGINT || ' 秒' END || '，可能不是同一内容或存在缺失' WHEN dn >= 2 THEN '片长存在小幅差异，建议播放复核' END,
    CASE WHEN hn >= 2 AND h1 >= 2 * h0 THEN '分辨率差异较大' END) END AS metadata_note FROM a)"""


@query("assess_metadata", f'WITH {ASSESSED} SELECT p_name AS "group", safety_warning, metadata_note FROM assessed')
def assess_metadata(spark, d):
    return quality.assess(_films(spark, d).withColumn("height", F.col("measured")))


@query("smart_choice", f"""WITH {ASSESSED} SELECT p_name AS "group", p_partkey AS idx, size, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY pixels DESC, container DESC, size DESC, p_partkey) = 1 THEN '保留'
  WHEN safety_warning AND assessed.kind <> 'hash' THEN '未决定' ELSE '删除' END AS action FROM x JOIN assessed USING (p_name)""")
def smart_choice(spark, d):
    films = _films(spark, d)
    return quality.smart_choice(films, quality.assess(films.withColumn("height", F.col("measured"))))


@query("action_summary", f"""WITH {ASSESSED}, c AS (SELECT size, row_number() OVER (PARTITION BY p_name ORDER BY pixels DESC, container DESC, size DESC, p_partkey) > 1 AND NOT (safety_warning AND assessed.kind <> 'hash') AS del FROM x JOIN assessed USING (p_name))
  SELECT count_if(del)::BIGINT AS marked, coalesce(sum(size) FILTER (WHERE del), 0)::BIGINT AS bytes FROM c""")
def action_summary(spark, d):
    return quality.action_summary(smart_choice(spark, d))


def _snapshot(spark, d):
    p = tables.table(spark, d, "part")
    path = F.concat(F.lit("/v/"), F.col("p_partkey").cast("string"))
    action = F.when(F.col("p_partkey") % 3 == 0, fixed.KEEP).when(F.col("p_partkey") % 3 == 1, fixed.DELETE).otherwise(F.when(F.col("p_size") % 2 == 0, fixed.DELETE).otherwise(fixed.UNDECIDED))
    then = p.select(F.floor(F.col("p_partkey") / 4).alias("group"), path.alias("path"), F.floor(F.col("p_retailprice") * 1000).alias("size"), (F.col("p_partkey") + 0.25).alias("mtime"), F.when(F.col("p_partkey") % 2 == 0, "exact").otherwise("seconds").alias("time_precision"), action.alias("action"))
    k = F.col("p_partkey")
    now = p.filter(k % 11 != 0).select(path.alias("path"), F.lit(True).alias("exists"), (k % 13 != 0).alias("is_regular"), (k % 17 == 0).alias("is_symlink"), (F.floor(F.col("p_retailprice") * 1000) + F.when(k % 7 == 0, 1).otherwise(0)).alias("size"), (k + F.when(k % 5 == 0, 0.5).otherwise(0.25)).alias("mtime"))
    return then, now


SNAP = """s AS (SELECT p_partkey AS k, p_partkey // 4 AS g, '/v/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN '保留' WHEN p_partkey % 3 = 1 OR p_size % 2 = 0 THEN '删除' ELSE '未决定' END AS action,
  floor(p_retailprice * 1000)::BIGINT AS size,
  CASE WHEN p_partkey % 11 = 0 THEN '文件不存在（可能已移动或已经删除）' WHEN p_partkey % 17 = 0 THEN '路径已变为符号链接，已按安全规则忽略' WHEN p_partkey % 13 = 0 THEN '路径当前不是普通文件，已按安全规则忽略'
    WHEN p_partkey % 7 = 0 THEN '文件大小已变化（扫描时 ' || floor(p_retailprice * 1000)::BIGINT || ' 字节，当前 ' || (floor(p_retailprice * 1000)::BIGINT + 1) || ' 字节）'
    WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN '文件修改时间已变化' END AS issue FROM part)"""
PLAN = f"""{SNAP}, g AS (SELECT g, count_if(action = '删除' AND issue IS NULL)::BIGINT AS ready, count_if(action <> '删除')::BIGINT AS others, count_if(action <> '删除' AND issue IS NULL)::BIGINT AS intact FROM s GROUP BY g),
  m AS (SELECT *, action = '删除' AS marked, others > 0 AND intact = 0 AND ready > 0 AS clash FROM s JOIN g USING (g))"""


@query("snapshot_inspection", f"WITH {SNAP} SELECT path, issue FROM s")
def snapshot_inspection(spark, d):
    return planning.inspected(*_snapshot(spark, d)).select("path", "issue")


@query("deletion_plan", f"""WITH {PLAN}, p AS (
  SELECT path, CASE WHEN marked AND (issue IS NOT NULL OR others = 0 OR clash) THEN 'ignored' WHEN marked THEN 'ready' WHEN clash AND issue IS NOT NULL THEN 'survivor_issue' END AS status,
    CASE WHEN marked AND issue IS NOT NULL THEN issue WHEN marked AND others = 0 THEN '候选组没有保留或未删除文件，为防止整组被删除已自动忽略' WHEN marked AND clash THEN '候选组中没有状态正常的保留文件，为防止整组被删除已自动忽略'
      WHEN NOT marked AND clash THEN '原保留/非删除文件状态异常：' || issue END AS message FROM m)
  SELECT path, status, message FROM p WHERE status IS NOT NULL""")
def deletion_plan(spark, d):
    return planning.plan(*_snapshot(spark, d)).select("path", "status", "message")


@query("conflict_choices", f"""WITH {PLAN}, c AS (SELECT *, CASE WHEN g >= 300 THEN 'all' WHEN g % 3 = 0 THEN 'one' ELSE 'none' END AS choice FROM m), p AS (
  SELECT path, CASE WHEN marked AND (issue IS NOT NULL OR others = 0) THEN 'ignored' WHEN marked AND clash THEN CASE choice WHEN 'none' THEN 'ignored' ELSE 'ready' END WHEN marked THEN 'ready' WHEN clash AND issue IS NOT NULL THEN 'survivor_issue' END AS status,
    CASE WHEN marked AND issue IS NOT NULL THEN issue WHEN marked AND others = 0 THEN '候选组没有保留或未删除文件，为防止整组被删除已自动忽略' WHEN marked AND clash AND choice = 'none' THEN '原保留文件状态异常，用户选择安全忽略本组'
      WHEN NOT marked AND clash THEN '原保留/非删除文件状态异常：' || issue || CASE choice WHEN 'all' THEN '；用户选择本次后续同类情况全部继续' WHEN 'one' THEN '；用户选择仅本组继续' ELSE '；用户选择安全忽略本组' END END AS message FROM c)
  SELECT path, status, message FROM p WHERE status IS NOT NULL""")
def conflict_choices(spark, d):
    then, now = _snapshot(spark, d)
    choices = then.select("group").distinct().filter("group % 3 = 0 OR group >= 300").withColumn("choice", F.when(F.col("group") == 300, "continue_all").when(F.col("group") == 303, "cancel").when(F.col("group") % 3 == 0, "continue").otherwise("ignore"))
    return planning.resolved(planning.plan(then, now, "report"), choices.unionByName(spark.createDataFrame([(300, "continue_all")], choices.schema)).distinct()).select("path", "status", "message")


@query("deletion_preview", f"""WITH {PLAN}, r AS (SELECT * FROM m WHERE marked AND issue IS NULL AND others > 0 AND NOT clash)
  SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, count(DISTINCT g) FILTER (WHERE g % 5 = 0) AS warning_groups, greatest(count(*) - 8, 0) AS more,
    (SELECT string_agg(substr(path, 4), chr(10) ORDER BY g, path) FROM (SELECT g, path FROM r ORDER BY g, path LIMIT 8)) AS names FROM r""")
def deletion_preview(spark, d):
    then, now = _snapshot(spark, d)
    groups = then.select("group").distinct().withColumn("safety_warning", F.col("group") % 5 == 0)
    return planning.preview(planning.plan(then, now).filter("status = 'ready'"), groups)


@query("ignored_list", f"""WITH {SNAP} SELECT '2024-01-02T03:04:05' AS at, '当前扫描结果' AS source, CASE WHEN action = '删除' THEN '删除标记已忽略' ELSE '原保留/非删除文件异常' END AS kind, 'g' || g AS title, k::VARCHAR AS name, path, issue AS message, size::VARCHAR AS size,
  strftime(to_timestamp(k) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS modified FROM s WHERE issue IS NOT NULL""")
def ignored_list(spark, d):
    wrong = planning.inspected(*_snapshot(spark, d)).filter("issue is not null")
    none = F.lit(None)
    items = wrong.select(F.concat(F.lit("g"), F.col("group").cast("string")).alias("group_name"), "path", F.col("issue").alias("message"), (F.col("action") != fixed.DELETE).alias("preserve_action"), "size", none.cast("long").alias("size_now"), "mtime", none.cast("double").alias("mtime_now"))
    r = report.ignored_rows(items, "2024-01-02T03:04:05")
    return r.select(*(F.col(f"`{a}`").alias(b) for a, b in (("忽略时间", "at"), ("来源报告", "source"), ("记录类型", "kind"), ("候选作品", "title"), ("文件名", "name"), ("完整路径", "path"), ("忽略原因", "message"), ("扫描时大小(字节)", "size"), ("扫描时修改时间", "modified"))))


_MARKS = "SELECT p_partkey // 4 AS g, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '保留' WHEN p_partkey % 3 = 1 OR p_size % 2 = 0 THEN '删除' ELSE '未决定' END AS action, p_size % 3 = 0 AS hit FROM part"


def _marks(spark, d):
    rows = _snapshot(spark, d)[0].withColumn("idx", F.substring("path", 4, 20).cast("long"))
    chosen = tables.table(spark, d, "part").filter("p_size % 3 = 0").select(F.floor(F.col("p_partkey") / 4).alias("group"), F.col("p_partkey").alias("idx"))
    return rows.select("group", "idx", "action"), chosen


@query("mark_delete", f"WITH m AS ({_MARKS}) SELECT k AS idx, CASE WHEN hit AND count_if(NOT hit AND action <> '删除') OVER (PARTITION BY g) > 0 THEN '删除' ELSE action END AS action FROM m")
def mark_delete(spark, d):
    return quality.mark(*_marks(spark, d), fixed.DELETE).select("idx", "action")


@query("mark_keep", f"WITH m AS ({_MARKS}) SELECT k AS idx, CASE WHEN hit THEN '保留' WHEN action = '保留' AND bool_or(hit) OVER (PARTITION BY g) THEN '未决定' ELSE action END AS action FROM m")
def mark_keep(spark, d):
    return quality.mark(*_marks(spark, d), fixed.KEEP).select("idx", "action")


@query("mark_pending", f"WITH m AS ({_MARKS}) SELECT k AS idx, CASE WHEN hit THEN '未决定' ELSE action END AS action FROM m")
def mark_pending(spark, d):
    return quality.mark(*_marks(spark, d), fixed.UNDECIDED).select("idx", "action")


@query("mark_refused", f"""WITH m AS ({_MARKS}) SELECT g AS "group" FROM m GROUP BY g HAVING bool_or(hit) AND count_if(NOT hit AND action <> '删除') = 0""")
def mark_refused(spark, d):
    return quality.refused(*_marks(spark, d))


@query("post_delete_state", f"""WITH {SNAP}, o AS (SELECT *, CASE k % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'ignored' ELSE 'failed' END AS result FROM s WHERE action = '删除'), l AS (
  SELECT s.g, s.path, CASE o.result WHEN 'ignored' THEN '忽略' WHEN 'failed' THEN '未决定' ELSE s.action END AS action FROM s LEFT JOIN o USING (path) WHERE coalesce(o.result, '') <> 'succeeded')
  SELECT path, action FROM l QUALIFY count(*) OVER (PARTITION BY g) >= 2""")
def post_delete_state(spark, d):
    then, _ = _snapshot(spark, d)
    k = F.substring("path", 4, 20).cast("long") % 4
    outcome = then.filter(F.col("action") == fixed.DELETE).select("path", F.when(k == 0, "succeeded").when(k == 1, "ignored").otherwise("failed").alias("result"))
    return planning.after(then, outcome).select("path", "action")


# ---- display and reports


@query("display_sort_files", "SELECT p_partkey, row_number() OVER (ORDER BY (CASE WHEN p_size % 7 <> 0 THEN 3600.0 + (p_partkey % 1000) * 0.5 END) DESC NULLS LAST, CASE WHEN p_size % 7 <> 0 THEN p_partkey END DESC, p_partkey) AS position FROM part")
def display_sort_files(spark, d):
    return quality.display_order(_films(spark, d), "duration_seconds", "p_partkey", True).select("p_partkey", "position")


@query("display_sort_groups", f"""WITH {RANKED}, g AS (SELECT p_name, sum(size)::BIGINT - arg_max(size, (pixels, container, size)) AS s FROM r GROUP BY p_name) SELECT p_name AS "group", row_number() OVER (ORDER BY s DESC, p_name DESC) AS position FROM g""")
def display_sort_groups(spark, d):
    return quality.display_order(quality.savings(_films(spark, d)), "estimated_savings", "group", True).select("group", "position")


@query("groups_by_savings", f"""WITH {RANKED}, g AS (SELECT p_name, count(*) AS n, sum(size)::BIGINT AS total, arg_max(size, (pixels, container, size)) AS kept FROM r GROUP BY p_name)
  SELECT p_name AS "group", row_number() OVER (ORDER BY CASE WHEN n >= 2 THEN total - kept ELSE 0 END DESC, n DESC, p_name) AS number FROM g""")
def groups_by_savings(spark, d):
    return quality.numbered(quality.savings(_films(spark, d))).select("group", "number")


_BY = {"name": "lower(name)", "size": "size", "resolution": "nullif(pixels, 0)", "duration": "CASE WHEN p_size % 7 <> 0 THEN 3600.0 + (p_partkey % 1000) * 0.5 END", "format": "ext", "modified": "p_partkey", "folder": "lower(folder)", "action": "p_partkey % 4", "codec": "CASE WHEN p_size % 2 = 0 THEN 'hevc' END"}
_SORTED = f"""{RANKED}, f AS (SELECT *, CASE p_size % 3 WHEN 0 THEN '.mkv' WHEN 1 THEN '.mp4' ELSE '.avi' END AS ext, '/films/' || replace(lower(p_brand), '#', '') || '/' || (p_partkey % 10) || '/v' || p_partkey AS folder,
  translate(p_name, ' ', '.') || CASE p_size % 4 WHEN 0 THEN '.1080p' WHEN 1 THEN '.720p.BluRay' WHEN 2 THEN '.x265' ELSE '' END || CASE p_size % 3 WHEN 0 THEN '.mkv' WHEN 1 THEN '.mp4' ELSE '.avi' END AS name FROM r),
  p AS (SELECT *, lower(folder || '/' || name) AS path FROM f)"""


@query("display_sort_columns", f"WITH {_SORTED} " + " UNION ALL ".join(f"SELECT '{k}' AS by, p_partkey, row_number() OVER (ORDER BY {v} DESC NULLS LAST, CASE WHEN {v} IS NOT NULL THEN path END DESC, path) AS position FROM p" for k, v in _BY.items()))
def display_sort_columns(spark, d):
    k = F.col("p_partkey") % 4
    action = F.when(k == 0, fixed.UNDECIDED).when(k == 1, fixed.KEEP).when(k == 2, fixed.DELETE).otherwise(fixed.IGNORE)
    none = F.lit(None).cast("int")
    files = _films(spark, d).withColumns({"width": none, "height": none, "action": action, "codec": F.when(F.col("p_size") % 2 == 0, "HEVC")})
    out = None
    for by in _BY:
        one = quality.sorted_files(files, by, True).select(F.lit(by).alias("by"), "p_partkey", F.col("position"))
        out = one if out is None else out.unionByName(one)
    return out


@query("exact_set_counts", """WITH s AS (SELECT p_name, CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS m, count(*) AS n FROM part GROUP BY ALL) SELECT p_name AS "group", count_if(n >= 2)::BIGINT AS exact_sets FROM s GROUP BY p_name""")
def exact_set_counts(spark, d):
    return quality.exact_sets(_films(spark, d))


@query("display_name_override", f"""WITH {TITLES}, t AS (SELECT p_name, p_partkey, array_to_string(tokens, ' ') AS shown, CASE p_partkey % 5 WHEN 0 THEN 'said ' || p_partkey WHEN 1 THEN '  ' END AS said FROM titles)
  SELECT p_name AS "group", coalesce(arg_min(trim(said), p_partkey) FILTER (WHERE trim(said) <> ''), arg_min(shown, (length(shown), p_partkey))) AS display_name FROM t GROUP BY p_name""")
def display_name_override(spark, d):
    rows = tables.part_titles(spark, d).join(tables.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").withColumn("stem", N.stem(F.col("name")))
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, F.concat(F.lit(" said "), k.cast("string"))).when(k % 5 == 1, "  ")
    return quality.display_names(N.with_name_info(rows, "stem").select(F.col("p_name").alias("group"), k.alias("pos"), "name_info", said.alias("display_name_override")))


@query("match_labels", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'MD5' WHEN 1 THEN '混合' ELSE '作品身份' END AS label FROM lineitem")
def match_labels(spark, d):
    n = F.col("l_linenumber") % 4
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.match_label(F.when(n == 0, "hash").when(n == 1, "mixed").when(n == 2, "name")).alias("label"))


@query("filter_summary_text", f"""WITH {JUDGED}, c AS (SELECT folder, count_if(reason = 'too_small') AS s, count_if(reason = 'too_large') AS l, count_if(reason = 'extension') AS e, count_if(reason = 'hidden_system') AS h, count_if(reason = 'incomplete') AS i, count_if(reason = 'keyword') AS k FROM judged GROUP BY folder)
  SELECT folder, coalesce(nullif(concat_ws('、', CASE WHEN s > 0 THEN '小文件 ' || s::BIGINT END, CASE WHEN l > 0 THEN '超大文件 ' || l::BIGINT END, CASE WHEN e > 0 THEN '非目标类型 ' || e::BIGINT END, CASE WHEN h > 0 THEN '隐藏/系统文件 ' || h::BIGINT END,
    CASE WHEN i > 0 THEN '临时/未完成文件 ' || i::BIGINT END, CASE WHEN k > 0 THEN '关键字排除 ' || k::BIGINT END), ''), '未筛除文件') AS summary FROM c""")
def filter_summary_text(spark, d):
    judged = filters.waterfall(tables.messy_files(spark, d), OPTIONS)
    counts = judged.groupBy("folder").agg(*(F.count_if(F.col("reason") == r).alias(f"skipped_{r}") for r in filters.REASONS))
    return filters.summary(counts).select("folder", "summary")


@query("pasted_paths", """SELECT p_partkey, '/films/' || p_name || '|' || '/v/' || p_partkey AS paths FROM part""")
def pasted_paths(spark, d):
    text = F.concat(F.lit('  "/films/'), F.col("p_name"), F.lit("\"\r\n\n  \n'/v/"), F.col("p_partkey").cast("string"), F.lit("' "))
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(settings.pasted_paths(text), "|").alias("paths"))


@query("first_group_of_file", 'SELECT p_partkey AS idx, least(p_partkey % 7, p_size) AS "group" FROM part')
def first_group_of_file(spark, d):
    p = tables.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 7).alias("group")).unionByName(p.select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("group")))
    return merge.unique_members(rows, "group").select("idx", "group")


@query("format_bytes_duration", """SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b::BIGINT || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576) ELSE printf('%.2f GB', b / 1073741824) END AS size_text,
  CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration_text
  FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_quantity * 1000)::DOUBLE AS b, round_even(l_extendedprice / 10, 0)::BIGINT AS s FROM lineitem)""")
def format_bytes_duration(spark, d):
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 1000)
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.format_bytes(size).alias("size_text"), labels.format_duration(F.col("l_extendedprice") / 10).alias("duration_text"))


def _report(spark, d):
    films = N.with_name_info(_films(spark, d).withColumn("stem", N.stem(F.col("name"))), "stem")
    members = films.withColumns({
        "pos": F.col("p_partkey"), "action": F.lit(fixed.UNDECIDED), "hash_source": F.lit(fixed.HASH_FULL), "same_md5": F.lit(1), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "codec": F.lit(None).cast("string"),
        "time_precision": F.when(F.col("p_partkey") % 2 == 0, "exact").otherwise("seconds"),
    }).drop("match_kind")
    groups = films.groupBy("group").agg(F.min("p_partkey").alias("number"), F.first("match_kind").alias("match_kind"))
    groups = groups.withColumns({"display_name": F.col("group"), "reason": F.lit(fixed.REASONS["title_equal"]), "metadata_note": F.lit(""), "safety_warning": F.lit(False), "confidence": F.lit(0.985)})
    return report.rows(members, groups)


REPORTED = f"""{TITLES}, t AS (SELECT *, array_to_string(tokens, ' ') AS shown, {_CONTAINER} AS c, min(p_partkey) OVER (PARTITION BY p_name) AS number,
  '/films/' || replace(lower(p_brand), '#', '') || '/' || (p_partkey % 10) || '/v' || p_partkey AS folder, translate(p_name, ' ', '.') || {_TAG} || CASE p_size % 3 WHEN 0 THEN '.mkv' WHEN 1 THEN '.mp4' ELSE '.avi' END AS name FROM titles)"""


#: The report's columns, in their order, as the query below calls them.
_REPORT = (
    "group_number title basis reason note review confidence action name work identity source source_text work_key catalog_key segment series_key episode_date episode_id path folder size md5 md5_state relation resolution duration codec format modified "
    "snapshot version"
).split()
_RESOLUTION = "CASE p_size % 4 WHEN 0 THEN '约 1080P（文件名）' WHEN 1 THEN '约 720P（文件名）' ELSE '未知' END"
_LASTING = "CASE WHEN p_size % 7 <> 0 THEN (3600.0 + (p_partkey % 1000) * 0.5)::DOUBLE END"
_STEM = f"translate(p_name, ' ', '.') || {_TAG}"
_MD5 = "md5(CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE folder || '/' || name END)"


@query("report_rows", f"""WITH {REPORTED} SELECT number::VARCHAR AS group_number, p_name AS title, CASE WHEN length(p_name) % 3 = 0 THEN '完整 MD5' ELSE '影视标题' END AS basis, '清理画质/格式标签后标题相同' AS reason, '' AS note, '否' AS review, '98.5%' AS confidence,
  '未决定' AS action, name, shown AS work, '影视标题' AS identity, '文件名' AS source, {_STEM} AS source_text, array_to_string(tokens, '') AS work_key, '' AS catalog_key, '' AS segment, '' AS series_key, '' AS episode_date, '' AS episode_id,
  folder || '/' || name AS path, folder, floor(p_retailprice * 1000)::BIGINT::VARCHAR AS size, {_MD5} AS md5, '完整 MD5' AS md5_state, 'MD5已验证（组内不同）' AS relation, {_RESOLUTION} AS resolution, coalesce({_LASTING}::VARCHAR, '') AS duration,
  '' AS codec, CASE p_size % 3 WHEN 0 THEN 'MKV' WHEN 1 THEN 'MP4' ELSE 'AVI' END AS format, strftime(to_timestamp(p_partkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS modified, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.0' ELSE '' END AS snapshot, '0.1.0' AS version FROM t""")
def report_rows(spark, d):
    r = _report(spark, d)
    return r.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(fixed.REPORT_COLUMNS, _REPORT, strict=True)))


@query("report_roundtrip_parse", f"""WITH {REPORTED} SELECT folder || '/' || name AS path, floor(p_retailprice * 1000)::BIGINT AS size, p_partkey::DOUBLE AS mtime, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'seconds' END AS time_precision,
  0.985::DOUBLE AS confidence, CASE WHEN length(p_name) % 3 = 0 THEN 'hash' ELSE 'name' END AS match_kind FROM t""")
def report_roundtrip_parse(spark, d):
    p = report.parsed(_report(spark, d).withColumn("row_no", F.monotonically_increasing_id() + 2))
    return p.filter("problem is null").select("path", "size", "mtime", "time_precision", F.round("confidence", 6).alias("confidence"), "match_kind")


@query("media_metadata_shared", f"""WITH {DOCS}, p AS (SELECT *, min(path) OVER (PARTITION BY h) AS probed, doc_id % 9 <> 0 AS ok FROM docs), q AS (SELECT p.path, p.probed, b.ok, b.doc_id AS k FROM p JOIN p b ON p.probed = b.path)
  SELECT path, CASE WHEN NOT ok THEN '{media.FAILED}' WHEN path = probed THEN '{media.PROBED}' ELSE '{media.SHARED}' END AS metadata_source, CASE WHEN ok THEN k % 1000 + 1 ELSE 0 END AS width, CASE WHEN ok THEN (k + 0.5)::DOUBLE END AS duration_seconds FROM q""")
def media_metadata_shared(spark, d):
    files = tables.doc_files(spark, d).select("doc_id", "path", F.md5("content").alias("content_md5"))
    k = F.col("doc_id").cast("string")
    payload = F.concat(F.lit('{"streams": [{"width": '), (F.col("doc_id") % 1000 + 1).cast("string"), F.lit(', "height": 9, "codec_name": "x"}], "format": {"duration": "'), k, F.lit('.5"}}'))
    table = files.select("path", F.when(F.col("doc_id") % 9 != 0, payload).alias("payload"))
    return media.with_metadata(files, table=table).select("path", "metadata_source", F.coalesce("width", F.lit(0)).alias("width"), "duration_seconds")


@query("drive_roots", "SELECT p_partkey, array_to_string(list_transform(list_filter(range(26), lambda i: (p_partkey >> i) & 1 = 1), lambda i: chr((65 + i)::INT) || ':' || chr(92)), ' ') AS drives FROM part")
def drive_roots(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(settings.drive_roots(F.col("p_partkey")), " ").alias("drives"))


@query("duration_span", f"""WITH {ASSESSED} SELECT p_name AS "group", CASE WHEN count(d) >= 2 THEN max(d) - min(d) END AS duration_span FROM x GROUP BY p_name""")
def duration_span(spark, d):
    return quality.savings(_films(spark, d)).select("group", "duration_span")


@query("part_labels", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '第 ' || l_linenumber || ' 段' WHEN 1 THEN 'A 段' WHEN 2 THEN '光盘段 VTS01-02' ELSE '未标分段' END AS label FROM lineitem")
def part_labels(spark, d):
    n = F.col("l_linenumber")
    marker = F.when(n % 4 == 0, F.concat(F.lit("part"), n.cast("string"))).when(n % 4 == 1, "segment:A").when(n % 4 == 2, "disc:vts01-02")
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.part_label(marker).alias("label"))


@query("file_information", f"""WITH {REPORTED}, v AS (SELECT *, floor(p_retailprice * 1000)::BIGINT AS size, {_LASTING} AS sec, {_STEM} AS stem, folder || '/' || name AS path FROM t), x AS (SELECT *, round_even(sec, 0)::BIGINT AS r FROM v)
  SELECT path, array_to_string(['【文件】', '文件名：' || name, '完整路径：' || path, '所在目录：' || folder, '扩展名：' || upper(substr(right(name, 4), 2)),
    '文件大小：' || CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) ELSE printf('%.2f MB', size / 1048576) END || '（' || format('{{:,}}', size) || ' 字节）', '当前状态：未知',
    '扫描时修改时间：' || strftime(to_timestamp(p_partkey) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '', '【媒体信息】', '分辨率：' || {_RESOLUTION},
    '视频时长：' || CASE WHEN sec IS NULL THEN '未知' ELSE lpad((r // 3600)::VARCHAR, 2, '0') || ':' || lpad((r % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((r % 60)::VARCHAR, 2, '0') || '（' || printf('%.2f', sec) || ' 秒）' END,
    '视频编码：h264', '', '【哈希信息】', '完整 MD5：' || {_MD5}, 'MD5 状态：完整 MD5', '组内内容关系：MD5已验证（组内不同）', '', '【名称解析】', '身份类型：影视标题', '身份来源：文件名（' || stem || '）', '识别作品：' || shown,
    '作品身份键：' || array_to_string(tokens, ''), '作品编号：未识别', '归一化标题：' || array_to_string(tokens, ''), '匹配别名：' || array_to_string(tokens, ''), '分段标记：未标分段', '系列名称键：无', '单集日期：无', '季集编号：无', '识别年份：无', '',
    '【候选组】', '候选作品：' || p_name, '置信度：96.0%', '匹配原因：', '辅助提示：无', '重点复核：否', '当前决定：未决定'], chr(10)) AS information FROM x""")
def file_information(spark, d):
    films = N.with_name_info(_films(spark, d).withColumn("stem", N.stem(F.col("name"))), "stem")
    members = films.withColumns({"action": F.lit(fixed.UNDECIDED), "hash_source": F.lit(fixed.HASH_FULL), "same_md5": F.lit(1), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "codec": F.lit("h264"), "state": F.lit("")}).drop("match_kind")
    groups = films.select("group").distinct().withColumns({"display_name": F.col("group"), "confidence": F.lit(0.96), "reason": F.lit(""), "metadata_note": F.lit(""), "safety_warning": F.lit(False)})
    return report.information(members, groups)


@query("find_duplicates_summary")
def find_duplicates_summary(spark, d):
    return find_duplicates(tables.doc_files(spark, d)).summary


@query("content_duplicates_summary", f"""WITH {DOCS}, g AS (SELECT size, h, count(*) AS n FROM docs GROUP BY size, h HAVING count(*) >= 2)
  SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS candidates, coalesce(sum((n - 1) * size), 0)::BIGINT AS savings, count(*) AS with_equal_content FROM g""")
def content_duplicates_summary(spark, d):
    return find_duplicates(tables.doc_files(spark, d), by_name=False).summary
