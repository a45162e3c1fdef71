"""From a file's name to the identity of the work it holds, as Column expressions.

Names are short, so the expressions may look at them many times. Only two things need Python: Unicode's NFKC and case folding, and
those only for names that aren't ASCII. Patterns are Java's; each first match is taken with a lazy prefix, so that what lies before
and behind it comes with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupforge.functions import fixed
from dupforge.functions.fixed import BRAND, CHINESE_PART, CJK, COMPACT, COMPACT_DATE, COMPOUND, DISC_STEM, DOMAIN, DVD_STEM, EPISODES, FC2, FULL_DATE, KEPT, LONG_SERIES, NOISE, NUMERIC_STEM, PART, PROMOTION, SEASON_EPISODE, SEGMENT_FOLDER, SEPARATED, STREAMING, TOKYO, X_EPISODE, YEAR

FROM_NAME, FROM_FOLDER, FROM_NOWHERE = "文件名", "上级影片目录", "上级目录不足"


@F.pandas_udf(T.StringType())
def _fold_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: the optimizer would put a copy of it wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """NFKC, stripped, case-folded. ASCII stays with the JVM."""
    ascii_ = is_ascii(text)
    return F.when(ascii_, F.btrim(F.lower(text), F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))).otherwise(_fold_unicode(F.when(~ascii_, text)))


@lru_cache(maxsize=1)
def simplified(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and the simplified ones that stand for them, by ICU's rules, which come with Spark."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    was = "".join(map(chr, range(0x4E00, 0xA000)))
    now = icu.transliterate(was)
    pairs = list(({a: b for a, b in zip(was, now, strict=True) if a != b} | fixed.SIMPLIFIED_TOO).items())
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def to_simplified(text: Column, pairs: tuple[str, str]) -> Column:
    return F.when(is_ascii(text), text).otherwise(F.translate(text, *pairs))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def first(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; 0 is what lies before it, and one beyond the last group what lies behind. Without a match empty."""
    return F.regexp_extract(text, rf"(?s)^(.*?)(?:{pattern})(.*)$", group + 1)


def found(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?s){pattern}")


def number(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=.)", "")


def among(word: Column, words: tuple[str, ...]) -> Column:
    """isin() for words without blanks, by one literal: each place that uses a list would have a node of the plan for each of its words."""
    return F.contains(F.lit(f" {' '.join(words)} "), F.concat(F.lit(" "), word, F.lit(" ")))


def is_noise(token: Column) -> Column:
    return (token == "") | among(token, (*fixed.NOISE_TOKENS, *fixed.RELEASE_GROUPS)) | token.rlike(f"^(?:{'|'.join(fixed.NOISE_PATTERNS)})$")


def kept(text: Column) -> Column:
    """What lies between KEPT. Other than split(), this doesn't compile its pattern for each text."""
    return F.regexp_extract_all(text, F.lit(f"[0-9a-z{CJK}]+"), F.lit(0))


def unpromoted(text: Column) -> Column:
    """All promotion is Chinese, so ASCII has none."""
    inside = lambda t: F.regexp_replace(F.regexp_replace(t, f"^(?:{PROMOTION}[-_. ·]*)+", ""), f"(?:[-_. ·]*{PROMOTION})+$", "")
    return let(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), lambda t: F.when(is_ascii(t), t).otherwise(inside(t)))


def unbracketed(text: Column) -> Column:
    return F.translate(text, fixed.BRACKETS, " " * len(fixed.BRACKETS))


def meaningful(fragment: Column) -> Column:
    """Words that say something: no brands, brackets, promotion or noise."""
    value = let(fragment, lambda x: unpromoted(unbracketed(F.when(is_ascii(x), x).otherwise(F.regexp_replace(x, BRAND, " ")))))
    return F.filter(kept(value), lambda t: ~is_noise(t))


def without_domains(text: Column) -> Column:
    return let(text, lambda t: F.translate(F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, DOMAIN, " ")).otherwise(t), "@", " "))


def without_phrases(text: Column) -> Column:
    """Brands and compounds are Chinese, so ASCII has neither."""
    chinese = lambda t: F.regexp_replace(F.regexp_replace(t, BRAND, " "), COMPOUND, " ")
    return F.regexp_replace(let(text, lambda t: F.when(is_ascii(t), t).otherwise(chinese(t))), fixed.NOISE_PHRASES, " ")


_ROMAN = "(?<![a-z0-9])(x|ix|viii|vii|vi|v|iv|iii|ii|i)(?![a-z0-9])"
#: Behind the numeral only years and noise, or before it a word that asks for a number: the last numeral of either kind.
_BEFORE_NOISE = rf"(?s)^(.*){_ROMAN}((?:[^0-9a-z{CJK}]+(?:{NOISE}|(?:19|20)[0-9]{{2}})(?![0-9a-z{CJK}]))*[^0-9a-z{CJK}]*)$"
_AFTER_WORD = rf"(?s)^(.*(?<![a-z])(?:{'|'.join(fixed.ORDINAL_WORDS)})[^a-z]*?){_ROMAN}(.*)$"


def arabic_suffix(text: Column) -> Column:
    """One Roman numeral made Arabic, where it counts a sequel."""
    return let(text, lambda t: F.when(t.rlike(_ROMAN), _arabic_suffix(t)).otherwise(t))


def _arabic_suffix(text: Column) -> Column:
    far = lambda p: F.when(text.rlike(p), F.length(F.regexp_extract(text, p, 1))).otherwise(-1)
    value = F.create_map(*(F.lit(x) for pair in fixed.ROMAN.items() for x in (pair[0], str(pair[1]))))
    put = lambda p: F.concat(F.regexp_extract(text, p, 1), value[F.regexp_extract(text, p, 2)], F.regexp_extract(text, p, 3))
    a, b = far(_BEFORE_NOISE), far(_AFTER_WORD)
    return F.when((a < 0) & (b < 0), text).when(a >= b, put(_BEFORE_NOISE)).otherwise(put(_AFTER_WORD))


def cleaned(text: Column, pairs: tuple[str, str]) -> Column:
    """Of a folded name: what identities are read from."""
    return arabic_suffix(without_phrases(without_domains(to_simplified(text, pairs))))


_MATCH = "struct<before: string, m: string, after: string>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches, one behind the other, with what lies before and behind each."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(F.split(text, pattern, -1), 1, 1000).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_MATCH}>").alias("found"))

    def move(state: Column, pair: Column) -> Column:
        at = state["at"] + F.length(pair["gap"])
        end = at + F.length(pair["m"])
        one = F.struct(F.substring(text, F.lit(1), at).alias("before"), pair["m"].alias("m"), F.substring(text, end + 1, F.length(text)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    done = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, move, lambda s: s["found"])
    return F.when(found(text, pattern), done).otherwise(F.array().cast(f"array<{_MATCH}>"))


_EPISODE = "struct<kind: string, series: array<string>, date: string, id: string, title: array<string>>"


def _episode(kind: str, series: Column, date: Column, id_: Column, title: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), series.alias("series"), date.cast("string").alias("date"), id_.cast("string").alias("id"), title.alias("title")).cast(_EPISODE)


def _dated(text: Column, pattern: str, date: Callable[[Column], Column]) -> Column:
    made = F.transform(_matches(text, pattern), lambda x: _episode("dated_episode", meaningful(x["before"]), date(x["m"]), F.lit(None), meaningful(x["after"])))
    return F.try_element_at(F.filter(made, lambda e: e["date"].isNotNull() & (F.size(e["series"]) > 0)), F.lit(1))


def _full_date(m: Column) -> Column:
    part = lambda k: F.regexp_extract(m, FULL_DATE, k)
    year = F.when(F.length(part(1)) == 4, part(1)).when(part(1) <= "79", F.concat(F.lit("20"), part(1))).otherwise(F.concat(F.lit("19"), part(1)))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd").cast("string")


def _compact_date(m: Column) -> Column:
    return F.try_to_date(F.regexp_extract(m, COMPACT_DATE, 1), "yyyyMMdd").cast("string")


def _padded(digits: Column, width: int) -> Column:
    n = number(digits)
    return F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))


def _numbered(text: Column, pattern: str, groups: int, id_: Column) -> Column:
    series = meaningful(first(text, pattern, 0))
    return F.when(found(text, pattern) & (F.size(series) > 0), _episode("series_episode", series, F.lit(None), id_, meaningful(first(text, pattern, groups + 1))))


def dated_episode(text: Column) -> Column:
    return F.coalesce(_dated(text, FULL_DATE, _full_date), _dated(text, COMPACT_DATE, _compact_date))


def season_episode(text: Column) -> Column:
    one = lambda p: _numbered(text, p, 2, F.concat(F.lit("s"), _padded(first(text, p, 1), 2), F.lit("e"), _padded(first(text, p, 2), 2)))
    return F.coalesce(one(SEASON_EPISODE), one(X_EPISODE))


def numbered_episode(text: Column) -> Column:
    return F.coalesce(*(_numbered(text, p, 1, F.concat(F.lit("e"), _padded(first(text, p, 1), 3))) for p in EPISODES))


def long_series(text: Column) -> Column:
    digits = first(text, LONG_SERIES, 2)
    id_ = F.concat(F.lit("e"), _padded(digits, 6))
    series = F.array(first(text, LONG_SERIES, 1))
    return F.when(found(text, LONG_SERIES) & ~digits.rlike("^(?:19|20)[0-9]{2}$"), _episode("series_episode", series, F.lit(None), id_, meaningful(first(text, LONG_SERIES, 3))))


def episode(text: Column) -> Column:
    """Every kind of episode has a digit."""
    return F.when(text.rlike("[0-9]"), F.coalesce(dated_episode(text), season_episode(text), numbered_episode(text), long_series(text)))


_CATALOG = "struct<key: string, tail: string>"


def _catalog_matches(text: Column, pattern: str, compact: bool) -> Column:
    group = lambda k: F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(k))
    rows = F.arrays_zip(group(1).alias("prefix"), group(2).alias("sep"), group(3).alias("digits"), group(4).alias("tail"))

    def valid(r: Column) -> Column:
        hyphen = F.contains(r["sep"], F.lit("-"))
        listed = among(r["prefix"], tuple(fixed.NON_CATALOG_PREFIXES))
        short = (F.length(r["digits"]) < 3) & F.lit(not compact) & ~hyphen
        height = r["digits"].isin(*fixed.HEIGHTS) & (r["tail"].rlike("^[pi]") | r["prefix"].isin(*fixed.HEIGHT_PREFIXES))
        year = r["digits"].rlike("^(?:19|20)[0-9]{2}$") & (F.lit(compact) | ~hyphen | (F.length(r["prefix"]) > 3))
        return ~(listed | short | height | year)

    made = lambda one: F.when(one.isNotNull(), F.struct(F.concat_ws("-", one["prefix"], number(one["digits"])).alias("key"), one["tail"].alias("tail")).cast(_CATALOG))
    return let(F.try_element_at(F.filter(rows, valid), F.lit(1)), made)


def catalog(text: Column) -> Column:
    """key and what lies behind it in the text, or null."""
    fixed_key = lambda p, groups, key: F.when(found(text, p), F.struct(key.alias("key"), first(text, p, groups + 1).alias("tail")).cast(_CATALOG))
    return F.coalesce(
        fixed_key(FC2, 1, F.concat(F.lit("fc2-ppv-"), number(first(text, FC2, 1)))),
        fixed_key(STREAMING, 3, F.concat_ws("-", first(text, STREAMING, 1), first(text, STREAMING, 2), number(first(text, STREAMING, 3)))),
        fixed_key(TOKYO, 1, F.concat(F.lit("tokyo-hot-n"), number(first(text, TOKYO, 1)))),
        _catalog_matches(text, SEPARATED, False),
        _catalog_matches(text, COMPACT, True),
    )


def part_marker(text: Column, tail: Column) -> Column:
    """tail: what lies behind a catalog key, or null."""
    words = F.filter(kept(tail), lambda t: ~is_noise(t))
    last = r"(?:_|-)0*([1-9]|1[0-9]|20)\s*$"
    marker = lambda only: (
        F.when(found(text, PART), F.concat(F.lit("part"), first(text, PART, 1)))
        .when(~is_ascii(text) & found(text, CHINESE_PART), F.concat(F.lit("segment:"), F.regexp_replace(first(text, CHINESE_PART, 1), r"\s+", "")))
        .when(only.rlike("^0*[1-9][0-9]?$"), F.concat(F.lit("part"), number(only)))
        .when(only.isin("a", "b"), F.concat(F.lit("segment:"), F.upper(only)))
        .when(tail.rlike(last), F.concat(F.lit("part"), F.regexp_extract(tail, last, 1)))
    )
    return let(let(words, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0)))), marker)


def release_years(text: Column, key: Column) -> Column:
    all_ = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))
    rest = F.regexp_replace(text, rf"(?s)^(.*){YEAR}(.*)$", "$1 $3")
    leading = (F.size(all_) == 1) & text.rlike(rf"^\s*{YEAR}")
    some = key.isNull() & (F.size(all_) > 0) & ~leading & (F.size(F.filter(kept(unpromoted(unbracketed(rest))), lambda t: ~is_noise(t))) > 0)
    return F.when(some, F.array(F.try_element_at(all_, F.lit(-1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def raw_tokens(text: Column) -> Column:
    """Words of a title: no noise and no part markers. Here _ is part of a word."""
    words = F.regexp_extract_all(unpromoted(unbracketed(text)), F.lit(rf"(?U)[\w{CJK}]+"), F.lit(0))
    return F.filter(words, lambda t: ~is_noise(t) & ~F.concat(F.lit(" "), t, F.lit(" ")).rlike(PART))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, KEPT, "")


def aliases(primary: Column, years: Column) -> Column:
    """Of a title: itself, itself without its year, and without a last 1."""
    year = F.get(years, F.lit(0)).cast("string")
    cut = F.regexp_replace(primary, F.concat(F.lit("(?s)^(.*)"), year, F.lit("(.*)$")), F.lit("$1$2"))

    def listed(dated: Column) -> Column:
        base = F.when(F.size(years) > 0, dated).otherwise(primary)
        one = F.when(base.rlike("^.{2,}1$"), F.regexp_extract(base, "^(.{2,})0?1$", 1))
        return F.filter(F.array_distinct(F.array_compact(F.array(primary, dated, one))), lambda a: a != "")

    return let(let(cut, lambda c: F.when((F.size(years) > 0) & (F.length(c) >= 2) & (c != primary), c)), listed)


NAME = (
    "struct<raw: string, cleaned_display: string, catalog_key: string, `primary`: string, aliases: array<string>, part_marker: string, years: array<int>, "
    "tokens: array<string>, identity_kind: string, work_key: string, series_key: string, episode_date: string, episode_id: string, identity_source: string, source_text: string>"
)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is read from fewer files than there are tasks to run at once: names take far more time than bytes, and
    Spark deals by bytes. A table of many files is left as it is, and isn't shuffled."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def with_name_info(df: DataFrame, stem: str, out: str = "name_info") -> DataFrame:
    """df and a struct of identity fields of the name in column stem. A null name is an empty one."""
    df = spread(df)
    pairs = simplified(df.sparkSession)
    raw = F.coalesce(F.col(stem), F.lit(""))
    # by let, not in columns of their own: a filter on the result would be pushed below those, with all that they stand for
    info = let(fold(raw), lambda f: let(cleaned(f, pairs), lambda v: let(episode(v), lambda e: let(F.when(e.isNull(), catalog(v)), lambda c: _info(F.col("_raw"), v, e, c)))))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_in"), raw.alias("_raw"), raw.alias(stem))
    return rows.select(*(F.col(f"_in.`{c}`") for c in df.columns if c != out), info.alias(out))


def _info(raw: Column, v: Column, e: Column, c: Column) -> Column:
    """raw: the name; v: cleaned; e: its episode or null; c: its catalog key or null."""
    key = c["key"]
    series, compact, dated = F.array_join(e["series"], ""), F.translate(F.coalesce(e["date"], e["id"]), "-", ""), e["kind"] == "dated_episode"
    no_years = F.array().cast("array<int>")
    years = F.when(e.isNull() & key.isNull(), release_years(v, key)).otherwise(no_years)

    def made(words: Column) -> Column:
        title = F.array_join(words, " ")
        of_episode = F.when(dated, F.concat(F.lit("date"), series, compact, F.array_join(e["title"], ""))).otherwise(F.concat(F.lit("episode"), series, e["id"]))
        primary = F.when(e.isNotNull(), of_episode).when(key.isNotNull(), F.translate(key, "-", "")).otherwise(bare(title))
        shown = F.concat_ws(" · ", F.array_join(e["series"], " "), F.coalesce(e["date"], F.upper(e["id"])), F.when(dated & (F.size(e["title"]) > 0), F.array_join(e["title"], " ")))
        display = F.when(e.isNotNull(), shown).when(key.isNotNull(), F.upper(key)).otherwise(title)
        tokens = F.when(e.isNotNull(), F.concat(F.array(series, compact), e["title"])).otherwise(F.filter(F.transform(words, bare), lambda x: x != ""))
        kind = F.when(e.isNotNull(), e["kind"]).when(key.isNotNull(), "catalog").otherwise("title")
        return let(primary, lambda p: let(years, lambda y: _struct(p, y, display, tokens, kind)))

    def _struct(p: Column, y: Column, display: Column, tokens: Column, kind: Column) -> Column:
        alias = F.when(e.isNull() & key.isNull(), aliases(p, y)).otherwise(F.filter(F.array(p), lambda a: a != ""))
        return F.struct(
            raw.alias("raw"), F.coalesce(F.nullif(display, F.lit("")), raw).alias("cleaned_display"), key.alias("catalog_key"), p.alias("primary"), alias.alias("aliases"), part_marker(v, c["tail"]).alias("part_marker"),
            y.alias("years"), tokens.alias("tokens"), kind.alias("identity_kind"), p.alias("work_key"), F.when(e.isNotNull(), series).alias("series_key"), e["date"].alias("episode_date"), e["id"].alias("episode_id"),
            F.lit(FROM_NAME).alias("identity_source"), raw.alias("source_text"),
        ).cast(NAME)

    return let(raw_tokens(v), made)


def stem(name: Column) -> Column:
    """As pathlib has it: up to the last dot, unless that is the first character or the last."""
    return F.when(name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(name)


def extension(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("")


def disc_segment(path: Column) -> Column:
    """The segment that a disc's generic file name stands for, or null."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    last = lambda n: F.slice(folders, F.greatest(F.size(folders) - n + 1, F.lit(1)), F.lit(n))
    s = F.lower(F.btrim(stem(F.element_at(parts, -1))))  # only ASCII names are generic
    named = F.filter(F.reverse(F.transform(last(4), lambda f: F.regexp_extract(F.lower(F.btrim(f)), SEGMENT_FOLDER, 1))), lambda n: n != "")
    disc = F.when(F.size(named) > 0, F.concat(F.lit("disc"), named[0], F.lit("-"))).otherwise("")
    kind, n = F.regexp_replace(F.regexp_extract(s, DISC_STEM, 1), r"[\s._-]+", ""), F.regexp_extract(s, DISC_STEM, 2)
    in_disc = F.arrays_overlap(F.transform(last(3), lambda f: F.lower(F.btrim(f))), F.array(*map(F.lit, fixed.DISC_FOLDERS)))
    return (
        F.when(s.rlike(DVD_STEM), F.concat(F.lit("disc:"), disc, F.lit("vts"), F.lpad(F.regexp_extract(s, DVD_STEM, 1), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(s, DVD_STEM, 2), 2, "0")))
        .when(s.rlike(DISC_STEM), F.concat(F.lit("disc:"), disc, kind, F.when(n != "", F.concat(F.lit("-"), number(n))).otherwise("")))
        .when(s.rlike(NUMERIC_STEM) & in_disc, F.concat(F.lit("disc:"), disc, F.lit("stream-"), _padded(F.regexp_extract(s, NUMERIC_STEM, 1), 6)))
    )


def with_path_info(df: DataFrame, path: str = "path", root: str = "root", depth: int = 6) -> DataFrame:
    """df and name_info of the file at path. Names that only number a disc's parts take their work from the nearest folder that
    names one, up to depth folders and not beyond root."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    rows = df.withColumn("_segment", disc_segment(F.col(path)))
    own = with_name_info(rows.withColumn("_stem", stem(name)), "_stem")
    usual = own.filter("_segment is null").drop("_segment", "_stem")
    discs = rows.filter("_segment is not null").withColumn("_id", F.monotonically_increasing_id())
    folders = discs.select("_id", F.split(F.col(path), "/").alias("p"), F.col(root).alias("r")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(depth)))).filter(F.col("k") < F.size("p"))
    above = F.array_join(F.slice("p", F.lit(1), F.size("p") - F.col("k")), "/")
    folders = folders.select("_id", "k", F.element_at(F.col("p"), -(F.col("k") + 1)).alias("folder"), above.alias("at"), "r")
    folders = folders.filter((F.col("folder") != "") & (F.col("r").isNull() | (F.length("at") >= F.length(F.regexp_replace("r", "/+$", "")))))
    plain = F.lower(F.btrim("folder"))
    told = with_name_info(folders.filter(~plain.isin(*fixed.DISC_FOLDERS, *fixed.LIBRARY_FOLDERS) & ~plain.rlike(SEGMENT_FOLDER) & ~F.col("folder").rlike("^[A-Za-z]:$")), "folder")
    good = (F.col("name_info.primary") != "") & ~((F.col("name_info.identity_kind") == "title") & F.col("name_info.primary").rlike("^(?:[a-z]{1,3}|[0-9]{1,3})$"))
    nearest = told.filter(good).groupBy("_id").agg(F.min_by(F.struct("folder", "name_info"), "k").alias("b"))
    met = discs.join(nearest, "_id", "left")
    raw, info = stem(F.element_at(F.split(F.col(path), "/"), -1)), F.col("b.name_info")
    given = [F.coalesce(info[f], other).alias(f) if other is not None else info[f].alias(f) for f, other in {
        "raw": None, "cleaned_display": F.concat(F.lit("未识别光盘作品（"), raw, F.lit("）")), "catalog_key": None, "primary": F.lit(""), "aliases": F.array().cast("array<string>"), "part_marker": None, "years": F.array().cast("array<int>"),
        "tokens": F.array().cast("array<string>"), "identity_kind": F.lit("generic_media"), "work_key": F.lit(""), "series_key": None, "episode_date": None, "episode_id": None, "identity_source": None, "source_text": None,
    }.items()]
    made = F.struct(*given).withField("raw", raw).withField("part_marker", F.col("_segment")).withField("identity_source", F.when(info.isNull(), FROM_NOWHERE).otherwise(FROM_FOLDER))
    made = made.withField("source_text", F.coalesce(F.col("b.folder"), F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(1), F.size(F.split(F.col(path), "/")) - 1), "/"))).cast(NAME)
    return usual.unionByName(met.select(*df.columns, made.alias("name_info")).select(*usual.columns))
