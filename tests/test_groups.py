"""Pairs, groups, merging."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dupforge.functions import names as N
from dupforge.functions.fixed import REASONS
from dupforge.operators import blocking, clusters, merge, scoring

from .conftest import DATA


def files(spark, names, folders=None, roots=None):
    folders = folders or ["/r"] * len(names)
    roots = roots or folders
    rows = [(k, f"{f}/{n}", n, f, r, 1000) for k, (n, f, r) in enumerate(zip(names, folders, roots, strict=True))]
    df = spark.createDataFrame(rows, "idx long, path string, name string, folder string, root string, size long")
    return N.with_name_info(df.withColumn("stem", N.stem(F.col("name"))), "stem")


PAIRS = [
    ("MIDA-630.mp4", "MIDA-631.mp4", 0, "catalog"), ("MIDA-630-CD1.mp4", "MIDA-630-CD2.mp4", 0, "part"), ("流浪地球.2019.mkv", "流浪地球.mkv", 0.96, "title_year"),
    ("The Thing 1982.mkv", "The Thing 2011.mkv", 0, "year"), ("Mission Impossible Fallout.mkv", "Fallout Mission Impossible.mkv", 0.96, "title_order"),
    ("Harry Potter Stone.mkv", "Harry Potter Secrets.mkv", 0, "title_words"), ("015.1080p.mkv", "015.720p.mkv", 0, "insufficient"), ("ck.mp4", "ck.mkv", 0, "insufficient"),
    ("Show.15.07.28.A.Name.mp4", "Show.15.07.29.A.Name.mp4", 0, "date"), ("Show.15.07.28.Long.Name.mp4", "Show.15.07.28.Name.Long.mp4", 0.98, "episode_order"), ("Show.15.07.28.Long.Name.mp4", "Show.15.07.28.mp4", 0.94, "episode_untitled"),
    ("The.Show.E07.mkv", "The.Show.E08.mkv", 0, "number"), ("The.Show.S01E07.mkv", "The.Show.1x07.mkv", 1, "number_equal"), ("MIDA-630.mp4", "Some Title.mkv", 0, "catalog_one"), ("寒战.mp4", "寒战1.mkv", 0.98, "title_alias"),
    ("Movie One 2.mkv", "Movie One 3.mkv", 0, "title_number"), ("Alpha Beta.mkv", "Alpha Beta Gamma.mkv", 0, "title_count"),
]


def test_pairs(spark):
    names = [n for p in PAIRS for n in p[:2]]
    fs = files(spark, names)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(PAIRS))], "i long, j long")
    got = {r["i"]: (r["score"], r["reason"]) for r in scoring.scored(pairs, fs).collect()}
    for k, (a, b, score, reason) in enumerate(PAIRS):
        assert got[2 * k] == (score, REASONS[reason]), (a, b)


def test_spelling_counts_the_order_of_its_arguments():
    assert scoring.ratio("tide", "diet") == 0.25 and scoring.ratio("diet", "tide") == 0.5


def grouped(spark, fs, threshold=0.9, scope="all"):
    groups, members = clusters.name_groups(fs, threshold, scope)
    keep = {r["group"] for r in groups.collect()}
    out = {}
    for r in members.collect():
        if r["group"] in keep:
            out.setdefault(r["group"], []).append(r["idx"])
    return sorted(sorted(v) for v in out.values())


def test_groups(spark):
    names = ["MIDA-630.mp4", "MIDA-630-C.mov", "MIDA-630-4k.mkv", "MIDA-631.mp4", "Shawshank Redemption.mkv", "Shawshank Redemtion.mkv", "ck.mp4", "ck.mkv"]
    assert grouped(spark, files(spark, names), 0.86) == [[0, 1, 2], [4, 5]]
    with pytest.raises(ValueError):
        clusters.name_groups(files(spark, names), 0.5)


def test_scopes(spark):
    names = ["Some Long Film.mkv"] * 3
    fs = files(spark, names, ["/a/x", "/a/x", "/a/y"], ["/a", "/a", "/b"])
    assert grouped(spark, fs, scope="same_folder") == [[0, 1]]
    # members are held against the anchor only
    assert grouped(spark, fs, scope="different_folder") == [[0, 2]]
    assert grouped(spark, files(spark, names[:2]), scope="different_folder") == []
    assert grouped(spark, fs, scope="different_root") == [[0, 2]]


def test_large_blocks_reach_fifty_ahead(spark):
    fs = files(spark, ["Same Long Film.mkv"] * 310)
    pairs = {(r["i"], r["j"]) for r in blocking.candidate_pairs(fs).collect()}
    assert pairs == {(i, j) for i in range(310) for j in range(i + 1, min(310, i + 51))}


def brute_merge(names, hashes):
    island = {i: g for g, m in hashes.items() for i in m}
    out = {f"hash:{g}": set(m) for g, m in hashes.items()}
    for g, m in names.items():
        met = {island[i] for i in m if i in island}
        extra = {i for i in m if i not in island}
        if len(met) == 1:
            out[f"hash:{met.pop()}"] |= extra
        elif len(extra) >= 2:
            out[f"name:{g}"] = extra
    return out


def test_merge_is_as_by_hand(spark):
    rnd = random.Random(4)
    ids = list(range(60))
    rnd.shuffle(ids)
    names = {f"n{k}": ids[k * 5 : k * 5 + 5] for k in range(12)}
    rnd.shuffle(ids)
    hashes = {f"h{k}": ids[k * 3 : k * 3 + 3] for k in range(9)}
    rows = lambda d: spark.createDataFrame([(g, i) for g, m in d.items() for i in m], "group string, idx long")
    members = merge.merged_members(rows(names), rows(hashes))
    got = {}
    for r in members.collect():
        got.setdefault(r["group"], set()).add(r["idx"])
    assert got == brute_merge(names, hashes)
    ng = spark.createDataFrame([(g, 0.9 + k / 1000, f"r{k}") for k, g in enumerate(names)], "group string, confidence double, reason string")
    kinds = {r["group"]: r["match_kind"] for r in merge.merged_groups(members, ng).collect()}
    for g, kind in kinds.items():
        assert kind == ("name" if g.startswith("name:") else "mixed" if len(got[g]) > 3 else "hash")


def broadcasts(spark, monkeypatch, name):
    """First keys of the broadcast joins in all plans of a query: those of tables it writes on the way, and its own."""
    from dupforge.plans.queries import QUERIES
    from dupforge.scratch import Scratch

    plans, save = [], Scratch.save
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (plan(df), save(self, df, name))[1])
    plan(QUERIES[name](spark, DATA))
    return {key for p in plans for key in re.findall(r"BroadcastHashJoin \[\w*\(*(\w+)#", p)} | {"loop" for p in plans if "BroadcastNestedLoopJoin" in p}


#: Counts of sorted partitions: a row a partition.
BOUNDED = {"_p", "p"}


@pytest.mark.parametrize("name", ["sorted_neighbourhood", "candidate_pairs_capped", "pair_veto_scores", "name_components", "bigram_jaccard", "pair_similarity", "anchor_split_groups"])
def test_broadcasts_no_table_that_grows(spark, monkeypatch, name):
    assert broadcasts(spark, monkeypatch, name) <= BOUNDED
