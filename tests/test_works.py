"""Pairs and groups of works against all pairs of files."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from dupforge.operators import blocking, clusters, scopes, scoring, works
from dupforge.scratch import Scratch

from .test_groups import files


def odd_names(seed, n):
    """Titles of few words, with slips, copies, years, parts, numbers, episodes, catalogue codes, CJK and names that say too little."""
    rnd = random.Random(seed)
    words = ["red", "door", "quiet", "river", "rivers", "doors", "tide", "diet", "mountain", "mountian", "of", "a"]
    out = []
    for _ in range(n):
        t = ".".join(rnd.choices(words, k=rnd.randint(1, 3)))
        kind = rnd.randrange(12)
        t = {0: f"{t}.{rnd.choice([1999, 2005])}", 1: f"{t}.part{rnd.randint(1, 2)}", 2: f"{t}.{rnd.randint(1, 3)}", 3: f"Show.15.07.28.{t}", 4: f"The.Show.S01E0{rnd.randint(1, 3)}", 5: f"MIDA-63{rnd.randint(0, 2)}", 6: rnd.choice(["ck", "015", "流浪地球", "流浪地球.2019", "寒战", "寒战1"])}.get(kind, t)
        out.append(f"{t}{rnd.choice(['', '.1080p', '.x265'])}.{rnd.choice(['mkv', 'mp4'])}")
    return out


def candidates(fs, near=blocking.NEIGHBOURS):
    """All pairs of files that share a block, or whose titles are up to near distinct titles apart."""
    blocks = {}
    for r in blocking.block_keys(fs).collect():
        blocks.setdefault(r["key"], set()).add(r["idx"])
    titles = {r["idx"]: r["p"] for r in fs.filter("name_info.primary <> '' and name_info.catalog_key is null").select("idx", F.col("name_info.primary").alias("p")).collect()}
    place = {t: k for k, t in enumerate(sorted({*titles.values()}))}
    met = {p for b in blocks.values() for p in itertools.combinations(sorted(b), 2)}
    return met | {(i, j) for i, j in itertools.combinations(sorted(titles), 2) if abs(place[titles[i]] - place[titles[j]]) <= near}


def scores(spark, fs, pairs):
    rows = scoring.scored(spark.createDataFrame(sorted(pairs), "i long, j long"), fs).collect()
    return {(r["i"], r["j"]): (r["score"], r["reason"]) for r in rows}


def written_out(found):
    """similarity()'s rows as pairs of files."""
    rows = found.collect()
    of = {}
    for r in rows:
        if r["same_work"]:
            of.setdefault(r["i"], {r["i"]}).add(r["j"])
    out = {}
    for r in rows:
        said = r["score"], r["reason"]
        if not r["same_work"]:
            out |= {(i, j): said for i in of.get(r["i"], {r["i"]}) for j in of.get(r["j"], {r["j"]}) if i < j}
    return out | {p: (r["score"], r["reason"]) for r in rows if r["same_work"] for p in itertools.combinations(sorted(of[r["i"]]), 2)}


def test_similarity_has_all_pairs_of_large_blocks(spark):
    fs = files(spark, ["Same Long Film.mkv"] * 310 + ["Same Lnog Film.mkv"] * 3)
    got = written_out(works.similarity(fs))
    assert len(got) == 313 * 312 // 2 and got[0, 309][0] == 1 and got[0, 312] == got[309, 310]


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_is_as_by_all_pairs(spark, seed):
    fs = files(spark, odd_names(seed, 120)).localCheckpoint()
    assert written_out(works.similarity(fs)) == scores(spark, fs, candidates(fs))


@pytest.mark.parametrize("near", [0, 2])
def test_alike_pairs_lose_none(spark, near):
    fs = files(spark, odd_names(3, 150)).localCheckpoint()
    scratch = Scratch(spark, "test")
    found, _ = works.works(fs, scratch)
    meet = lambda alike, tile: {tuple(r) for r in works.pairs(found, Scratch(spark, "test"), alike, near, tile).collect()}
    whole, some = meet(False, 5), meet(True, 3)
    ids = {r["idx"] for r in found.collect()}
    assert whole == {p for p in candidates(fs, near) if ids.issuperset(p)} == meet(False, 512)
    above = lambda p: {x for x, (s, _) in scores(spark, fs, p | {x[::-1] for x in p}).items() if s > 0}
    assert len(some) < len(whole) and above(some) == above(whole)


def test_groups_hold_what_only_large_blocks_share(spark):
    other = ["".join(x) for x in itertools.product("jkqwxyz", repeat=3)]
    names = ["Aaaaaaaa Bbbbbbbb Cccccccc.mkv", *(f"Aaaaaaaa Bbbbbbbb Cccccccc {x}.mkv" for x in other), "Cccccccc Bbbbbbbb Aaaaaaaa.mkv"]
    _, members = clusters.name_groups(files(spark, names))
    assert {tuple(r) for r in members.filter("idx in (0, 344)").collect()} == {(0, 0), (0, 344)}


def groups_by_hand(spark, fs, threshold, scope):
    """group: its members, confidence and reason, by all pairs of files."""
    rows = {r["idx"]: r for r in fs.select("idx", "name", "folder", "root", F.length("name_info.primary").alias("n")).collect()}
    of = scores(spark, fs, set(itertools.permutations(rows, 2)))
    a, b = (lambda i, j: rows[i]["folder"] == rows[j]["folder"]), (lambda i, j: rows[i]["root"] == rows[j]["root"])
    allowed = {"all": lambda i, j: True, "same_folder": a, "different_folder": lambda i, j: not a(i, j), "different_root": lambda i, j: not b(i, j)}[scope]
    root = {i: i for i in rows}
    for i, j in candidates(fs):
        if allowed(i, j) and of[i, j][0] >= threshold and root[i] != root[j]:
            gone, to = root[i], root[j]
            root = {k: to if r == gone else r for k, r in root.items()}
    out = {}
    for r in {*root.values()}:
        left = {k for k in rows if root[k] == r}
        while left:
            anchor = min(left, key=lambda k: (rows[k]["n"], rows[k]["name"].lower(), k))
            taken = sorted(k for k in left if k != anchor and allowed(anchor, k) and of[anchor, k][0] >= threshold)
            left -= {anchor, *taken}
            if taken:
                out[anchor] = [anchor, *taken], min(of[anchor, k][0] for k in taken), min((of[anchor, k][1] for k in taken), key=len)
    return out


@pytest.mark.parametrize("scope", scopes.SCOPES)
def test_groups_are_as_by_all_pairs(spark, scope):
    names, rnd = odd_names(5, 90), random.Random(6)
    places = [rnd.choice(["/a/x", "/a/y", "/b/x", "/b/y"]) for _ in names]
    fs = files(spark, names, places, [p[:2] for p in places]).localCheckpoint()
    groups, members = clusters.name_groups(fs, 0.8, scope)
    of = {}
    for r in members.collect():
        of.setdefault(r["group"], set()).add(r["idx"])
    got = {r["group"]: (of[r["group"]], r["confidence"], r["reason"]) for r in groups.collect()}
    want = {g: ({*m}, c, r) for g, (m, c, r) in groups_by_hand(spark, fs, 0.8, scope).items()}
    assert len(want) > 3 and got == want and {*of} == {*got}


def written(spark, monkeypatch, run):
    """The most rows in a table that run writes on its way or returns."""
    counts, save = [0], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    return max(run().count(), *counts)


def test_groups_of_copies_take_no_pairs_of_files(spark, monkeypatch):
    fs = files(spark, ["Same Long Film.mkv"] * 400 + ["Same Long Fiml.mkv"] * 400).localCheckpoint()
    assert written(spark, monkeypatch, lambda: clusters.name_groups(fs)[1]) == 800


def test_similarity_of_copies_takes_no_pairs_of_files(spark, monkeypatch):
    fs = files(spark, ["Same Long Film.mkv"] * 400 + ["Same Long Fiml.mkv"] * 400).localCheckpoint()
    assert written(spark, monkeypatch, lambda: works.similarity(fs)) == 800
