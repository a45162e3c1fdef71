"""Groups of files that hold one work: components of alike pairs, split around anchors so that chains don't hold them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupforge.functions.labels import group_id
from dupforge.operators.components import components
from dupforge.operators.scopes import ALL, DIFFERENT_ROOT, SAME_FOLDER, checked, pair_allowed
from dupforge.operators.scoring import scored
from dupforge.operators.works import links, scored_with_itself, works
from dupforge.scratch import Scratch, merged

MIN_THRESHOLD, THRESHOLD = 0.60, 0.90


def anchor_split(files: DataFrame, roots: DataFrame, threshold: float, scope: str, scratch: Scratch) -> DataFrame:
    """anchor, idx, score, reason of the members of each cluster; an anchor is a member of its own, with neither score nor reason.

    roots: node, component. In each round every component that is left takes the file with the shortest title (then name, then
    idx) as anchor, and the anchor takes all files that are alike enough to it. All components go through a round together, and a
    round is joins and one aggregate, so a large component needs no large task. There are as many rounds as the most split
    component has clusters.
    """
    facts = files.select("idx", "folder", "root", F.length("name_info.primary").alias("len"), F.lower("name").alias("folded"))
    left = scratch.save(roots.join(merged(facts), F.col("node") == F.col("idx")).select("component", "idx", "len", "folded"), "left0")
    out, k = None, 0
    while not left.isEmpty():
        k += 1
        anchors = scratch.save(left.groupBy("component").agg(F.min(F.struct("len", "folded", "idx"))["idx"].alias("anchor")), f"anchors{k}")
        met = left.join(merged(anchors), "component").filter(F.col("idx") != F.col("anchor")).select("component", "anchor", "idx")
        if checked(scope) != "all":
            places = facts.select("idx", "folder", "root")
            a, b = places.alias("l"), places.alias("r")
            met = met.join(merged(a), F.col("anchor") == F.col("l.idx")).join(merged(b), met["idx"] == F.col("r.idx")).filter(pair_allowed(scope)).select("component", "anchor", met["idx"])
        taken = scored(met, files, "anchor", "idx").filter(F.col("score") >= threshold)
        taken = scratch.save(taken.select("component", "anchor", "idx", "score", "reason"), f"taken{k}")
        alone = taken.select("component").distinct()
        own = anchors.join(merged(alone), "component", "left_semi").select("component", "anchor", F.col("anchor").alias("idx"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))
        both = taken.unionByName(own)
        out = both if out is None else out.unionByName(both)
        gone = taken.select("idx").unionByName(anchors.select(F.col("anchor").alias("idx")))
        left = scratch.save(left.join(merged(gone), "idx", "left_anti"), f"left{k}")
        scratch.drop(f"left{k - 1}")
    if out is None:
        empty = "anchor long, idx long, score double, reason string"
        return files.sparkSession.createDataFrame([], empty)
    return out.select("anchor", "idx", "score", "reason")


def _by_heads(found: DataFrame, members: DataFrame, linked: DataFrame, own: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """anchor, idx, score, reason, as anchor_split() has them, where all files of a work and a part may be compared: such a work goes as a whole, and its head, the file that comes first as an anchor, stands for it."""
    first = F.min(F.struct(F.lower("name").alias("folded"), "idx"))
    heads = scratch.save(members.groupBy("work", "part").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"), first.alias("first")), "heads")
    side = lambda work, *rest: heads.select(F.col("work").alias(work), "part", *rest)
    met = linked.join(merged(side("i", "lo", F.col("first.idx").alias("a"))), "i").join(merged(side("j", "hi", F.col("first.idx").alias("b"))), ["j", "part"])
    roots = components(met.filter("lo < hi").select("a", "b"), "a", "b", scratch)
    infos = found.select(F.col("idx").alias("work"), "name_info")
    rows = heads.join(merged(infos), "work").select(F.col("first.idx").alias("idx"), F.lit("").alias("folder"), F.lit("").alias("root"), F.col("first.folded").alias("name"), "name_info")
    split = scratch.save(anchor_split(scratch.save(rows, "head-files"), roots, threshold, ALL, scratch), "heads-split")
    alone = heads.filter("n >= 2").join(merged(own), "work", "left_semi").select(F.col("first.idx").alias("idx")).join(merged(split.select("idx")), "idx", "left_anti")
    split = split.unionByName(alone.select(F.col("idx").alias("anchor"), "idx"), allowMissingColumns=True)
    placed = heads.select("work", "part", F.col("first.idx").alias("head")).join(merged(split.withColumnRenamed("idx", "head")), "head")
    said = own.select("work", F.col("score").alias("_s"), F.col("reason").alias("_r"))
    placed = scratch.save(placed.join(merged(said), "work", "left"), "placed")
    of = lambda other, same: F.when(F.col("head") != F.col("anchor"), F.col(other)).when(F.col("idx") != F.col("anchor"), F.col(same)).alias(other)
    out = members.join(merged(placed), ["work", "part"]).filter("head <> anchor or idx = anchor or _s is not null")
    return out.select("anchor", "idx", of("score", "_s"), of("reason", "_r"))


def _apart(members: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """i, j: files with the same components as all pairs i < j of linked works (and of works linked with themselves) in different parts.

    Each file is linked to the last file of the other work that lies in another part, and to the first one. A work of two parts or more
    is connected by itself, so one link of each file of the other is enough; of two works of one part each, last and first are linked."""
    ends = scratch.save(members.groupBy("work", "part").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")), "parts")
    outer = ends.groupBy("work").agg(F.min(F.struct("lo", "part")).alias("lo0"), F.max(F.struct("hi", "part")).alias("hi0"))
    inner = ends.join(merged(outer), "work").groupBy("work", "lo0", "hi0").agg(F.min(F.when(F.col("part") != F.col("lo0.part"), F.col("lo"))).alias("lo1"), F.max(F.when(F.col("part") != F.col("hi0.part"), F.col("hi"))).alias("hi1"))
    inner = scratch.save(inner, "ends")
    on = lambda mine, other: linked.join(merged(members.select(F.col("work").alias(mine), "idx", "part")), mine).join(merged(inner.withColumnRenamed("work", other)), other)
    last = F.when(F.col("part") != F.col("hi0.part"), F.col("hi0.hi")).otherwise(F.col("hi1"))
    first = F.when(F.col("part") != F.col("lo0.part"), F.col("lo0.lo")).otherwise(F.col("lo1"))
    return on("i", "j").select(F.col("idx").alias("i"), last.alias("j")).unionByName(on("j", "i").select(first.alias("i"), F.col("idx").alias("j"))).filter("i < j")


def name_groups(files: DataFrame, threshold: float = THRESHOLD, scope: str = "all") -> tuple[DataFrame, DataFrame]:
    """groups (group, confidence, reason, match_kind) and members (group, idx). group: the anchor's idx.

    Candidates are all works that share a block or are neighbours, whatever the size of the block; of those, the pairs that can't have
    a score above 0 aren't met."""
    if not MIN_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold has to lie between {MIN_THRESHOLD} and 1")
    scratch = Scratch(files.sparkSession, "name-groups")
    files = scratch.save(files.select("idx", "folder", "root", "name", "name_info"), "files")
    found, members = works(files, scratch)
    linked = scratch.save(links(found, scratch, threshold), "alike")
    own = scratch.save(scored_with_itself(found).filter(F.col("score") >= threshold), "own")
    members = members.withColumn("part", {ALL: F.lit(""), DIFFERENT_ROOT: F.col("root")}.get(checked(scope), F.col("folder"))).filter("part is not null")
    if scope in (ALL, SAME_FOLDER):
        split = _by_heads(found, members, linked, own, threshold, scratch)
    else:
        edges = _apart(members, linked.unionByName(own.select(F.col("work").alias("i"), F.col("work").alias("j"))), scratch)
        split = anchor_split(files, components(edges, "i", "j", scratch), threshold, scope, scratch)
    split = scratch.save(split, "clusters")
    # the shortest reason, of equally short ones the first member's
    groups = split.groupBy(F.col("anchor").alias("group")).agg(F.min("score").alias("confidence"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct(F.length("reason").alias("n"), F.col("idx")))).alias("reason"), F.count("*").alias("n_files"))
    return groups.filter("n_files >= 2").withColumn("match_kind", F.lit("name")), split.select(F.col("anchor").alias("group"), "idx")


def with_group_ids(members: DataFrame, files: DataFrame) -> DataFrame:
    """group, group_id: a digest of all paths of a group, which it has to bring together; joins use group instead."""
    return members.join(files.select("idx", "path"), "idx").groupBy("group").agg(group_id(F.collect_list("path")).alias("group_id"))
