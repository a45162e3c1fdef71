"""Connected components by alternating large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupforge.scratch import Scratch, merged

MAX_ROUNDS = 60


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """edges: a > b. Large: each node's larger neighbours are linked to the least node it knows; small: its smaller neighbours and itself are.

    The least neighbours are written before the join, so that adaptive execution can split a hub's edges."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.save(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
    met = sides.join(merged(least), "u")
    if large:
        return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """node, component (the least node reachable) for each node that has an edge to another node. Nodes are longs or strings, whatever compares; null ends and loops are no edges."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("a"), low.alias("b")).distinct()
    now = scratch.save(now, "edges0")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = state(now)
    for k in range(1, MAX_ROUNDS + 1):
        if not was[0]:
            break
        mid = scratch.save(_star(now, scratch, f"large{k}", True).filter("a <> b").distinct(), f"mid{k}")
        new = scratch.save(_star(mid, scratch, f"small{k}", False).filter("a <> b").distinct(), f"edges{k}")
        for gone in (f"edges{k - 1}", f"mid{k}", f"large{k}-least", f"small{k}-least"):
            scratch.drop(gone)
        now, old, was = new, was, state(new)
        if was == old:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
