import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dupforge.llm import simhash as S


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, radius=3):
    p = list(range(len(nodes)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a] ^ nodes[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                p[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(nodes))]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 150), st.integers(0, 12))
def test_forest(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = base[rng.integers(0, 3, n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    label = S.forest(fps, rows=32)
    assert label.tolist() == components([int(x) for x in fps])


@pytest.mark.parametrize(("block", "largest"), [(1024, 16384), (16, 24)])
def test_groups(spark, docs, odd, block, largest):
    """The small sizes deal large buckets into tiles."""
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    near = [(10_000 + k, "base text that is long enough to be near " * 3 + f"word{k % 40}" * (k % 3)) for k in range(120)]
    rows = rows.unionByName(spark.createDataFrame(near, "doc_id long, text string")).collect()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [fingerprint(r["text"]) for r in rows]
    root = components(fps)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    got = S.near_groups(df, block=block, largest_block=largest).collect()
    want = sorted(((r["doc_id"], f, least.get(c)) for r, f, c in zip(rows, fps, root, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=str) == want


def test_tables_meet_every_pair_in_reach():
    for n in (10, 10**6, 10**9, 10**11):
        masks = S._tables(n, 3)
        rng = np.random.default_rng(n)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not flips & m for m in masks)


def test_rows_that_stay(odd, empty):
    kept = S.drop_near_copies(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and None in ids and ids.count(4) == 1 and 5 not in ids and 1 in ids and not {2, 3} & {*ids}
    assert S.near_groups(empty).count() == 0 and S.drop_near_copies(empty).count() == 0


def test_rows_are_abandoned(monkeypatch):
    planes, xor = [], np.bitwise_xor
    monkeypatch.setattr(S.np, "bitwise_xor", lambda *a, **k: (planes.append(1), xor(*a, **k))[1])
    fps = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64)
    assert (S.forest(fps) == np.arange(256)).all()
    assert len(planes) < 2 * 64 * 3  # two blocks of rows; a plane and two counters at each of 64 bits
