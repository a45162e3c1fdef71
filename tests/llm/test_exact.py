import hashlib

import pytest

from dupforge.llm import exact_dedup as E


def folded(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(folded(r["text"]), []).append(r["doc_id"])
    out = []
    for r in rows:
        g = groups[folded(r["text"])]
        keep = max((x for x in g if x is not None), default=None)
        out.append((r["doc_id"], keep, len(g), hashlib.sha256(folded(r["text"]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [4096, 8])
@pytest.mark.parametrize("digest_bits", [128, 3])
def test_as_by_hand(spark, docs, odd, block_bytes, digest_bits):
    """Digests of three bits clash all the time: then the bytes decide."""
    for rows in (odd, docs) if (block_bytes, digest_bits) == (4096, 128) else (odd.filter("doc_id is null or doc_id < 10"),):
        got = E.exact_groups(rows, block_bytes, digest_bits).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == by_hand(rows.collect())
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len({folded(r["text"]) for r in rows.collect()}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_texts_that_differ_in_one_block(spark):
    base = "x" * 8
    rows = [(k, t) for k, t in enumerate([base * 5, base * 5 + "y", base * 4 + "xxxxxxxy", "y" + (base * 5)[1:], base * 5, base * 3, base * 6])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in E.exact_groups(df, 8).collect()}
    assert got == {0: (4, 2), 1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 2), 5: (5, 1), 6: (6, 1)}


def test_rows_that_stay(odd, empty):
    kept = E.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "2", "3", "5", "6", "7", "8", "9", "10"])
    assert E.exact_groups(empty).count() == 0 and E.drop_exact_copies(empty).count() == 0
