import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dupforge.llm import cutting_stock, packing, token_blocks, token_counts
from dupforge.llm.byte_tokens import ByteBPE
from dupforge.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(tokenizer_file(token_blocks.TOKENIZER))


@pytest.fixture(scope="module")
def bytes_():
    return Tokenizer.from_file(tokenizer_file(packing.TOKENIZER))


def ids_of(t, text):
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_round_trip(words, docs, odd, empty):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in rows.collect():
        ids = ids_of(words, r["text"])
        decoded = words.decode(ids.tolist(), skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in token_blocks.encode_decode_digests(rows, block_bytes=1 << 17).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    real = token_blocks.encode_decode(odd.filter("doc_id = 9")).first()
    text = odd.filter("doc_id = 9").first()["text"]
    assert real["ids"] == ids_of(words, text).tolist() and real["decoded"] == words.decode(real["ids"], skip_special_tokens=False)
    assert token_blocks.encode_decode_digests(empty).count() == 0


def test_every_code_point(words):
    """Of the characters that a text may have, each in several places of words."""
    bpe = token_blocks.model(token_blocks.TOKENIZER)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = lambda c: f"abX{chr(c)}cd {chr(c)} {chr(c)}1{chr(c)}{chr(c)}x's\n"
    few = [text(c) for c in points if c < 0x3000]  # one by one: where texts are split in one way or another
    many = ["".join(map(text, points[k : k + 500])) for k in range(0, len(points), 500)]
    for t in few + many:
        own = bpe.words(t)
        got = bpe.encode(t) if own is None else np.concatenate([*bpe.encode_words(own), np.array([], "<u4")])
        assert got.tolist() == ids_of(words, t).tolist(), t[:12]


def test_fast_encoder_agrees(bytes_, docs, odd):
    bpe = ByteBPE()
    assert bpe.fast
    for r in docs.select("text").union(odd.select("text")).collect():
        assert bpe.encode(r["text"] or "").tolist() == ids_of(bytes_, r["text"]).tolist()
    for text in ("  a\n\n b\t\tc  ", "don't WE'LL ¿qué? “x” – 10²", "\x1c\x1d x", " " * 5000, "naïve café", "a b"):
        assert bpe.encode(text).tolist() == ids_of(bytes_, text).tolist()


def test_packing(bytes_, docs, odd, empty):
    rows = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    pieces = packing.pack(rows).collect()
    by_doc, by_sequence, texts = {}, {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for r in rows.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    padding = 0
    for doc_id, same in texts.items():
        assert len({*same}) == 1  # rows that repeat: each position is there as often
        ids = np.append(ids_of(bytes_, same[0]), 0).astype("<u4")
        placed = np.zeros(len(ids), int)
        for p in by_doc.pop(doc_id):
            at, n = p["start"], p["length"]
            assert n > 0 and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + n].tobytes())
            placed[at : at + n] += 1
        assert (placed == len(same)).all()
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * sum(p["length"] for p in pieces) + 1024
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("histogram", [{700: 1000}, {512: 10, 3: 7, 1: 5}, {1023: 5, 1: 2}, {333: 50_000} | {k: 20 + k % 7 for k in range(1, 1024)}, {}, {k: 1 for k in range(500, 1000)}])
def test_plans_place_each_document_once(histogram):
    how = cutting_stock.plan(histogram, 1024)
    filled = {}
    for size, n in histogram.items():
        assert how.used[size] <= n
        if how.used[size]:
            first, copies, sequence, offset = how.slots[size]
            ends = [*first[1:].tolist(), how.used[size]]
            for a, e, k, s, o in zip(first.tolist(), ends, copies.tolist(), sequence.tolist(), offset.tolist(), strict=True):
                assert (e - a) % k == 0
                for t in (0, e - a - 1):  # the ends of a range stand for it
                    filled.setdefault(s + t // k, []).append((o + t % k * size, size))
    assert how.stream == sum(size * (n - how.used[size]) for size, n in histogram.items())
    assert all(0 <= s < how.sequences and all(o + n <= 1024 for o, n in v) for s, v in filled.items())


def all_patterns(lengths, capacity):
    def more(j, room):
        if j == len(lengths):
            yield {}
            return
        for k in range(room // int(lengths[j]) + 1):
            for rest in more(j + 1, room - k * int(lengths[j])):
                yield ({j: k} if k else {}) | rest

    return [p for p in more(0, capacity) if p]


@pytest.mark.parametrize("lengths, capacity, seed", [([2, 3, 5, 7, 11], 16, 0), ([3, 4, 6, 9, 10, 13], 20, 1), ([1, 2, 3, 4, 5, 6, 7], 8, 2), ([5, 6, 7, 9], 24, 3), ([9], 16, 4)])
def test_no_program_is_cheaper(lengths, capacity, seed):
    """The duals are a proof: no pattern, of all there are, and no cut is worth more than it costs, and what is paid is what the duals come to."""
    lengths = np.array(lengths)
    demand = np.random.default_rng(seed).integers(1, 60, len(lengths)).astype(float)
    found = cutting_stock.solve(lengths, demand, capacity)
    fill = lambda p: sum(int(lengths[j]) * k for j, k in p.items())
    for p in all_patterns(lengths, capacity):
        assert sum(found.duals[j] * k for j, k in p.items()) <= cutting_stock.cost(fill(p), capacity) + 1e-6
    assert (found.duals <= lengths + cutting_stock.CUT + 1e-6).all()
    placed, paid = np.zeros(len(lengths)), 0.0
    for c, (p, times) in enumerate(found.used):
        if p is None:
            continue
        for j, k in p.items():
            placed[j] += k * times
        paid += times * cutting_stock.cost(fill(p), capacity)
    assert (placed <= demand + 1e-6).all()
    paid += (demand - placed) @ (lengths + cutting_stock.CUT)
    assert abs(paid - found.duals @ demand) < 1e-3 and abs(paid - found.price) < 1e-3


def test_columns_are_priced_to_the_end():
    import duckdb

    bpe, histogram = ByteBPE(), {}
    for (text,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.1/documents.parquet')").fetchall():
        n = (len(bpe.encode(text or "")) + 1) % 1024
        histogram[n] = histogram.get(n, 0) + 1
    lengths = np.array(sorted(k for k in histogram if k))
    demand = np.array([histogram[int(k)] for k in lengths], float)
    found = cutting_stock.solve(lengths, demand, 1024)
    best, _ = cutting_stock._knapsack(found.duals, lengths, 1024)
    prices = [cutting_stock.cost(c, 1024) for c in range(1025)]
    assert found.pivots > len(lengths) and found.priced > 0 and (best - prices).max() <= 1e-6
    assert lengths @ demand <= found.price <= 1.0001 * (lengths @ demand)
    how = cutting_stock.plan(histogram, 1024)
    assert how.stream <= 0.001 * (lengths @ demand)


def test_token_counts(bytes_, docs, odd, empty):
    rows = docs.select("text").union(odd.select("text"))
    n = sorted(len(ids_of(bytes_, r["text"])) for r in rows.collect())
    sums = token_counts.with_suffix_sums(token_counts.histogram(rows), 16)
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(got) == sorted({*n})
    for limit, r in got.items():
        assert r["n_docs"] == n.count(limit) and r["docs_from"] == sum(x >= limit for x in n) and r["tokens_from"] == sum(x for x in n if x >= limit)
        assert r["total_tokens"] == sum(n) and r["truncated_tokens"] == sum(min(x, limit) for x in n) and abs(r["quantile"] - sum(x <= limit for x in n) / len(n)) < 1e-9
    for limit in (0, 1, 77, 1000, 10**7):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.length_at(sums, 0.5) == n[-(-len(n) // 2) - 1]
    none = token_counts.with_suffix_sums(token_counts.histogram(empty))
    assert none.count() == 0 and token_counts.truncated_total(none, 5) == 0 and token_counts.length_at(none, 0.5) is None
