"""The pipeline against one by hand: stages in plain Python."""

import numpy as np

import corpus_pipeline as P
from dupforge.llm import quality as Q
from dupforge.scratch import Scratch

from . import test_exact, test_pii, test_quality, test_simhash


def by_hand(rows):
    left = dict(test_quality.cleaned(rows, test_quality.by_hand(rows, Q.MAX_DOCS, Q.LEFT_PERCENT), Q.MAX_DOCS))
    exact = {}
    for k, t in left.items():
        exact[test_exact.folded(t)] = max(k, exact.get(test_exact.folded(t), k))
    left = {k: t for k, t in left.items() if k in {*exact.values()}}
    ids = sorted(left)
    root = test_simhash.components([test_simhash.fingerprint(left[k]) for k in ids])
    left = {ids[j]: left[ids[j]] for j in sorted({*root})}
    out = {}
    for k, t in left.items():
        text, at = "", 0
        for a, _, e, kind in test_pii.base(t):
            if e > at:
                text += t[at : max(a, at)] + (f"<{kind.upper()}>" if a >= at else "")
                at = e
        out[k] = text + t[at:]
    return out


def test_stages(spark, docs):
    assert [n for n, _ in P.STAGES][2] == "SimHash near dedup" and len(P.STAGES) == 5
    scratch, rows, now = Scratch(spark, "test"), docs.collect(), docs
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        now = scratch.save(stage(spark, now, "/root/testdata/sf0.001"), str(k))
        assert now.columns == docs.columns
    want = by_hand(rows)
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert got == want
    pieces = P.run(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in pieces} == {*want}
    bpe = __import__("dupforge.llm.byte_tokens", fromlist=["x"]).ByteBPE()
    tokens = {k: len(bpe.encode(t)) + 1 for k, t in want.items()}
    assert sum(r["length"] for r in pieces) == sum(tokens.values()) and all(r["doc_tokens"] == tokens[r["doc_id"]] for r in pieces)
    assert np.all([r["length"] > 0 for r in pieces])
