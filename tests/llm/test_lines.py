import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dupforge.llm import line_dedup as L


def by_hand(rows, min_words):
    """Deleted lines of each row: all runs of min_words words or more that are there before, by (doc_id, row, line). rows: (doc_id, text), in order of rows."""
    seqs = []
    for k, (doc_id, text) in enumerate(rows):
        seqs.append((k, doc_id, [(p, x.strip(" \t\r\x0b\f")) for p, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\x0b\f")]))
    seen, gone = set(), {}
    for k, doc_id, seq in sorted(seqs, key=lambda s: (s[1] is not None, s[1] or 0, s[0])):
        for i in range(len(seq)):
            words, runs = 0, []
            for j in range(i, len(seq)):
                words += len(seq[j][1].split())
                if words >= min_words:
                    runs.append(tuple(x for _, x in seq[i : j + 1]))
            for run in runs:
                if run in seen:
                    gone.setdefault(k, set()).update(seq[x][0] for x in range(i, i + len(run)))
            seen.update(runs)
    return gone


@pytest.mark.parametrize("digest_bits", [128, 2])
def test_as_by_hand(spark, tmp_path, digest_bits):
    rnd = random.Random(8)
    vocab = ["alpha beta", "gamma", "delta epsilon zeta", "eta", "  theta iota ", "kappa lambda mu nu", ""]
    rows = [(k, "\n".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25)))) for k in range(60)]
    rows += [(61, rows[5][1]), (62, rows[5][1] + "\nmore"), (63, None), (64, "eta\n" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for min_words in (7, 20):
        got = {}
        for r in L.repeated_lines(df, min_words, digest_bits).collect():
            got.setdefault(r["doc_id"], set()).add(r["pos"])
        want = {rows[k][0]: v for k, v in by_hand(rows, min_words).items()}
        assert got == want


def test_documents(spark, docs, odd, empty):
    passage = "\n".join(f"line {k} of a passage that many documents share word for word" for k in range(6))
    rows = [(1, f"own start of one\n{passage}\nown end"), (2, f"{passage}\nanother end"), (3, "quite other\ntext here"), (3, "quite other\ntext here"), (4, f"before\n\n{passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted_lines"], r["n_deleted_words"], r["runs"], r["first_ids"]) for r in L.by_document(df).collect()}
    words = len(passage.split())
    assert got == {1: (8, 0, 0, "", ""), 2: (7, 6, words, "0:5", "1"), 3: (2, 0, 0, "", ""), 4: (7, 6, words, "2:7", "1")}
    out = {r["doc_id"]: r["text"] for r in L.drop_repeated_runs(df).collect()}
    assert out == {1: rows[0][1], 2: "another end", 3: rows[2][1], 4: "before\n"}
    cut = L.drop_repeated_runs(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and L.by_document(odd).count() == odd.count()


def test_ends_of_runs_go(spark):
    """The last lines of a repeated run have fewer than 50 words by themselves."""
    say = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    for sizes in ((93, 2), (20, 20, 20, 5), (60, 1, 1, 1, 1, 1, 1, 1), (25, 25, 49), (1,) * 99):
        passage = "\n".join(say(n, k) for k, n in enumerate(sizes))
        longer = passage + "\nand one line more that two have"
        texts = [longer, f"start\n{passage}\nother", passage, f"{longer}\nend"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        out = {r["doc_id"]: r["text"] for r in L.drop_repeated_runs(df).collect()}
        assert out == {0: longer, 1: "start\nother", 2: "", 3: "end"}


def test_rows_that_repeat(spark, odd, empty):
    more = odd.filter("doc_id = 4").withColumn("text", F.lit("\n".join(" ".join(f"line{k}word{j}" for j in range(17)) for k in range(4)) + "\n \nrest"))
    df = odd.unionByName(more)
    rows = df.collect()
    want = sorted(Counter((rows[k]["doc_id"], len(v)) for k, v in by_hand([(r["doc_id"], r["text"]) for r in rows], 50).items()).items())
    got = sorted(Counter((r["doc_id"], r["n_deleted_lines"]) for r in L.by_document(df).collect() if r["n_deleted_lines"]).items())
    assert got == want == [((4, 5), 1)]
    assert sorted(r["text"] for r in L.drop_repeated_runs(df).filter("doc_id = 4").collect())[0] == " "
    assert L.by_document(empty).count() == 0 and L.drop_repeated_runs(empty).count() == 0
