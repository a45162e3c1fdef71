import random
import re
from collections import Counter, defaultdict

from dupforge.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(t):
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def plain(line):
    """A line normalised, from the words of the docstring."""
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return " ".join(re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[0-9]+", "0", out)))


def by_hand(rows, max_docs, left_percent):
    lines = [[x for x in (r["text"] or "").split("\n") if WORD.search(x)] for r in rows]
    docs, first = defaultdict(set), {}
    for r, ls in zip(rows, lines, strict=True):
        whole = tuple(map(plain, ls))
        for x in {*whole}:
            key = (r["source"], x)
            docs[key].add(whole)
            first[key] = min((v for v in (r["doc_id"], first.get(key)) if v is not None), default=None)
    above = {k for k, v in docs.items() if len(v) > max_docs}
    out = []
    for r, ls in zip(rows, lines, strict=True):
        n, chars, symbols, dup, repeat = figures(r["text"] or "")
        lost = sum(len(WORD.findall(x)) for x in ls if (k := (r["source"], plain(x))) in above and first[k] != r["doc_id"])
        base = n < 10 or 100 * repeat > 20 * n
        out.append((r["doc_id"], n, chars, symbols, dup, repeat, lost, base, not base and not (lost and 100 * (n - lost) < left_percent * n)))
    return out


def cleaned(rows, verdicts, max_docs):
    """Texts of the rows that stay, without the lines above the limit."""
    lines = [[plain(x) for x in (r["text"] or "").split("\n") if WORD.search(x)] for r in rows]
    docs, first = defaultdict(set), {}
    for r, ls in zip(rows, lines, strict=True):
        for x in {*ls}:
            docs[r["source"], x].add(tuple(ls))
            first[r["source"], x] = min((v for v in (r["doc_id"], first.get((r["source"], x))) if v is not None), default=None)
    gone = lambda r, x: WORD.search(x) and len(docs[r["source"], plain(x)]) > max_docs and first[r["source"], plain(x)] != r["doc_id"]
    return [(r["doc_id"], None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not gone(r, x))) for r, v in zip(rows, verdicts, strict=True) if v[-1]]


def test_as_by_hand(spark, docs, odd, empty):
    for df, max_docs in ((docs, 2), (odd, 0)):
        rows = df.collect()
        want = by_hand(rows, max_docs, 30)
        assert sorted(map(tuple, Q.assess(df, max_docs=max_docs).drop("row_id", "frequent").collect()), key=str) == sorted(want, key=str)
        out = Q.clean(df, max_docs=max_docs)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(cleaned(rows, want, max_docs), key=str)
    assert Q.assess(empty).count() == 0 and Q.clean(empty).count() == 0


def test_lines_go_and_copies_stay(spark):
    letters = "abcdefghij"
    body = lambda k: " ".join(letters[k // 10 % 10] + letters[k % 10] + letters[j % 10] + "z" * (j // 10) for j in range(30)) + "q" * (k // 100)
    rows = [(k, f"{body(k)}\nCopyright 20{k:02d} by us all\n{body(k + 50)}", "h", 0, "kept as it is") for k in range(20)]
    rows += [(100 + k, f"{body(77)}\n{body(78)}", "h", 0, "") for k in range(30)]  # copies of one text are one document
    rows += [(200, "Copyright 2033 by us all\nTiny rest of it now ok", "h", 0, ""), (201, "Copyright 2033 by us all\nTiny rest of it now ok", "other", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _row string")
    out = {r["doc_id"]: r for r in Q.clean(df, max_docs=5, left_percent=60).collect()}
    assert {*out} == {*range(20), *range(100, 130), 201}
    assert out[3]["text"] == f"{body(3)}\n{body(53)}" and out[3]["n_chars"] == len(out[3]["text"]) and out[3]["_row"] == "kept as it is"
    assert out[0]["text"] == rows[0][1]  # the first document keeps it
    assert out[101]["text"] == rows[20][1] and out[101]["n_chars"] == 0


def test_near_copies_leave_one(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    base = [words[k * 7 % 150] for k in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        w[k * 13 % 150] = "changed" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10]
        rows.append((k, "\n".join(" ".join(w[j : j + 30]) for j in range(0, 150, 30)), "h"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in Q.assess(df).filter("kept").collect()}
    assert 0 in kept and len(kept) < 10


def test_templates_go(spark):
    rnd = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    for host, n in enumerate((1, 4, 8)):
        template = [say(12) for _ in range(n)]
        rows = [(k, "\n".join([*template[: n // 2], say(25), *template[n // 2 :]]), f"h{host}") for k in range(300)]
        out = Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert out.filter(f"n_frequent_words = {12 * n}").count() == len(rows) - 1 and out.filter("n_frequent_words = 0").first()["doc_id"] == 0


def test_the_limit_is_that_of_any_host(spark):
    rnd = random.Random(5)
    own = lambda: " ".join("".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(12))
    rows = [(k, own() + ("\nShared by eleven documents of a large host" if k % 1000 == 0 and k < 11_000 else "\nShared by ten documents" if k % 1000 == 1 and k < 10_000 else ""), "h") for k in range(15_000)]
    out = Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.filter("n_frequent_words = 8").count() == 10 and out.filter("n_frequent_words > 0").count() == 10


def test_rows_are_the_same_in_any_order(spark):
    """A table that doesn't read alike each time is written first."""
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('one line of text for everyone here\n', 'word ', id, ' and so on for a while ', uuid()) AS text", "'h' AS source").orderBy(__import__("pyspark.sql.functions", fromlist=["x"]).rand())
    out = Q.clean(df).collect()
    assert len(out) == 2000 and all(f"word {r['doc_id']} " in r["text"] for r in out)
