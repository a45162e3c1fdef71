import pytest

#: What every operator has to bear: nulls in any column, no text, repeated rows, ties, a very long text, and columns with names that operators use themselves.
ODD = [
    (None, "x", None, None), (1, None, "en", "s"), (2, "", None, "s"), (2, "", None, "s"), (3, " \n\t ", "en", None), (4, "Same text here, word for word.", "en", "s"), (4, "Same text here, word for word.", "en", "s"),
    (5, "SAME text here, word for word.", "en", "t"), (6, "É same É", "fr", "t"), (7, "é same é", "fr", "t"), (8, "a <|endoftext|> b <|startoftext|>", "en", "s"), (9, "日本語 😀 ½ \x1c\x85 tail", "xx", "s"),
]
CLASH = ("row_id", "name", "spans", "doc", "_row", "h", "fp", "pos", "n", "a", "b", "host", "lines", "email", "component_id")


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 0 if r[1] is None else len(r[1])) for r in ODD] + [(10, "long word and another; " * 20_000, "en", "s", 460_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.selectExpr("*", f"'{c}' AS `{c}`")
    path = str(__import__("tempfile").mkdtemp()) + "/odd"
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    """A few hundred documents of the benchmark tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
