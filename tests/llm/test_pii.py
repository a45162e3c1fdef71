import hashlib
import random
import re

from pyspark.sql import functions as F

from dupforge.llm import pii

PARTS = ["@", "a@b.c", "x.y@d.e.f%z@q.r", "+1 (555) 123-4567", "+49", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111111", " ", "-", ".", "é", "0", "12", "😀", "(", "99", "..", "@@", "a.b@c.", "0001.2.3.004", "\n"]


def passes(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and passes(d)]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_as_plain_patterns_have_it(spark, docs, odd, empty):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14)))) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text")).unionByName(odd.filter("doc_id < 10").selectExpr("doc_id + 900000 AS doc_id", "text").distinct())
    got = {r["doc_id"]: r for r in pii.digests(df).collect()}
    for r in df.collect():
        want = base(r["text"] or "")
        text = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        g = got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in pii.BASE] == [sum(x[3] == k for x in want) for k in pii.BASE]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert ",".join(x for x in g["spans"].split(",") if x.split(":")[0] in pii.BASE) == text
    assert pii.digests(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.digests(odd).count() == odd.count()


def test_long_runs_take_no_time(spark):
    rows = [(1, "9" * 200_000), (2, "a" * 100_000 + "@" + "b" * 100_000), (3, "1 " * 100_000), (4, "1." * 100_000), (5, "+" + "1" * 100_000), (6, "DE89 " * 30_000)]
    got = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_email"] == r["n_card"] == r["n_phone"] == 0 for r in got)
    many = spark.createDataFrame([(1, "É a@b.co " * 20_000)], "doc_id long, text string")
    assert pii.digests(many).first()["n_email"] == 20_000 and pii.redact(many).first()["text"] == "É <EMAIL> " * 20_000


def test_added_kinds_ask_for_checks_and_context(spark):
    cases = {
        "pay to IBAN DE89 3704 0044 0532 0130 00 now": "iban", "IBAN DE89 3704 0044 0532 0130 01": "", "account GB82WEST12345698765432": "iban", "my SSN is 123-45-6789": "ssn", "part 123-45-6789": "", "ssn 000-12-3456": "",
        "call 555-123-4567": "local_phone", "number 555-123-4567": "", "order 555-123-4567 call": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["text"]: ",".join(s["kind"] for s in r["spans"]) for r in pii.detect(df).collect()}
    assert got == cases


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("0",)], "d string")
    assert [r[0] for r in df.select(pii.luhn(F.col("d"))).collect()] == [True, False, True]


def test_redaction(spark, odd):
    rows = [(1, "mail a@b.co or +1 (555) 123-4567, É 1.2.3.4.", 0), (2, "nothing", 7), (3, None, 1), (4, "a@b.1.2.3.4", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[1]["text"] == "mail <EMAIL> or <PHONE>, É <IP>." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "nothing" and out[2]["n_chars"] == 7 and out[3]["text"] is None and out[4]["text"] == "<EMAIL>"
    again = pii.redact(odd)
    assert again.columns == odd.columns and again.count() == odd.count() and again.first()["spans"] == "spans"


def test_iban_before_a_word(spark):
    ibans = ["AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    rows = [(k, f"pay {x} {after}") for k, (x, after) in enumerate((x, a) for x in ibans for a in ("BIC BKAUATWW", "12 euros", "now", ""))]
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] if s["kind"] == "iban"] == [("iban", ibans[r["doc_id"] // 4])]
