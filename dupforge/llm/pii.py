"""Operator 3, personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds, found wherever their pattern and their check hold: email, ip, card (Luhn), phone. Beyond them: iban (mod 97), ssn
(area, group and serial that can be) and local_phone, of which the last two count only with a fitting word nearby. Spans are in
code points, end exclusive. All of it is Column expressions; no Python runs on the executors.

The patterns here find what the plain ones of the base find, in time that grows with the text: they start at the beginning of a
run of letters or digits only (or where the last match ended), and take runs possessively.

Positions are running sums of the lengths of matches and of what lies between them; words nearby are looked for between a match
and its neighbours. Running sums are folded in chunks (scan()), so that a text of nothing but addresses takes time that grows with
its length too.

Defined results: null text is empty and has no spans; rows that repeat give rows that repeat; a null doc_id stays null; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import documents, numbered, with_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: Characters before and after a span in which words count as nearby.
NEARBY = 40
#: What score a span needs, what a fitting word adds, and what an unfitting one takes. Base kinds stay whatever their score.
THRESHOLD, FITTING, UNFITTING = 0.6, 0.3, 0.3

_LOCAL = r"[A-Za-z0-9._%+-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Lengths of IBANs by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four, with a space between them or not, as long as the country's are; of other countries as long as can be."""
    of = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}{of(n)}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without this has no match: cheaper to look for than the pattern.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
FITS = {
    "email": r"\b(?:e-?mail|contact|write|correo|courriel)\b",
    "ip": r"\b(?:ip|address|host|server|login|adresse)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\b",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social security|tax id)\b",
    "local_phone": r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\b",
}
UNFIT = r"\b(?:version|release|order|invoice|serial|isbn|issn|doi|build|article|ticket)\b"

_SPAN = "struct<kind: string, start: int, end: int, score: double, from: int, to: int>"  # from and to count bytes
CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The elements that step(state, item) gives beside its next state, in order. Spark's arrays are copied at each append, so
    they are filled chunk by chunk. items isn't empty."""
    none = F.array().cast(f"array<{kind}>")

    def one(st: Column, item: Column) -> Column:
        return let(F.struct(st["s"].alias("s"), item.alias("x")), lambda v: _step(v, st))

    def _step(v: Column, st: Column) -> Column:
        state, made = step(v["s"], v["x"])
        return F.struct(state.alias("s"), F.concat(st["out"], F.array(made.cast(kind))).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda j: F.slice(items, j * CHUNK + 1, F.lit(CHUNK)))
    inner = lambda st, chunk: F.aggregate(chunk, F.struct(st["s"].alias("s"), none.alias("out")), one)
    outer = lambda st, chunk: let(inner(st, chunk), lambda r: F.struct(r["s"].alias("s"), F.concat(st["out"], F.array(r["out"])).alias("out")))
    return F.flatten(F.aggregate(chunks, F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer)["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, letters counting from A = 10 on and the first four characters last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))  # its pattern counts the digits
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_AT = "struct<c: int, b: int>"
_FOUND = "struct<m: string, near: string, start: int, from: int>"


def _spans(text: Column, kind: str) -> Column:
    """array of kind, start, end, score, from, to."""
    pattern = PATTERNS[kind]
    none = F.array().cast(f"array<{_SPAN}>")

    def found(gaps: Column) -> Column:
        """Matches with the gap before each and the words around it."""
        near = lambda i: F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEARBY)), F.lit(" "), F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(NEARBY))))
        gap = lambda i: F.get(gaps, i)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(m.alias("m"), near(i).alias("near"), F.length(gap(i)).alias("c"), F.octet_length(gap(i)).alias("b")))

    def move(at: Column, x: Column) -> tuple[Column, Column]:
        start, begin = at["c"] + x["c"], at["b"] + x["b"]
        return F.struct((start + F.length(x["m"])).alias("c"), (begin + F.octet_length(x["m"])).alias("b")).cast(_AT), F.struct(x["m"].alias("m"), x["near"].alias("near"), start.alias("start"), begin.alias("from"))

    def scored(x: Column) -> Column:
        score = F.lit(SCORES[kind]) + F.when(x["near"].rlike(FITS[kind]), FITTING).otherwise(0.0) - F.when(x["near"].rlike(UNFIT), UNFITTING).otherwise(0.0)
        score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)
        end, to = x["start"] + F.length(x["m"]), x["from"] + F.octet_length(x["m"])
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), score.alias("score"), x["from"].alias("from"), to.alias("to")).cast(_SPAN)

    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b")).cast(_AT)
    placed = let(let(F.split(text, pattern, -1), found), lambda items: scan(items, zero, move, _FOUND))
    spans = F.transform(F.filter(placed, lambda x: _valid(kind, x["m"])), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    there = text.rlike(pattern) if kind not in NEEDS else F.contains(text, F.lit(NEEDS[kind])) & text.rlike(pattern)
    return F.when(there, spans).otherwise(none)


def _order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def detect(docs: DataFrame) -> DataFrame:
    """docs and a column spans, in place of one that docs may have: array of kind, start, end, score, in order."""
    spans = F.transform("spans", lambda s: F.struct(*(s[f].alias(f) for f in ("kind", "start", "end", "score"))))
    return _detected(docs).select(*(F.col(f"doc.`{c}`") for c in docs.columns if c != "spans"), spans.alias("spans"))


def _detected(docs: DataFrame) -> DataFrame:
    """doc, all columns of docs, and spans."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return numbered(docs).select("doc", *(_spans(text, kind).alias(kind) for kind in KINDS)).select("doc", _order(F.concat(*KINDS)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, and n_chars, if it is there, counted anew. Where spans overlap, the first one's kind stands for all they cover."""
    data = F.col("doc.text").cast("binary")
    piece = lambda at, end: F.substring(data, at + 1, F.greatest(end - at, F.lit(0))).cast("string")

    def cover(at: Column, s: Column) -> tuple[Column, Column]:
        tag = F.when(s["from"] >= at, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.greatest(at, s["to"]), F.concat(piece(at, s["from"]), tag)

    last = F.array_max(F.transform("spans", lambda s: s["to"]))
    covered = F.when(F.size("spans") > 0, F.concat(F.array_join(scan(F.col("spans"), F.lit(0), cover, "string"), ""), piece(last, F.octet_length(data))))
    rows = _detected(docs).withColumn("_covered", covered)
    return rows.select(*with_text(docs, F.col("_covered"), F.size("spans") > 0))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text)."""
    found = detect(docs.select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
