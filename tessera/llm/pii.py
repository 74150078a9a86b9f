"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Columns of built-in functions only.  regexp_extract_all() gives the matches of a kind and split() what lies
between them, so positions are running sums of their lengths.  The patterns are possessive, and start only
where a longer run of the same characters cannot, so a text costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, from the contract.  Possessive loops and look-behind change the cost, not the matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"  # a shorter run is no card wherever it begins, so it is not proposed
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added by the method: account numbers, of the length that the registry gives the country.  What follows one is no part of it.
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()


def _iban() -> str:
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS:
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    kinds = "|".join(rf"(?:{'|'.join(codes)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, codes in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{kinds})(?![A-Za-z0-9])"


IBAN = _iban()
#: Added by the method: social security numbers, which look like many others; only the words nearby tell.
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
#: Kinds whose text must hold such a character or sign to be worth a search.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {"email": "mail|contact|write|schreib|écri|correo", "ip": "address|adresse|host|server|client|ip", "card": "card|visa|master|credit|karte|carte|tarjeta", "phone": "phone|call|tel|fax|mobil|ruf|llam", "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social security|sozialversicherung|sécurité sociale|seguridad social"}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed match of each kind; words of CONTEXT within NEAR characters add BONUS.  Base kinds stay at any
#: score, the others from ACCEPT on.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.7, "ssn": 0.4}
BONUS, NEAR, ACCEPT = 0.3, 40, 0.6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(c: Column) -> Column:
    """Remainder of an account number by 97, its first four characters moved to the end, letters from A = 10."""
    compact = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 1000), F.substring(compact, 1, 4))
    digit = lambda x: F.when(F.ascii(x) >= 65, F.ascii(x) - 55).otherwise(F.ascii(x) - 48)
    step = lambda acc, x: F.when(digit(x) >= 10, (acc * 100 + digit(x)) % 97).otherwise((acc * 10 + digit(x)) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step)


def confirmed(kind: str, match: Column) -> Column:
    """The kind's checksum or range check."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _spans(kind: str, matches: Column, between: Column) -> Column:
    """Confirmed spans of a kind, as structs (kind, start, end, score), in order."""

    def add(acc: Column, i: Column) -> Column:
        match, gap = F.element_at(matches, i), F.element_at(between, i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(match)
        around = F.lower(F.concat(F.right(gap, F.lit(NEAR)), F.lit(" "), F.left(F.element_at(between, i + 1), F.lit(NEAR))))
        score = F.lit(PRIOR[kind]) + F.when(around.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        fits = confirmed(kind, match) if kind in BASE else confirmed(kind, match) & (score >= ACCEPT)
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(fits, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    found = F.aggregate(F.sequence(F.lit(1), F.size(matches)), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def _found(rows: DataFrame) -> DataFrame:
    """Rows (_row, _body) with spans; _body is a text that is not null."""
    out = rows
    for kind, pattern in PATTERNS.items():
        worth = F.contains(F.col("_body"), F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        matches = F.regexp_extract_all("_body", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"_m_{kind}", F.when(worth, matches).otherwise(F.array().cast("array<string>")))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"_b_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_body", pattern, -1)))
    for kind in PATTERNS:
        out = out.withColumn(f"_s_{kind}", _spans(kind, F.col(f"_m_{kind}"), F.col(f"_b_{kind}")))
    return out.select("_row", "_body", F.concat(*[F.col(f"_s_{kind}") for kind in PATTERNS]).alias("spans"))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a column spans: array of (kind, start, end, score), by kind and then start.

    Positions are code points, the end exclusive; a null text has no spans.  A column spans of the documents is replaced.
    """
    kept = [f"`{c}`" for c in docs.columns if c != "spans"]
    found = _found(docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_body")))
    return found.select("_row.*", "spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the number of spans of each base kind, a digest of these, all spans and their scores."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span (overlaps joined) replaced by its kind in brackets.

    A null text stays null, rows may repeat, and columns may have any names.
    """
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    rest = F.struct(*others) if others else F.lit(None)
    row = F.struct(rest.alias("rest"), F.col(text_col).isNull().alias("none"))
    found = _found(docs.select(row.alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_body")))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def cut(acc: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.concat(acc["out"], F.substring(F.col("_body"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(F.col("_body"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    hidden = F.when(F.size("spans") > 0, text).otherwise(F.col("_body"))
    return found.select(*[F.when(~F.col("_row.none"), hidden).alias(c) if c == text_col else F.col(f"_row.rest.`{c}`").alias(c) for c in docs.columns])
