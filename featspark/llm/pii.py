"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

SQL functions only. ``split`` and ``regexp_extract_all`` with one pattern cut a text into what lies
between matches and the matches; their running lengths are the positions, and the characters about a
match come from its neighbours too. Patterns are possessive or
bounded, so time is linear in the text. A text is searched for a kind only if it holds a character
that every match of the kind must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, written so that no start position is tried in vain.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Length of an account number by country, from the IBAN registry.
IBAN_LENGTHS = {code[:2]: int(code[2:]) for code in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
    "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_KNOWN = rf"(?:{'|'.join(IBAN_LENGTHS)})[0-9]{{2}}"
#: As long as the country says; other codes run on, but not over the start of a known one.
_IBAN = "|".join([*(rf"(?:{'|'.join(c for c, k in IBAN_LENGTHS.items() if k == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))),
                  rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN}))?[A-Z0-9]){{11,30}}"])
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can hold no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Score by itself, score with a context word, least score to be reported (0: always).
SCORES = {"email": (0.9, 1.0, 0.0), "ip": (0.6, 0.9, 0.0), "card": (0.8, 1.0, 0.0), "phone": (0.6, 0.9, 0.0),
          "iban": (0.9, 1.0, 0.5), "ssn": (0.3, 0.8, 0.5)}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|server|host|login", "card": "card|visa|credit|payment|debit",
           "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer", "ssn": "ssn|social security|tax id"}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
#: Matches whose spans are gathered at once.
RUN = 128
#: Least characters from the start of a match to that of the next.
SHORTEST = {"email": 5, "ip": 7, "card": 3, "phone": 4, "iban": 15, "ssn": 11}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten."""
    back = F.reverse(digits)

    def part(i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number's ISO 7064 remainder is one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(m, " ", ""))
    return F.lit(True)


def _spans(kind: str, pieces: Column, matches: Column) -> Column:
    """Confirmed spans of a kind, in order, from what ``split`` and ``regexp_extract_all`` gave."""
    spans = "array<struct<kind:string,start:int,end:int,score:double>>"

    def state(at, i, tail, kind_of):
        return F.struct(at.alias("at"), i.alias("i"), tail.alias("tail"), F.expr(f"cast(array() as {kind_of})").alias("out"))

    alone, near, least = SCORES[kind]

    def step(acc, m):
        before = F.element_at(pieces, acc["i"] + 1)
        after = F.concat(*(F.left(F.coalesce(F.get(c, acc["i"] + k), F.lit("")), F.lit(CONTEXT_AFTER))
                           for k in range(1, CONTEXT_AFTER // SHORTEST[kind] + 2) for c in (pieces, matches)))
        seen = F.right(F.concat(acc["tail"], F.right(before, F.lit(CONTEXT_BEFORE))), F.lit(CONTEXT_BEFORE))
        begin = acc["at"] + F.length(before)
        end = begin + F.length(m)
        around = F.lower(F.concat(seen, F.lit(" "), F.left(after, F.lit(CONTEXT_AFTER))))
        score = F.when(around.rlike(CONTEXT[kind]), F.lit(near)).otherwise(F.lit(alone))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), score.alias("score"))
        out = F.when(_valid(kind, m) & (score >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        tail = F.right(F.concat(seen, F.right(m, F.lit(CONTEXT_BEFORE))), F.lit(CONTEXT_BEFORE))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), tail.alias("tail"), out.alias("out"))

    def run(acc, first):
        got = F.aggregate(F.slice(matches, first, F.lit(RUN)), state(acc["at"], acc["i"], acc["tail"], spans), step)
        return F.struct(got["at"].alias("at"), got["i"].alias("i"), got["tail"].alias("tail"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    # an array that grows by one span is copied for each: runs keep the copies short
    runs = F.sequence(F.lit(1), F.size(matches), F.lit(RUN))
    return F.flatten(F.aggregate(runs, state(F.lit(0), F.lit(0), F.lit(""), f"array<{spans}>"), run, lambda acc: acc["out"]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``findings``, an array of kind, start, end (code points,
    end exclusive) and score, by kind as in ``KINDS`` and then by start.

    Base kinds (email, ip, card, phone) are always reported once confirmed; iban needs its checksum,
    ssn a context word. Null and empty texts have no findings; repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty one.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    empty = F.expr("cast(array() as array<string>)")
    for kind, pattern in PATTERNS.items():
        maybe = F.contains("body", F.lit("@")) if kind == "email" else F.col("body").rlike(NEEDS[kind])
        df = df.withColumn(f"m_{kind}", F.when(maybe, F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("body", PATTERNS[k], -1)).otherwise(empty) for k in KINDS})
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    found = [F.when(F.size(f"m_{k}") > 0, _spans(k, F.col(f"p_{k}"), F.col(f"m_{k}"))).otherwise(none) for k in KINDS]
    return df.select("doc_id", F.concat(*found).alias("findings"))


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text and the scored findings."""
    found = find_pii(docs)
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("findings", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:len(BASE)], F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("findings")).alias("spans"), *counts[len(BASE):],
                        F.to_json("findings").alias("scored"))
