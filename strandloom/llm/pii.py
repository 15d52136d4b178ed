"""Personal data in whole texts, with DataFrame functions only.

Patterns propose spans, checksum and range validators confirm them, and words shortly before a span adjust
its score.  E-mail, IP, card and phone spans stay whatever their context; IBANs need their mod-97 check and
social-security numbers need a context word to reach MIN_SCORE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import let
from strandloom.llm.spans import find, joined, replaced

_LOCAL = "A-Za-z0-9._%+-"
#: Characters of an IBAN by the countries that use so many.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A match starts where the one before it ended, or after a character that could not lengthen it: the
#: same leftmost matches without a new try from every character of a run.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # As many characters as the country's IBANs have, so that words after one are not taken for its end.
    "iban": "(?i)(?<![A-Z0-9])(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to match at all; a single character is searched as such.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9\x20-]", "phone": "+", "iban": "[A-Za-z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Score of a confirmed span without and with a context word before it.
SCORES = {"email": (0.8, 0.95), "ip": (0.6, 0.9), "card": (0.7, 0.95), "phone": (0.6, 0.9), "iban": (0.8, 0.95), "ssn": (0.3, 0.8)}
MIN_SCORE = 0.5
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|courriel|correo)\b",
    "ip": r"(?i)\b(ip|address|host|server|adresse)\b",
    "card": r"(?i)\b(card|credit|visa|mastercard|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(ssn|social security|social)\b",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.split(F.reverse(digits), "")

    def add(total: Column, pair: Column) -> Column:
        twice = pair["d"] * 2
        return total + F.when(pair["odd"], twice - F.when(twice > 9, 9).otherwise(0)).otherwise(pair["d"])

    pairs = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c, i: F.struct((c.cast("int")).alias("d"), (i % 2 == 1).alias("odd")),
    )
    return F.aggregate(pairs, F.lit(0), add) % 10 == 0


def mod97_ok(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 modulo 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def add(rest: Column, v: Column) -> Column:
        return F.when(v < 65, (rest * 10 + (v - 48)) % 97).otherwise((rest * 100 + (v - 55)) % 97)

    return F.aggregate(values, F.lit(0), add) == 1


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(hit)
        fits = F.length(digits).between(13, 19)
        return F.when(fits, luhn_ok(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97_ok(F.upper(F.regexp_replace(hit, " ", "")))
    if kind == "ssn":
        return hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii`` (which replaces a column of that name): the confirmed spans with kind, start, end (code points, end
    exclusive), hit and score, by kind in the order of PATTERNS, then start.  Null and empty texts have none.  No other
    column is read or changed."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def scored(kind: str, found: Column) -> Column:
        plain, helped = SCORES[kind]

        def one(s: Column) -> Column:
            score = F.when(s["before"].rlike(CONTEXT_WORDS[kind]), F.lit(helped)).otherwise(F.lit(plain))
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), score.alias("score"))

        spans = F.transform(F.filter(found, lambda s: _valid(kind, s["hit"])), one)
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)

    return df.withColumn("pii", let(whole, lambda t: F.concat(*[scored(k, find(k, t, p, NEEDS[k])) for k, p in PATTERNS.items()])))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``pii``, and n_spans, the number of spans of all kinds."""
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace every span found by its kind in brackets; spans that overlap are replaced together, by the first's kind
    (of one start: the shortest).  Texts without spans, null ones too, and rows with null spans stay as they are."""
    ordered = F.array_sort(F.transform(F.col(pii), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return df.withColumn(text, replaced(F.col(f"`{text}`"), ordered, lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))))


__all__ = ["PATTERNS", "digest", "find_pii", "luhn_ok", "mod97_ok", "redact"]
