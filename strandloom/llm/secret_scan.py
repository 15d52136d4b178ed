"""Secrets in whole texts, with DataFrame functions only.

Assignments, access keys and long hexadecimal runs are found by pattern.  Every other long token is tested.  The
characters it has imply its encoding (hexadecimal, base 32 or base 64), and a battery of randomness tests in that
alphabet (chi-squared uniformity over eight equal parts of it, runs about its middle, lag-1 serial correlation) may
show that it is not random.  What is reported is bounded the other way round: the hypothesis to be rejected is
"ordinary", that a token's characters follow a fixed model of words, names and paths (how one class of characters
follows another, letters by their use in European languages).  The evidence against it is the likelihood of the token
under the encoding's uniform draw over that under the model, or 0 if the battery fails it; under the hypothesis its mean
is at most 1, so it is an e-value.  The step-up over a text's tokens, each weighted by its share of their length (longer
tokens tell more), reports the k tokens of most weighted evidence for the largest k with k times the least of these at
least tokens / FALSE_DISCOVERY_RATE: of the tokens reported as ``random`` the expected share of ordinary ones is
bounded by that rate, however the tokens depend on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import largest, let, running
from strandloom.llm.spans import find, joined, replaced

PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "token": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"assign": "[:=]"}
BASE_KINDS = ("assign", "access", "hex")
#: The alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
MIN_VALUE_CHARS = 6
PARTS = 8
FALSE_DISCOVERY_RATE = 0.05
#: A token fails the battery below this p-value.
BATTERY_LEVEL = 0.01
#: The ordinary model.  Classes are lower case, upper case, digit, other; rows are the class before (the
#: last row: none), columns the class that follows.
CLASSES = 4
FOLLOWS = (0.82, 0.06, 0.06, 0.06, 0.40, 0.50, 0.05, 0.05, 0.10, 0.10, 0.70, 0.10, 0.40, 0.30, 0.25, 0.05, 0.50, 0.25, 0.15, 0.10)
#: Percent of the letters a to z in mixed European text, to the nearest twentieth.
LETTERS = (8.0, 1.6, 3.0, 4.0, 14.0, 1.5, 1.8, 3.0, 7.5, 0.5, 0.8, 4.8, 2.8, 8.0, 6.0, 2.4, 0.6, 6.8, 7.0, 7.2, 4.0, 1.3, 1.2, 0.4, 0.9, 0.9)
#: Characters of the class "other" in a token.
OTHERS = 4


def _upper_tail(z: Column) -> Column:
    """Normal upper tail by a logistic curve in z and its cube (within 2e-4)."""
    held = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * held + 0.07056 * held * held * held))


def _core(token: Column) -> Column:
    """A token in the letters of the alphabets."""
    return F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")


def encoding(core: Column) -> Column:
    return F.when(core.rlike("^[0-9a-fA-F]+$"), F.lit("hex")).when(core.rlike("^[A-Z2-7]+$"), F.lit("base32")).otherwise(F.lit("base64"))


def _size(kind: Column) -> Column:
    return F.when(kind == "hex", 16.0).when(kind == "base32", 32.0).otherwise(64.0)


def battery(token: Column) -> Column:
    """Bonferroni-combined p-value, for "drawn uniformly from the inferred alphabet", of three tests."""
    core = _core(token)
    return let(F.struct(encoding(core).alias("kind"), core.alias("core")), _p_value)


def evidence(token: Column) -> Column:
    """Log of the token's likelihood under a uniform draw over that under the ordinary model; -Infinity where that is
    positive and the battery fails the token."""
    core = _core(token)

    def of(x: Column) -> Column:
        kind, letters = x["kind"], x["core"]
        codes = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.ascii(c))
        lower = lambda c: c.between(97, 122)
        upper = lambda c: c.between(65, 90)
        klass = lambda c: F.when(lower(c), 0).when(upper(c), 1).when(c.between(48, 57), 2).otherwise(3)

        def total(v: Column) -> Column:
            before = lambda i: F.when(i == 0, CLASSES).otherwise(klass(F.get(v, i - 1)))
            follows = lambda c, i: F.get(F.array(*map(F.lit, FOLLOWS)), before(i) * CLASSES + klass(c))
            letter = lambda c: F.get(F.array(*[F.lit(p / sum(LETTERS)) for p in LETTERS]), F.when(lower(c), c - 97).otherwise(c - 65))
            own = lambda c: F.when(lower(c) | upper(c), letter(c)).when(c.between(48, 57), 0.1).otherwise(1.0 / OTHERS)
            logs = F.transform(v, lambda c, i: -F.log(_size(kind) * follows(c, i) * own(c)))
            return F.aggregate(logs, F.lit(0.0), lambda s, y: s + y)

        # Evidence of at most 1 needs no battery to hold it down.
        return let(let(codes, total), lambda e: F.when((e > 0) & (_p_value(x) < BATTERY_LEVEL), F.lit(float("-inf"))).otherwise(e))

    return let(F.struct(encoding(core).alias("kind"), core.alias("core")), of)


def _p_value(token: Column) -> Column:
    letters = F.when(token["kind"] == "hex", F.lower(token["core"])).otherwise(token["core"])
    alphabet = F.when(token["kind"] == "hex", F.lit(ALPHABETS["hex"])).when(token["kind"] == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))
    codes = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return let(F.struct(codes.alias("v"), _size(token["kind"]).alias("size")), _combined)


def _combined(x: Column) -> Column:
    v, size = x["v"], x["size"].cast("double")
    n = F.size(v).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)),
        lambda k: F.size(F.filter(v, lambda y: F.floor(y * PARTS / size) == k)).cast("double"),
    )
    chi = total(F.transform(counts, lambda c: c * c)) * PARTS / n - n
    free = PARTS - 1
    spread = 2.0 / (9 * free)
    uneven = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / spread**0.5)

    high = total(F.transform(v, lambda y: F.when(y * 2 >= size, 1.0).otherwise(0.0)))
    low = n - high
    follows = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(1)))
    pairs = F.zip_with(v, follows, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    real = F.filter(pairs, lambda p: p["b"].isNotNull())
    runs = 1 + total(F.transform(real, lambda p: F.when((p["a"] * 2 >= size) != (p["b"] * 2 >= size), 1.0).otherwise(0.0)))
    mean = 2 * high * low / n + 1
    var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
    clumped = 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var))

    def about(middle: Column) -> Column:
        power = F.greatest(total(F.transform(v, lambda y: (y - middle) * (y - middle))), F.lit(1e-9))
        r = total(F.transform(real, lambda p: (p["a"] - middle) * (p["b"] - middle))) / power
        serial = 2 * _upper_tail(F.abs(r) * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(uneven, clumped, serial))

    return let(total(v) / n, about)


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span: none before a token in order of starts reaches it, none after it begins in it."""
    far = 2_000_000_000
    placed = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["hit"].alias("hit")))

    def ends(u: Column) -> Column:
        reach = running(F.transform(u, lambda s: F.when(s["own"], 0).otherwise(s["end"])), largest)
        coming = running(F.transform(F.reverse(u), lambda s: F.when(s["own"], 0).otherwise(far - s["start"])), largest)
        return let(F.struct(reach.alias("reach"), F.reverse(coming).alias("coming")), lambda x: kept(u, x))

    def kept(u: Column, x: Column) -> Column:
        free = F.filter(u, lambda s, i: s["own"] & (F.get(x["reach"], i) <= s["start"]) & (far - F.get(x["coming"], i) >= s["end"]))
        return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))

    return let(F.array_sort(F.concat(placed(tokens, True), placed(base, False))), ends)


def _reported(tokens: Column) -> Column:
    """Of (start, end, hit) tokens those that the step-up reports."""
    length = lambda t: F.length(t["hit"]).cast("double")

    def weighed(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda s, y: s + length(y)) / F.size(t)
        return let(mean, lambda m: F.transform(t, lambda y: F.struct((evidence(y["hit"]) + F.log(length(y) / m)).alias("e"), y.alias("t"))))

    def stepped(w: Column) -> Column:
        sorted_e = F.reverse(F.array_sort(F.transform(w, lambda y: y["e"])))
        need = F.log(F.size(w) / F.lit(FALSE_DISCOVERY_RATE))
        passed = F.transform(sorted_e, lambda e, k: F.when(e + F.log((k + 1).cast("double")) >= need, e))
        return let(F.array_min(passed), lambda least: F.transform(F.filter(w, lambda y: y["e"] >= least), lambda y: y["t"]))

    return let(weighed(tokens), stepped)


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets`` (which replaces a column of that name): spans with start, rank (place of the kind), end, kind and
    hit, by start then kind.

    Null and empty texts have none.  A random token that overlaps a span found by pattern is not repeated.  No other
    column is read or changed.
    """
    value = lambda s: F.regexp_extract(s["hit"], r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)

    def of(t: Column) -> Column:
        found = {k: find(k, t, p, NEEDS.get(k)) for k, p in PATTERNS.items()}
        base = F.concat(F.filter(found["assign"], lambda s: F.length(value(s)) >= MIN_VALUE_CHARS), found["access"], found["hex"])
        return let(F.struct(base.alias("base"), found["token"].alias("token")), together)

    def together(x: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
        tested = let(_apart(x["token"], x["base"]), lambda free: F.when(F.size(free) > 0, _reported(free)).otherwise(none))
        random = F.when(F.size(x["token"]) > 0, tested).otherwise(none)
        based = F.transform(x["base"], lambda s: _shape(s, s["kind"]))
        return F.array_sort(F.concat(based, F.transform(random, lambda s: _shape(s, F.lit("random")))))

    return df.withColumn("secrets", let(F.coalesce(F.col(f"`{text}`"), F.lit("")), of))


def _shape(s: Column, kind: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, (*BASE_KINDS, "random"))), kind) - 1
    return F.struct(s["start"].alias("start"), rank.cast("int").alias("rank"), s["end"].alias("end"), kind.alias("kind"), s["hit"].alias("hit"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``secrets``."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def mask(df: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Replace each secret span by [SECRET]; spans that overlap are replaced together.  Texts without spans, null ones
    too, and rows with null spans stay as they are."""
    return df.withColumn(text, replaced(F.col(f"`{text}`"), F.col(secrets), lambda s: F.lit("[SECRET]")))
