"""Bases, k-mers and their hash, as DataFrame expressions and as numpy functions with the same values.

A sequence is a string.  In the ``text`` alphabet every character is a base, its code point modulo 4; in the
``dna`` alphabet A, C, G and T (U) are 0 to 3 and anything else is ambiguous and ends a run of bases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AMBIGUOUS = 4
_DNA = np.full(256, AMBIGUOUS, np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _DNA[[ord(c) for c in _letters]] = _code


def base_codes(text: str, alphabet: str = "text") -> np.ndarray:
    """Codes of a sequence's characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if alphabet == "text":
        return (points & 3).astype(np.uint8)
    return _DNA[np.minimum(points, 255)]


def code_array(text: Column) -> Column:
    """Codes of the characters in the text alphabet, as array<int>; null text has none."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c: (F.ascii(c) % 4).cast("int"))


def bases(text: Column) -> Column:
    """Letters A, C, G and T of the characters in the text alphabet; null text has none."""
    return F.array_join(F.transform(code_array(text), lambda c: F.get(F.array(*map(F.lit, "ACGT")), c)), "")


def subsequence(text: Column, start: Column, end: Column, rev: Column) -> Column:
    """Bases start to end of a text, held within it, on either strand."""
    last = F.least(end, F.length(text))
    piece = bases(F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(last - F.greatest(start, F.lit(0)), F.lit(0))))
    return F.when(rev, F.translate(F.reverse(piece), "ACGT", "TGCA")).otherwise(piece)


def strand_position(at: Column, total: Column) -> Column:
    """(pos, rev) of a position on a sequence followed by its reverse complement, ``total`` bases each."""
    rev = at >= total
    return F.struct(F.when(rev, 2 * total - 1 - at).otherwise(at).alias("pos"), rev.alias("rev"))


def largest_gap(length: Column, match: int, gap_open: int, gap_extend: int, band: int) -> Column:
    """The longest gap that ``length`` matching bases can pay for, from 1 to twice the band."""
    paid = ((length * match - gap_open) / float(gap_extend) + 1.0).cast("int")
    return F.least(F.greatest(paid, F.lit(1)), F.lit(2 * band))


def least_band(a: Column, b: Column, score: Column, match: int, gap_open: int, gap_extend: int) -> Column:
    """Band within which sequences of two lengths can reach a score."""
    lost = F.least(a, b) * match - score
    wide = ((lost - gap_open) / float(gap_extend) + 2.0).cast("int")
    return F.when((a == b) & (a * match - score < 2 * (gap_open + gap_extend - match)), 0).otherwise(F.greatest(wide, F.abs(a - b)))


def unescape(text: Column) -> Column:
    """A header's backslash sequences for tab, line feed, carriage return and backslash as these characters."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for name, char in (("t", "\t"), ("n", "\n"), ("r", "\r")):
        held = F.replace(held, F.lit("\\" + name), F.lit(char))
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def complement(codes: Column) -> Column:
    """Reverse complement of an array of codes; ambiguous bases stay."""
    return F.transform(F.reverse(codes), lambda c: F.when(c < AMBIGUOUS, 3 - c).otherwise(c))


def reverse_complement(dna: Column) -> Column:
    """Reverse complement of a DNA string; case is kept, U pairs with A and other letters stay."""
    return F.translate(F.reverse(dna), "ACGTUacgtu", "TGCAAtgcaa")


#: The rounds (shift, kind) of a public invertible integer hash, which decide the sketch.
HASH_ROUNDS = (("not_add", 21), ("xor", 24), ("times", (3, 8)), ("xor", 14), ("times", (2, 4)), ("xor", 28), ("add", 31))


def hash_codes(x: np.ndarray, bits: int) -> np.ndarray:
    """Invertible hash of unsigned integers of ``bits`` bits (at most 64), in words of 32 bits where these do."""
    word = np.uint32 if bits <= 32 else np.uint64
    x = x.astype(word)
    mask = word((1 << bits) - 1)
    for kind, by in HASH_ROUNDS:
        if kind == "not_add":
            x = (~x + (x << word(by))) & mask
        elif kind == "xor":
            x = x ^ x >> word(by)
        elif kind == "add":
            x = (x + (x << word(by))) & mask
        else:
            x = (x + (x << word(by[0])) + (x << word(by[1]))) & mask
    return x.astype(np.uint64)


def hash_column(x: Column, bits: int) -> Column:
    """The same hash of a long column; ``bits`` at most 31, so that no step leaves 63 bits."""
    if bits > 31:
        raise ValueError("the expression form takes at most 31 bits")
    mask = F.lit((1 << bits) - 1).cast("long")
    x = x.cast("long")
    for kind, by in HASH_ROUNDS:
        if kind == "not_add":
            x = (F.bitwise_not(x) + F.shiftleft(x, by)).bitwiseAND(mask)
        elif kind == "xor":
            x = x.bitwiseXOR(F.shiftright(x, by))
        elif kind == "add":
            x = (x + F.shiftleft(x, by)).bitwiseAND(mask)
        else:
            x = (x + F.shiftleft(x, by[0]) + F.shiftleft(x, by[1])).bitwiseAND(mask)
    return x


def kmer_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 numbers of all k-mers and of their reverse complements; ambiguous bases give arbitrary numbers.

    k-mers are put together from those of 1, 2, 4, ... bases.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    word = np.uint32 if k <= 16 else np.uint64
    part = (codes & 3).astype(word)
    turned, size = word(3) - part, 1  # k-mers of ``size`` bases and their reverse complements, by start
    forward, back, have = np.zeros(n, word), np.zeros(n, word), 0
    while True:
        if k & size:
            forward = forward << word(2 * size) | part[have : have + n]
            back |= turned[have : have + n] << word(2 * have)
            have += size
        if 2 * size > k:
            return forward.astype(np.uint64), back.astype(np.uint64)
        part = part[:-size] << word(2 * size) | part[size:]
        turned = turned[size:] << word(2 * size) | turned[:-size]
        size *= 2


def runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the maximal runs of unambiguous bases."""
    good = np.concatenate([[False], codes < AMBIGUOUS, [False]])
    turns = np.flatnonzero(good[1:] != good[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
