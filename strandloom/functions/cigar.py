"""CIGAR strings: parsing, merging, clipping and what they consume."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.arrays import let, running

_OP = re.compile(r"(\d+)([MIDNSHP=X])")


def parse(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OP.findall(cigar)]


def normalise(cigar: str) -> str:
    """Neighbouring operations of one kind merged, those of length 0 dropped, and an I and D that touch put in
    the order I, D (their lengths summed)."""
    out: list[list] = []
    group = {"I": 0, "D": 0}

    def close() -> None:
        out.extend([n, op] for op, n in group.items() if n)
        group.update(I=0, D=0)

    for n, op in parse(cigar):
        if not n:
            continue
        if op in group:
            group[op] += n
            continue
        close()
        if out and out[-1][1] == op:
            out[-1][0] += n
        else:
            out.append([n, op])
    close()
    return "".join(f"{n}{op}" for n, op in out)


def left_aligned(cigar: str, q: np.ndarray, t: np.ndarray) -> tuple[str, int, int]:
    """(CIGAR, query bases, target bases): every gap moved as far left as equal bases let it, then normalised.

    A gap of n bases moves over a match where the base before it equals that n places on, so that no pair changes;
    where a match is used up its gap joins the one before.  A gap at the beginning is taken off, and the bases that it
    covered are the two numbers.
    """
    done: list[list] = []
    i = j = 0  # where the operation at hand begins
    waiting = parse(normalise(cigar))[::-1]
    while waiting:
        n, op = waiting.pop()
        moved = 0
        if op in "ID" and done and done[-1][1] == "M" and waiting and waiting[-1][1] == "M":
            bases, at = (q, i) if op == "I" else (t, j)
            room = done[-1][0]
            before, ahead = bases[at - room : at][::-1], bases[at + n - room : at + n][::-1]
            differ = np.flatnonzero(before != ahead)
            moved = int(differ[0]) if len(differ) else room
        if moved:
            done[-1][0] -= moved
            waiting[-1] = (waiting[-1][0] + moved, "M")
            i, j = i - moved, j - moved
            if not done[-1][0]:
                done.pop()
                if done:  # gaps touch now; the joined ones may move on
                    gap, kind = done.pop()
                    i, j = i - (gap if kind in "IS" else 0), j - (gap if kind in "DN" else 0)
                    pair = {"I": 0, "D": 0, "N": 0}
                    pair[kind] += gap
                    pair[op] += n
                    waiting.extend((size, k) for k, size in reversed(pair.items()) if size)
                    continue
        done.append([n, op])
        i, j = i + (n if op in "MIS=X" else 0), j + (n if op in "MDN=X" else 0)
    q_off = t_off = 0
    while done and done[0][1] in "ID":
        n, op = done.pop(0)
        q_off, t_off = q_off + (n if op == "I" else 0), t_off + (n if op == "D" else 0)
    return normalise("".join(f"{n}{op}" for n, op in done)), q_off, t_off


def ops(cigar: Column) -> Column:
    """array<struct<n int, op string>> of a CIGAR column (null: empty)."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(
        found, lambda x: F.struct(F.substring(x, 1, F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op"))
    )


def _total(cigar: Column, kinds: str) -> Column:
    return F.aggregate(ops(cigar), F.lit(0), lambda s, x: s + F.when(F.lit(kinds).contains(x["op"]), x["n"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    """Query bases, clipped ones too."""
    return _total(cigar, "MIS=X")


def reference_length(cigar: Column) -> Column:
    return _total(cigar, "MDN=X")


def gap_bases(cigar: Column) -> Column:
    return _total(cigar, "ID")


def gap_opens(cigar: Column) -> Column:
    return F.size(F.filter(ops(cigar), lambda x: x["op"].isin("I", "D")))


def event_identity(matches: Column, columns: Column, cigar: Column) -> Column:
    """Matches over alignment columns, every gap counted as one."""
    return matches / (columns - gap_bases(cigar) + gap_opens(cigar))


def merged(cigar: Column) -> Column:
    """Equal neighbouring operations added up, by expressions whose cost is near the CIGAR's length."""

    def of(v: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i)["op"] != F.get(v, i - 1)["op"]))
        bound = F.struct(opens.alias("opens"), F.concat(running(F.transform(v, lambda x: x["n"]), kind="long"), F.array(_sum(v))).alias("upto"))
        return let(bound, lambda b: F.transform(b["opens"], lambda i, k: _item(v, b, i, k)))

    def _item(v: Column, b: Column, i: Column, k: Column) -> Column:
        following = F.coalesce(F.get(b["opens"], k + 1), F.size(v))
        return F.concat((F.get(b["upto"], following) - F.get(b["upto"], i)).cast("string"), F.get(v, i)["op"])

    def _sum(v: Column) -> Column:
        return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    return let(ops(cigar), lambda v: F.when(F.size(v) > 0, F.array_join(of(v), "")).otherwise(F.lit("")))


def clipped(cigar: Column, before: Column, after: Column) -> Column:
    """Soft clips around a CIGAR whose deletion at either end is dropped."""
    core = F.regexp_replace(F.regexp_replace(cigar, "^[0-9]+D", ""), "([MI=X])[0-9]+D$", "$1")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise(F.lit(""))
    return F.concat(clip(before), core, clip(after))


def flags(unmapped: Column, rev: Column, secondary: Column, supplementary: Column) -> Column:
    """SAM flag bits of the four properties."""
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return bit(unmapped, 0x4).bitwiseOR(bit(rev, 0x10)).bitwiseOR(bit(secondary, 0x100)).bitwiseOR(bit(supplementary, 0x800))
