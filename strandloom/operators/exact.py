"""Exact matches: k-mer seeds joined on their values and merged along diagonals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.sketch import minimizers

MIN_SEED, MAX_OCC = 19, 500


def all_kmers(df: DataFrame, key: str, text: str = "text", k: int = MIN_SEED, only: Broadcast | None = None) -> DataFrame:
    """Every k-mer, or those of the hashes ``only``, as a minimizer of windows of one, with its strand and hash."""
    return minimizers(df, key, text, w=1, k=k, only=only)


def maximal_matches(anchors: DataFrame) -> DataFrame:
    """(read_id, rid, rev, qbeg, qend, rbeg): maximal exact matches from k-mer anchors at every position."""
    line = Window.partitionBy("read_id", "rid", "rev", "diag").orderBy("rpos")
    stepped = anchors.withColumn("diag", F.col("rpos") - F.col("qpos"))
    opened = stepped.withColumn("part", F.sum(F.when(F.col("rpos") - F.lag("rpos").over(line) == 1, 0).otherwise(1)).over(line))
    return opened.groupBy("read_id", "rid", "rev", "diag", "part").agg(
        (F.min("qpos") + 1 - F.max("span")).cast("int").alias("qbeg"),
        (F.max("qpos") + 1).cast("int").alias("qend"),
        (F.min("rpos") + 1 - F.max("span")).cast("int").alias("rbeg"),
    ).drop("diag", "part")


def super_maximal(matches: DataFrame) -> DataFrame:
    """(read_id, qbeg, qend, occ): query intervals that no other match's interval contains, with their places.

    Intervals are compared on the distinct (rev, qbeg, qend) of a read, by running ends.
    """
    spans = matches.groupBy("read_id", "rev", "qbeg", "qend").agg(F.count("*").alias("own"))
    order = Window.partitionBy("read_id", "rev").orderBy("qbeg", F.desc("qend"))
    before = F.max("qend").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = spans.withColumn("before", before).where(F.col("before").isNull() | (F.col("qend") > F.col("before")))
    inside = spans.select("read_id", "rev", F.col("qbeg").alias("i_s"), F.col("qend").alias("i_e"), F.col("own").alias("i_n"))
    met = outer.join(inside, ["read_id", "rev"]).where("i_s <= qbeg AND i_e >= qend")
    return met.groupBy("read_id", "rev", "qbeg", "qend").agg(F.sum("i_n").alias("occ"))


def shorter_seeds(
    begin: np.ndarray, end: np.ndarray, min_seed: int = MIN_SEED, long_from: int = 28, rare: int = 10, few: int = 20
) -> list[tuple[int, int, int, int]]:
    """(round, qbeg, qend, occ) of the second and third seeding rounds of one read's maximal matches.

    ``begin`` and ``end`` have a row for every place of a match, so the occurrences of an interval are the rows
    that cover it.  Round 2: a long, rare super-maximal match gives the longest interval around its middle that
    occurs more often.  Round 3: from the left, the shortest interval longer than ``min_seed`` that occurs
    fewer than ``few`` times, then on from its end.
    """
    out: list[tuple[int, int, int, int]] = []
    count = lambda s, e: int(((begin <= s) & (end >= e)).sum())
    spans = sorted(set(zip(begin.tolist(), end.tolist(), strict=True)))
    outer = [(s, e) for s, e in spans if not any((a <= s and b >= e) and (a, b) != (s, e) for a, b in spans)]
    for s, e in outer:
        more = count(s, e) + 1
        if e - s < long_from or more > rare + 1:
            continue
        middle = (s + e) // 2
        best: tuple[int, int] | None = None
        for a in sorted({x for x, _ in spans if x <= middle}):
            reach = np.sort(end[(begin <= a) & (end > middle)])[::-1]
            if len(reach) >= more and (best is None or reach[more - 1] - a > best[1] - best[0]):
                best = (a, int(reach[more - 1]))
        if best and best[1] - best[0] >= min_seed:
            out.append((2, *best, count(*best)))
    at, last = 0, int(end.max()) if len(end) else 0
    while at < last:
        reach = np.sort(end[begin <= at])[::-1]
        stop = at + min_seed + 1
        if len(reach) >= few:
            stop = max(stop, int(reach[few - 1]) + 1)
        times = count(at, stop)
        if times:
            out.append((3, at, stop, times))
            at = stop
        else:
            later = begin[begin > at]
            at = int(later.min()) if len(later) else last
    return out


def reseed(matches: DataFrame, min_seed: int = MIN_SEED) -> DataFrame:
    """(read_id, rev, round, qbeg, qend, occ): second- and third-round seeds of each read and strand."""
    schema = "read_id long, rev boolean, round int, qbeg int, qend int, occ int"
    kinds = [pa.int64(), pa.bool_(), *[pa.int32()] * 4]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        key = [table.column(k)[0].as_py() for k in ("read_id", "rev")]
        found = shorter_seeds(table.column("qbeg").to_numpy(), table.column("qend").to_numpy(), min_seed)
        rows = [dict(zip(names, (*key, *x), strict=True)) for x in found]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    return matches.select("read_id", "rev", "qbeg", "qend").groupBy("read_id", "rev").applyInArrow(run, schema)
