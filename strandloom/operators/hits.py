"""Hits: primary and secondary assignment, filters, overlaps and pairing."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default thresholds.
MASK_LEVEL, PRI_RATIO, BEST_N, REDUNDANT = 0.5, 0.8, 5, 0.95


def rank_hits(hits: DataFrame) -> DataFrame:
    """Add place: 1 for a read's best hit by score, anchors and then position."""
    order = Window.partitionBy("read_id").orderBy(F.desc("score"), F.desc("cnt"), "rid", "rev", "rs", "qs")
    return hits.withColumn("place", F.row_number().over(order))


def best_hits(hits: DataFrame, best_n: int = BEST_N, ratio: float = PRI_RATIO, slack: int = 30) -> DataFrame:
    """Each read's best hit and up to ``best_n`` others that score near it.

    The best is an aggregate with partial sums; only hits near it are ranked.
    """
    top = hits.groupBy("read_id").agg(F.max("score").alias("top_score"))
    near = hits.join(top, "read_id").where((F.col("score") >= F.col("top_score") * ratio) | (F.col("score") + slack >= F.col("top_score")))
    return rank_hits(near).where(F.col("place") <= best_n + 1).drop("top_score")


def overlaps(hits: DataFrame) -> DataFrame:
    """(read_id, a, b, shared, part): pairs of a read's hits that overlap on the read; a ranks before b."""
    ranked = rank_hits(hits).select("read_id", "place", "qs", "qe")
    left = ranked.select("read_id", F.col("place").alias("a"), F.col("qs").alias("a_s"), F.col("qe").alias("a_e"))
    right = ranked.select("read_id", F.col("place").alias("b"), F.col("qs").alias("b_s"), F.col("qe").alias("b_e"))
    met = left.join(right, "read_id").where("a < b AND a_s < b_e AND b_s < a_e")
    shared = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    shorter = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s"))
    return met.select("read_id", "a", "b", shared.alias("shared"), (shared / shorter).alias("part"))


def uncovered(hits: DataFrame) -> DataFrame:
    """(read_id, rid, rs, fresh): for each hit by place on the read, the length no earlier hit covers."""
    order = Window.partitionBy("read_id").orderBy("qs", "qe", "rid", "rs", "rev")
    reach = F.max("qe").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("qe") - F.greatest(F.col("qs"), F.coalesce(reach, F.col("qs"))))
    return hits.select("read_id", "rid", "rev", "qs", "qe", "rs", fresh.alias("fresh"))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One of the hits with equal score and starts."""
    return hits.dropDuplicates(["read_id", "rid", "rev", "score", "rs", "qs"])


def drop_redundant(hits: DataFrame, min_score: int = 30, part: float = REDUNDANT) -> DataFrame:
    """Hits of enough score, without those that a better one overlaps on both axes by more than ``part``."""
    kept = rank_hits(hits.where(F.col("score") >= min_score))
    o = kept.select(
        "read_id", "rid", *[F.col(k).alias(f"o_{k}") for k in ("rev", "place", "rs", "re", "qs", "qe")]
    )
    shared = lambda s, e: F.least(e, f"o_{e}") - F.greatest(s, f"o_{s}")
    shorter = lambda s, e: F.least(F.col(e) - F.col(s), F.col(f"o_{e}") - F.col(f"o_{s}"))
    worse = (
        kept.join(o, ["read_id", "rid"])
        .where(F.col("o_place") < F.col("place"))
        .where((shared("rs", "re") > shorter("rs", "re") * part) & (shared("qs", "qe") > shorter("qs", "qe") * part))
        .select("read_id", "place")
        .distinct()
    )
    return kept.join(worse, ["read_id", "place"], "left_anti").drop("place")


def assign_parents(qs: np.ndarray, qe: np.ndarray, score: np.ndarray, cnt: np.ndarray, mask: float = MASK_LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, subsc, n_sub) of a read's hits in ranked order.

    A hit is secondary to the first primary whose overlap, less what no primary covers of the hit, is above
    ``mask`` of the shorter; otherwise it is a primary, its own parent.
    """
    n = len(qs)
    parent, subsc, n_sub = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    primaries: list[int] = []
    for i in range(n):
        p = np.array(primaries, np.int64)
        met = p[(qs[p] < qe[i]) & (qe[p] > qs[i])] if len(p) else p
        met = met[np.argsort(qs[met], kind="stable")] if len(met) else met
        bare = qe[i] - qs[i]
        if len(met):
            s, e = np.maximum(qs[met], qs[i]), np.minimum(qe[met], qe[i])
            reach = np.maximum.accumulate(e)
            before = np.concatenate([[qs[i]], reach[:-1]])
            bare -= int(np.maximum(0, e - np.maximum(s, before)).sum())
        for j in primaries:
            both = min(qe[i], qe[j]) - max(qs[i], qs[j])
            if both <= 0:
                continue
            a, b = sorted((qe[i] - qs[i], qe[j] - qs[j]))
            if both / a - bare / b > mask:
                parent[i] = j
                subsc[j] = max(subsc[j], score[i])
                n_sub[j] += cnt[i] >= cnt[j]
                break
        else:
            primaries.append(i)
    return parent, subsc, n_sub


def set_parents(hits: DataFrame, mask: float = MASK_LEVEL) -> DataFrame:
    """``rank_hits`` with the place of each hit's parent, and subsc and n_sub of primaries."""
    ranked = rank_hits(hits)
    added = pa.schema([("parent", pa.int32()), ("subsc", pa.int32()), ("n_sub", pa.int32())])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = assign_parents(*(table.column(k).to_numpy().astype(np.int64) for k in ("qs", "qe", "score", "cnt")), mask)
        for field, values in zip(added, (found[0] + 1, found[1], found[2]), strict=True):
            table = table.append_column(field, pa.array(values.astype(np.int32)))
        return table

    return ranked.groupBy("read_id").applyInArrow(run, f"{fields}, parent int, subsc int, n_sub int")


class Marked(NamedTuple):
    """For each hit, by its number: its parent (-1: primary), that of the first round, sub, sub_n, and its ALT parent's score."""

    parent: np.ndarray
    first_parent: np.ndarray
    sub: np.ndarray
    sub_n: np.ndarray
    alt_score: np.ndarray


def _mark(order: list[int], qs: np.ndarray, qe: np.ndarray, score: np.ndarray, alt: np.ndarray, mask: float, near: int, sub: np.ndarray, sub_n: np.ndarray) -> dict[int, int]:
    """Parents of the hits in ``order``: the first primary that overlaps one by ``mask`` of the shorter; counts rivals."""
    primaries, parents = [], {}
    for i in order:
        for j in primaries:
            shared = min(qe[i], qe[j]) - max(qs[i], qs[j])
            if shared > 0 and shared >= min(qe[i] - qs[i], qe[j] - qs[j]) * mask:
                sub[j] = sub[j] or score[i]
                sub_n[j] += score[j] - score[i] <= near and (alt[j] or not alt[i])
                parents[i] = j
                break
        else:
            primaries.append(i)
    return parents


def mark_in_rounds(qs: np.ndarray, qe: np.ndarray, score: np.ndarray, alt: np.ndarray, mask: float = MASK_LEVEL, near: int = 7) -> Marked:
    """Primaries of a read's ranked hits, of all and then of those that aren't on alternative sequences.

    Where there are hits of both kinds, the second round decides for the others and begins their sub anew, but goes on
    with their sub_n; hits on alternative sequences keep the first round's.  ``near`` is the score of one mismatch or
    gap; a hit that a primary outscores by no more is its rival, unless it alone is on an alternative sequence.
    """
    n = len(qs)
    sub, sub_n, alt_score = (np.zeros(n, np.int64) for _ in range(3))
    first = _mark(list(range(n)), qs, qe, score, alt, mask, near, sub, sub_n)
    for i, j in first.items():
        if alt[j] and not alt[i]:
            alt_score[i] = score[j]
    parents = first
    if alt.any() and not alt.all():
        main = np.flatnonzero(~alt).tolist()
        sub[main] = 0
        parents = {i: j for i, j in first.items() if alt[i]} | _mark(main, qs, qe, score, alt, mask, near, sub, sub_n)
    found = (np.array([p.get(i, -1) for i in range(n)], np.int64) for p in (parents, first))
    return Marked(*found, sub, sub_n, alt_score)


def mark_primaries(hits: DataFrame, mask: float = MASK_LEVEL, near: int = 7) -> DataFrame:
    """Hits (with ``is_alt``) by ``mark_in_rounds``: place, parent and first_parent (places, null for primaries), sub, sub_n, alt_score.

    Hits are ranked by score, those not on alternative sequences first of equals, then by position.
    """
    order = Window.partitionBy("read_id").orderBy(F.desc("score"), "is_alt", "rid", "rev", "rs", "qs", "qe", "re")
    ranked = hits.withColumn("place", F.row_number().over(order))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        values = [table.column(k).to_numpy().astype(np.int64) for k in ("qs", "qe", "score")]
        found = mark_in_rounds(*values, table.column("is_alt").to_numpy().astype(bool), mask, near)
        for name, at in (("parent", found.parent), ("first_parent", found.first_parent)):
            table = table.append_column(name, pa.array((at + 1).astype(np.int32), mask=at < 0))
        for name in ("sub", "sub_n", "alt_score"):
            table = table.append_column(name, pa.array(getattr(found, name).astype(np.int32)))
        return table

    return ranked.groupBy("read_id").applyInArrow(run, f"{fields}, parent int, first_parent int, sub int, sub_n int, alt_score int")


def select_secondary(parented: DataFrame, best_n: int = BEST_N, ratio: float = PRI_RATIO, slack: int = 30) -> DataFrame:
    """Primaries, and each read's first ``best_n`` secondaries that score near their parents elsewhere."""
    p = parented.select("read_id", F.col("place").alias("parent"), F.col("score").alias("p_score"), F.struct("rid", "rs", "re", "qs", "qe").alias("p_at"))
    met = parented.join(p, ["read_id", "parent"])
    first = F.col("place") == F.col("parent")
    near = (F.col("score") >= F.col("p_score") * ratio) | (F.col("score") + slack >= F.col("p_score"))
    fits = near & (F.struct("rid", "rs", "re", "qs", "qe") != F.col("p_at"))
    order = Window.partitionBy("read_id", "s_fits").orderBy("place")
    placed = met.withColumn("s_fits", ~first & fits).withColumn("s_n", F.row_number().over(order))
    return placed.where(first | (F.col("s_fits") & (F.col("s_n") <= best_n))).drop("s_fits", "s_n", "p_score", "p_at")


def mapq_long(parented: DataFrame, rep_len: DataFrame | None = None, min_score: int = 40) -> DataFrame:
    """Add mapq (0 to 60) of chains without base alignments: how far a primary outscores what competes with it."""
    is_primary = F.col("place") == F.col("parent")
    rows = parented if rep_len is None else parented.join(rep_len, "read_id", "left")
    covered = F.coalesce(F.col("rep_len"), F.lit(0)) if rep_len is not None else F.lit(0)
    total = F.sum(F.when(is_primary, F.col("score")).otherwise(0)).over(Window.partitionBy("read_id"))
    unique = total / (total + covered)
    by_score = F.when(F.col("score") > 100, 1.0).otherwise(F.col("score") * 0.01) * unique
    by_count = F.least(by_score, F.when(F.col("cnt") > 10, 1.0).otherwise(F.col("cnt") * 0.1))
    second = F.greatest(F.col("subsc"), F.lit(min_score))
    raw = (by_count * 40.0 * (1 - second / F.col("score")) * F.log(F.col("score").cast("double"))).cast("int")
    less = raw - (4.343 * F.log((F.col("n_sub") + 1).cast("double")) + 0.499).cast("int")
    return rows.withColumn("mapq", F.when(is_primary, F.greatest(F.lit(0), F.least(less, F.lit(60)))).otherwise(0))


def pair_statistics(pairs: DataFrame, min_count: int = 10, min_ratio: float = 0.05) -> DataFrame:
    """Insert-size bounds of each orientation ``dir`` from (dir, size) of unique pairs, 0 < size <= 10000.

    Percentiles are read by rank from a histogram of sizes, which is bounded by the largest size; mean and
    deviation are those within two interquartile ranges, and the bounds are three, widened to four deviations.
    """
    good = pairs.where("size > 0 AND size <= 10000")
    counts = good.groupBy("dir", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("dir").orderBy("size"))
    total = F.sum("n").over(Window.partitionBy("dir"))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("total") + F.lit(0.499)), F.col("size")))
    quarters = ranked.groupBy("dir").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.sum("n").alias("n"))
    iqr = F.col("p75") - F.col("p25")
    inside = counts.join(quarters.drop("n"), "dir").where(
        (F.col("size") >= F.greatest(F.lit(1), F.col("p25") - 2 * iqr)) & (F.col("size") <= F.col("p75") + 2 * iqr)
    )
    moments = inside.groupBy("dir").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("avg"),
        F.sqrt(F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("size")) / F.sum("n"), F.lit(2))).alias("std"),
    )
    most = F.max("n").over(Window.partitionBy())
    joined = quarters.join(moments, "dir")
    low = F.least(F.floor(F.col("p25") - 3.0 * iqr + 0.499), F.floor(F.col("avg") - 4.0 * F.col("std") + 0.499))
    high = F.greatest(F.floor(F.col("p75") + 3.0 * iqr + 0.499), F.floor(F.col("avg") + 4.0 * F.col("std") + 0.499))
    failed = (F.col("n") < min_count) | (F.col("n") < most * min_ratio)
    return joined.select(
        "dir", "n", "p25", "p50", "p75", "avg", "std", F.greatest(low, F.lit(1)).cast("long").alias("low"), high.cast("long").alias("high"), failed.alias("failed")
    )


def pair_hits(left: DataFrame, right: DataFrame, max_gap: int) -> DataFrame:
    """The best pair of hits of each fragment's two reads: one sequence, opposite strands, ends near."""
    r = right.select(F.col("read_id"), "rid", *[F.col(k).alias(f"m_{k}") for k in ("rev", "rs", "re", "score")])
    met = left.join(r, ["read_id", "rid"]).where(F.col("rev") != F.col("m_rev"))
    gap = F.greatest("rs", "m_rs") - F.least("re", "m_re")
    fits = met.withColumn("gap", gap).where(F.col("gap") <= max_gap)
    total = F.col("score") + F.col("m_score")
    best = F.max_by(F.struct("rid", "rs", "re", "m_rs", "m_re", "gap", total.alias("total")), F.struct(total, -F.col("gap"), -F.col("rid"), -F.col("rs"), -F.col("m_rs")))
    return fits.groupBy("read_id").agg(best.alias("b")).select("read_id", "b.*")


def filter_hits(found: DataFrame, lengths: DataFrame, min_cnt: int = 3, min_mlen: int = 40, min_score: int = 80, max_clip: float = 1.0) -> DataFrame:
    """Hits of enough anchors, matched bases and score, not clipped at both ends by more than ``max_clip`` of the read."""
    met = found.join(lengths.select(F.col("rid").alias("read_id"), F.col("len").alias("f_len")), "read_id")
    clipped = (F.col("qs") > F.col("f_len") * max_clip) & (F.col("f_len") - F.col("qe") > F.col("f_len") * max_clip)
    enough = (F.col("cnt") >= min_cnt) & (F.col("mlen") >= min_mlen) & (F.col("score") >= min_score)
    return met.where(enough & ~clipped).drop("f_len")


def drop_secondary(parented: DataFrame, ratio: float = 0.5, every: bool = False) -> DataFrame:
    """Primaries and, with ``every``, secondaries of at least ``ratio`` of their parent's score."""
    p = parented.select("read_id", F.col("place").alias("parent"), F.col("score").alias("d_score"))
    first = F.col("place") == F.col("parent")
    near = F.col("score") >= F.col("d_score") * ratio
    return parented.join(p, ["read_id", "parent"]).where(first | (near if every else F.lit(False))).drop("d_score")


def two_best(found: DataFrame, near: float = 0.95) -> DataFrame:
    """(read_id, best, second, close): a read's two highest scores (second 0 for one hit) and whether they are close."""
    top = rank_hits(found).where("place <= 2").groupBy("read_id").agg(F.max("score").alias("best"), F.sum(F.when(F.col("place") == 2, F.col("score")).otherwise(0)).cast("int").alias("second"))
    return top.withColumn("close", F.col("second") >= F.col("best") * near)


def first_primary(parented: DataFrame) -> DataFrame:
    """Add sam_pri: whether a hit is the first primary of its read, whose record is not supplementary."""
    order = Window.partitionBy("read_id", "s_is").orderBy("place")
    marked = parented.withColumn("s_is", F.col("place") == F.col("parent"))
    return marked.withColumn("sam_pri", F.col("s_is") & (F.row_number().over(order) == 1)).drop("s_is")


def segment_counts(found: DataFrame, seg: Column) -> DataFrame:
    """(read_id, rid, rev, seg, cnt, score): a read's hits by segment."""
    return found.withColumn("seg", seg).groupBy("read_id", "rid", "rev", "seg").agg(F.sum("cnt").cast("int").alias("cnt"), F.sum("score").cast("int").alias("score"))
