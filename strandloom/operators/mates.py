"""Mates: the orientation and size of pairs, windows in which a missing mate is expected, and its alignment there.

A pair's direction is seen from one read's strand: 0 and 3 are mates on the same strand, further on and before; 1 and 2
on the other strand, further on and before.  Its size is the distance of the reads' first bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import base_codes
from strandloom.operators.align import Scoring, _turned, align_local

#: Bases that a rescued mate must match, and how far below a read's best hit others still lead to mates.
MIN_SEED, UNPAIRED = 19, 17


def first_base(rev: Column, start: Column, end: Column) -> Column:
    """Where a read's first base lies on the reference."""
    return F.when(rev, end - 1).otherwise(start)


def pair_geometry(rev: Column, at: Column, mate_rev: Column, mate_at: Column) -> tuple[Column, Column]:
    """(direction, size) of a pair of reads whose first bases are at these places of one sequence."""
    ahead = F.when(rev, at - mate_at).otherwise(mate_at - at)
    same = rev == mate_rev
    direction = F.when(same & (ahead > 0), 0).when(~same & (ahead > 0), 1).when(same, 3).otherwise(2)
    return direction, F.abs(ahead)


def unique_pairs(left: DataFrame, right: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(dir, size) of the fragments whose two reads' best hits lie on one sequence, no other hit scoring near them."""

    def best(hits: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy("read_id").orderBy(F.desc("score"), "rid", "rev", "rs", "qs")
        ranked = hits.withColumn("u_second", F.lead("score", 1, 0).over(order)).withColumn("u_place", F.row_number().over(order))
        one = ranked.where((F.col("u_place") == 1) & (F.col("u_second") <= F.col("score") * ratio))
        return one.select("read_id", "rid", F.col("rev").alias(f"{side}_rev"), first_base(F.col("rev"), F.col("rs"), F.col("re")).alias(f"{side}_at"))

    met = best(left, "a").join(best(right, "b"), ["read_id", "rid"])
    direction, size = pair_geometry(F.col("a_rev"), F.col("a_at"), F.col("b_rev"), F.col("b_at"))
    return met.select(direction.alias("dir"), size.alias("size"))


def rescue_windows(hits: DataFrame, mates: DataFrame, mate_lengths: DataFrame, bounds: DataFrame, slack: int = UNPAIRED) -> DataFrame:
    """Windows (read_id, dir, a_rid, a_rev, a_at, rid, m_rev, w_from, w_len, len) in which a mate may lie.

    Every hit within ``slack`` of its read's best asks for its mate in each direction whose bounds didn't fail, unless a
    hit of the mate lies there already.  ``bounds`` is ``pair_statistics``: at most a row for each of four directions.
    """
    top = hits.groupBy("read_id").agg(F.max("score").alias("a_top"))
    placed = hits.join(top, "read_id").where(F.col("score") + slack >= F.col("a_top"))
    anchors = placed.select("read_id", "rid", F.col("rev").alias("a_rev"), first_base(F.col("rev"), F.col("rs"), F.col("re")).alias("a_at")).distinct()
    usable = F.broadcast(bounds.where(~F.col("failed")).select("dir", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))
    asked = anchors.withColumn("dir", F.explode(F.array(*map(F.lit, range(4))))).join(usable, "dir")
    known = mates.select("read_id", "rid", F.col("rev").alias("b_rev"), first_base(F.col("rev"), F.col("rs"), F.col("re")).alias("b_at")).distinct()
    direction, size = pair_geometry(F.col("a_rev"), F.col("a_at"), F.col("b_rev"), F.col("b_at"))
    key = ["read_id", "rid", "a_rev", "a_at", "dir"]
    found = asked.join(known, ["read_id", "rid"]).where((direction == F.col("dir")) & size.between(F.col("low"), F.col("high"))).select(*key).distinct()
    missing = asked.join(found, key, "left_anti").join(mate_lengths.select(F.col("rid").alias("read_id"), "len"), "read_id")
    other, further = F.col("dir").isin(1, 2), F.col("dir").isin(0, 1)
    # From the read's first base on its strand, half-open; a mate on the same strand begins within the bounds, one on
    # the other strand ends there.
    near = F.when(further, F.col("low")).otherwise(-F.col("high")) - F.when(other, F.col("len")).otherwise(0)
    far = F.when(further, F.col("high")).otherwise(-F.col("low")) + F.when(other, 0).otherwise(F.col("len"))
    begin = F.when(F.col("a_rev"), F.col("a_at") + 1 - far).otherwise(F.col("a_at") + near)
    stop = F.when(F.col("a_rev"), F.col("a_at") + 1 - near).otherwise(F.col("a_at") + far)
    held = F.greatest(begin, F.lit(0))
    spans = missing.select(*key, "len", (F.col("a_rev") != other).alias("m_rev"), held.alias("w_from"), (stop - held).alias("w_len"))
    return spans.where(F.col("w_len") >= MIN_SEED)


_RESCUED = "rev boolean, qs int, qe int, rs int, re int, score int, second int"


def rescue(windows: DataFrame, scoring: Scoring = Scoring(1, 4, 6, 1), min_seed: int = MIN_SEED, alphabet: str = "dna", strand: str = "m_rev") -> DataFrame:  # noqa: B008
    """Local alignments of mates in their windows: (read_id, rid, dir, rev, qs, qe, rs, re, score, second), one row a place.

    ``windows`` are those of ``rescue_windows`` with ``t``, the reference's bases, and ``q``, the mate's.  A mate must
    score as ``min_seed`` matched bases do.  Places found from several hits are one row, its best.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            columns = (batch.column(k).to_pylist() for k in range(3, 7))
            for r, (rev, low, q, t) in enumerate(zip(*columns, strict=True)):
                if not q or not t or len(t) < min_seed:
                    continue
                x, y = base_codes(q, alphabet), base_codes(t, alphabet)
                found = align_local(_turned(x) if rev else x, y, scoring)
                if found.score < min_seed * scoring.match:
                    continue
                begin, stop = (len(x) - found.q_end, len(x) - found.q_start) if rev else (found.q_start, found.q_end)
                owner.append(r)
                rows.append((rev, begin, stop, low + found.t_start, low + found.t_end, found.score, found.second))
            values = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.bool_(), *[pa.int32()] * 6]
            taken = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(taken) for k in range(3)), *(pa.array(v, kind) for v, kind in zip(values, kinds, strict=True))],
                ["read_id", "rid", "dir", "rev", "qs", "qe", "rs", "re", "score", "second"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    fields = ", ".join(f"{k} {kinds[k]}" for k in ("read_id", "rid", "dir"))
    found = windows.select("read_id", "rid", "dir", strand, "w_from", "q", "t").mapInArrow(emit, f"{fields}, {_RESCUED}")
    best = F.max_by(F.struct("dir", "second"), F.struct("score", -F.col("dir")))
    return found.groupBy("read_id", "rid", "rev", "qs", "qe", "rs", "re").agg(F.max("score").alias("score"), best.alias("b")).select(
        "read_id", "rid", "b.dir", "rev", "qs", "qe", "rs", "re", "score", "b.second"
    )
