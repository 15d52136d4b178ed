"""Intervals: positions to sequences, BED features and low-complexity stretches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMBIGUOUS, base_codes

#: Positions of a bin of the equi-joins that stand for range joins.
BIN = 4096


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """(rid, len, start): running offsets in order of rid.

    Lengths are summed by ranges of rid first, so the ordered sums run over a row for each range and then
    within ranges, never over all contigs in one task.
    """
    width = 1024
    parts = contigs.select("rid", "len", F.floor(F.col("rid") / width).alias("part"))
    sums = parts.groupBy("part").agg(F.sum("len").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(begin, "part").select(
        "rid", "len", (F.col("begin") + F.coalesce(F.sum("len").over(inner), F.lit(0))).cast("long").alias("start")
    )


def locate(points: DataFrame, contigs: DataFrame, at: str = "at") -> DataFrame:
    """``points`` with the contig (rid) that holds position ``at`` of the concatenation, and the place in it.

    Contigs are dealt to every bin they touch and points to their own, so the range join is an equi-join.
    """
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("start") + F.col("len") - 1) / BIN))
    held = contigs.where("len > 0").select("rid", "start", (F.col("start") + F.col("len")).alias("stop"), F.explode(bins).alias("bin"))
    asked = points.withColumn("bin", F.floor(F.col(at) / BIN))
    met = asked.join(held, "bin").where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop")))
    return met.withColumn("place", F.col(at) - F.col("start")).drop("bin", "start", "stop")


def bed_blocks(lines: DataFrame) -> DataFrame:
    """(name, chrom, st, en, strand) of the blocks of BED12 rows, or of whole rows without blocks."""
    sizes, starts = (F.filter(F.split(F.col(c), ","), lambda x: x != "") for c in ("block_sizes", "block_starts"))
    zipped = F.when(F.col("block_sizes").isNotNull(), F.arrays_zip(sizes.alias("n"), starts.alias("s")))
    whole = F.array(F.struct((F.col("en") - F.col("st")).cast("string").alias("n"), F.lit("0").alias("s")))
    part = lines.withColumn("b", F.explode(F.coalesce(zipped, whole)))
    begin = F.col("st") + F.col("b.s").cast("int")
    return part.select("name", "chrom", begin.alias("st"), (begin + F.col("b.n").cast("int")).alias("en"), "strand")


def introns(blocks: DataFrame) -> DataFrame:
    """Gaps between the consecutive blocks of one transcript."""
    order = Window.partitionBy("name", "chrom").orderBy("st", "en")
    nexts = blocks.withColumn("following", F.lead("st").over(order))
    return nexts.where("following > en").select("name", "chrom", F.col("en").alias("st"), F.col("following").alias("en"), "strand")


def inside(intervals: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs (window_id, st, en) of intervals that lie wholly within a window (rid, w_st, w_en)."""
    dealt = windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("w_st") / BIN), F.floor((F.col("w_en") - 1) / BIN))))
    asked = intervals.withColumn("bin", F.floor(F.col("st") / BIN))
    return asked.join(dealt, ["rid", "bin"]).where("st >= w_st AND en <= w_en").select("window_id", "rid", "st", "en")


def low_complexity(codes: np.ndarray, window: int = 64, threshold: int = 20) -> list[tuple[int, int]]:
    """Half-open stretches of repetitive triplets: the perfect intervals of the symmetric DUST score.

    A stretch of l triplets scores the sum of c(c-1)/2 over its triplet counts, divided by l - 1; perfect ones
    score above threshold / 10 and no part of them scores more.  Perfect intervals within a window join up.
    """
    out: list[list[int]] = []
    triplets: deque[int] = deque()
    perfect: list[tuple[int, int, int, int]] = []  # start, end, score, triplets - 1, by start descending
    run = value = 0
    for i, c in enumerate([*codes.tolist(), AMBIGUOUS]):
        if c >= AMBIGUOUS:
            for s, e, _, _ in sorted(perfect):
                _join(out, s, e)
            triplets.clear()
            perfect, run, value = [], 0, 0
            continue
        run, value = run + 1, (value << 2 | c) & 63
        if run < 3:
            continue
        begin = max(0, run - window) + (i + 1 - run)
        for s, e, _, _ in [p for p in perfect if p[0] < begin]:
            _join(out, s, e)
        perfect = [p for p in perfect if p[0] >= begin]
        triplets.append(value)
        if len(triplets) > window - 2:
            triplets.popleft()
        counts: dict[int, int] = {}
        total = best = 0
        best_n = 1
        for back, t in enumerate(reversed(triplets)):
            total += counts.get(t, 0)
            counts[t] = counts.get(t, 0) + 1
            if back == 0 or total * 10 <= threshold * back:
                continue
            start = i - 2 - back
            for p in perfect:
                if p[0] >= start and p[2] * best_n > best * p[3]:
                    best, best_n = p[2], p[3]
            if total * best_n >= best * back:
                best, best_n = total, back
                perfect.append((start, i + 1, total, back))
    return [(s, e) for s, e in out]


def _join(out: list[list[int]], start: int, end: int) -> None:
    if out and start <= out[-1][1]:
        out[-1][0], out[-1][1] = min(out[-1][0], start), max(out[-1][1], end)
    else:
        out.append([start, end])


def mask_low_complexity(df: DataFrame, key: str, text: str = "text", window: int = 64, threshold: int = 20, alphabet: str = "text") -> DataFrame:
    """(rid, st, en): low-complexity stretches of whole sequences."""
    kind = df.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (rid, s, e)
                for rid, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for s, e in low_complexity(base_codes(value.as_py() or "", alphabet), window, threshold)
            ]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                ["rid", "st", "en"],
            )

    return df.select(F.col(key).alias("rid"), text).mapInArrow(emit, f"rid {kind}, st int, en int")


def drop_masked(minimizers: DataFrame, masks: DataFrame) -> DataFrame:
    """Minimizers of which at most half the span lies in masked stretches (rid, st, en, disjoint)."""
    m = masks.withColumnRenamed("rid", "m_rid").withColumn("bin", F.explode(F.sequence(F.floor(F.col("st") / BIN), F.floor(F.col("en") / BIN))))
    k = minimizers.withColumn("k_s", F.col("pos") + 1 - F.col("span")).withColumn("k_e", F.col("pos") + 1)
    asked = k.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("k_s") / BIN), F.floor(F.col("pos") / BIN)))))
    met = asked.join(m, (F.col("rid") == F.col("m_rid")) & (asked["bin"] == m["bin"])).where("st < k_e AND en > k_s")
    shared = met.select("rid", "pos", "hash", "span", "st", "en", (F.least("en", "k_e") - F.greatest("st", "k_s")).alias("n")).distinct()
    lost = shared.groupBy("rid", "pos", "hash", "span").agg(F.sum("n").alias("n")).where(F.col("n") * 2 > F.col("span"))
    return minimizers.join(lost.select("rid", "pos"), ["rid", "pos"], "left_anti")
