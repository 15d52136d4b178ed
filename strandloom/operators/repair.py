"""Repair of chains before alignment: ends that hang by a gap, and stretches between gaps that cancel each other.

Positions are those of a chain's anchors in order, ``q`` on the query and ``t`` on the target.  A step's gap is how much
further it goes on the query than on the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default limits.
CANCEL_GAP, CANCEL_SUM, CANCEL_GAPS, CLOSE_GAP = 10, 40, 10, 30


class Repair(NamedTuple):
    """Which anchors stay: those of ``first`` to before ``stop`` that aren't ``skipped``; ``joins`` ends a bridged stretch."""

    first: int
    stop: int
    skipped: np.ndarray
    joins: np.ndarray


def trimmed_ends(q: np.ndarray, t: np.ndarray, span: np.ndarray, matched: int, band: int, min_match: int) -> tuple[int, int]:
    """(first, stop) of the anchors that stay.

    From either end the chain is walked until it is long (twice the band), has matched enough, or half of what the whole
    chain has.  An end before a step whose gap exceeds half of the length walked so far goes.
    """
    n = len(q)
    if n < 3:
        return 0, n
    dq, dt = np.diff(q), np.diff(t)
    less, gap, gain = np.minimum(dq, dt), np.abs(dq - dt), np.minimum(np.minimum(dq, dt), span[1:])

    def walk(steps: np.ndarray, begun: int) -> int:
        """Steps to cut off, from the end where ``steps`` begin."""
        walked = begun + np.concatenate([[0], np.cumsum(less[steps])])
        gained = begun + np.cumsum(gain[steps])
        ends = (walked[1:] >= 2 * band) | ((gained >= min_match) & (gained >= band)) | (gained >= matched // 2)
        last = int(np.argmax(ends)) + 1 if ends.any() else len(steps)
        loose = np.flatnonzero(gap[steps[:last]] > walked[:last] // 2)
        return int(loose[-1]) + 1 if len(loose) else 0

    first = walk(np.arange(n - 2), int(span[0]))
    back = np.arange(n - 2, first - 1, -1)
    return first, n - walk(back, int(span[-1]))


def _long_gaps(q: np.ndarray, t: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors before which a step has a gap of more than ``least``, and these gaps."""
    gaps = np.diff(q) - np.diff(t)
    at = np.flatnonzero(np.abs(gaps) > least)
    return at + 1, gaps[at]


def cancelling_gaps(q: np.ndarray, t: np.ndarray, max_ext: int, least: int = CANCEL_GAP, total: int = CANCEL_SUM, most: int = CANCEL_GAPS) -> np.ndarray:
    """Anchors to skip: those between two long gaps among which as much is inserted as deleted, more than ``total`` in sum.

    Of overlapping stretches the one where most cancels is taken, the first of equals.
    """
    skipped = np.zeros(len(q), bool)
    at, gaps = _long_gaps(q, t, least)
    n = len(at)
    if n < 2:
        return skipped
    inserted = np.concatenate([[0], np.cumsum(np.maximum(gaps, 0))])
    deleted = np.concatenate([[0], np.cumsum(np.maximum(-gaps, 0))])
    best, begin, end = 0, -1, -1  # the stretch from gap ``begin`` to gap ``end``

    def close() -> None:
        if end > 0:
            skipped[at[begin] : at[end]] = True

    for k in range(n):
        if k >= end:
            close()
            best, begin, end = 0, -1, -1
        later = np.arange(k + 1, min(n, k + 1 + most))
        far = (q[at[later]] - q[at[k] - 1] > max_ext) | (t[at[later]] - t[at[k] - 1] > max_ext)
        later = later[: int(np.argmax(far))] if far.any() else later
        if not len(later):
            continue
        cancels = 2 * np.minimum(inserted[later + 1] - inserted[k], deleted[later + 1] - deleted[k])
        top = int(np.argmax(cancels))
        if cancels[top] > max(total, best):
            best, begin, end = int(cancels[top]), k, int(later[top])
    close()
    return skipped


def close_gaps(q: np.ndarray, t: np.ndarray, span: np.ndarray, max_ext: int, least: int = CLOSE_GAP) -> tuple[np.ndarray, np.ndarray]:
    """(skipped, joins): anchors between long gaps that lie no further apart than both gaps are long, and where such a run ends."""
    skipped, joins = np.zeros(len(q), bool), np.zeros(len(q), bool)
    at, gaps = _long_gaps(q, t, least)
    sizes = np.abs(gaps)
    k = 0
    while k < len(at):
        run = k
        while run + 1 < len(at):
            here, following = at[run], at[run + 1]
            if q[following] - q[here] > max_ext or t[following] - t[here] > max_ext:
                break
            # Between the two gaps: from the anchor after the one to the end of the anchor before the other.
            between = min(t[following - 1] - t[here], q[following - 1] - q[here]) + span[following - 1]
            if between > sizes[run] + sizes[run + 1]:
                break
            run += 1
        if run > k:
            skipped[at[k] : at[run]] = True
            joins[at[run]] = True
        k = run + 1
    return skipped, joins


def repair(q: np.ndarray, t: np.ndarray, span: np.ndarray, matched: int, band: int, min_match: int, max_gap: int) -> Repair:
    """Ends trimmed, then what lies between cancelling or close gaps of the rest skipped."""
    first, stop = trimmed_ends(q, t, span, matched, band, min_match)
    inner = slice(first, stop)
    skipped, joins = np.zeros(len(q), bool), np.zeros(len(q), bool)
    close, joins[inner] = close_gaps(q[inner], t[inner], span[inner], max_gap // 2)
    skipped[inner] = cancelling_gaps(q[inner], t[inner], max_gap // 2) | close
    return Repair(first, stop, skipped, joins)


def repaired(df: DataFrame, key: tuple[str, ...], band: int = 500, min_score: int = 40, max_gap: int = 5000) -> DataFrame:
    """Rows (key, mlen, points) with ``points`` as repaired, and how many anchors were trimmed, skipped and end a join.

    ``points`` are a chain's anchors (q, t, span) in order.  Chains of fewer than three anchors stay as they are.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("q", "t", "span")]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for matched, points in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True):
                q, t, span = (np.array([p[k] for p in points or ()], np.int64) for k in ("q", "t", "span"))
                fixed = repair(q, t, span, matched or 0, band, 2 * min_score, max_gap)
                kept.append([p for k, p in enumerate(points or ()) if fixed.first <= k < fixed.stop and not fixed.skipped[k]])
                counts.append((len(q) - (fixed.stop - fixed.first), int(fixed.skipped.sum()), int(fixed.joins.sum())))
            columns = list(zip(*counts, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(key)], pa.array(kept, kind), *(pa.array(c, pa.int32()) for c in columns)], [*key, "points", "trimmed", "skipped", "joins"]
            )

    schema = f"{fields}, points array<struct<q:int,t:int,span:int>>, trimmed int, skipped int, joins int"
    return df.select(*[F.col(k) for k in key], "mlen", "points").mapInArrow(emit, schema)
