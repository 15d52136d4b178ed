"""Alignment of a chain as one or several regions: split where the score falls, with the inversion between two parts.

A chain is aligned between its repaired anchors.  Where the path through a gap falls by more than the z-drop the
region ends at its best place, and the anchors beyond begin another region.  If the query's bases in the fall match the
target's on the other strand, what lies between the two regions is aligned there as a third.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.cigar import left_aligned, parse
from strandloom.functions.sequence import AMBIGUOUS, base_codes
from strandloom.operators.align import Scoring, _merge, _reverse, _turned, align_global, align_local, difference_string, edit_summary, extend
from strandloom.operators.repair import repair

#: Bits of ``split``: a region goes on in the next one; it goes on from the one before.
GOES_ON, COMES_ON = 1, 2


class Limits(NamedTuple):
    """Limits of splitting and inversions; fixed default values."""

    band: int = 500
    max_gap: int = 5000
    min_cnt: int = 3
    min_score: int = 40
    min_dp_score: int = 80
    zdrop_inv: int = 200
    min_gap: int = 200


class Region(NamedTuple):
    """An aligned region; places on the query count on the chain's strand, or on the other for an inversion."""

    q_start: int
    q_end: int
    t_start: int
    t_end: int
    score: int
    cigar: str
    split: int
    inv: bool
    first: int
    stop: int


class Fall(NamedTuple):
    """The deepest fall of a path: how deep, and the query and target places from its best so far to its end."""

    depth: int
    q_from: int
    q_to: int
    t_from: int
    t_to: int


def _events(q: np.ndarray, t: np.ndarray, cigar: str, s: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, query place and target place after each matched pair and each gap of a path."""
    gain, di, dj = [], [], []
    i = j = 0
    for n, op in parse(cigar):
        if op == "M":
            x, y = q[i : i + n], t[j : j + n]
            pair = np.where(x == y, s.match, -s.mismatch)
            gain.append(np.where((x >= AMBIGUOUS) | (y >= AMBIGUOUS), -s.ambiguous, pair))
            di.append(np.ones(n, np.int64))
            dj.append(np.ones(n, np.int64))
            i, j = i + n, j + n
        else:
            gain.append(np.array([-(s.gap_open + s.gap_extend * n)]))
            di.append(np.array([n if op == "I" else 0]))
            dj.append(np.array([0 if op == "I" else n]))
            i, j = (i + n, j) if op == "I" else (i, j + n)
    if not gain:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.cumsum(np.concatenate(x)) for x in (gain, di, dj))


def deepest_fall(q: np.ndarray, t: np.ndarray, cigar: str, s: Scoring = Scoring()) -> Fall:  # noqa: B008
    """The fall from a best score to a later lower one that is deepest once the gaps between both are forgiven."""
    score, i, j = (np.concatenate([[0], x]) for x in _events(q, t, cigar, s))
    top = np.maximum.accumulate(score)
    at = np.maximum.accumulate(np.where(score == top, np.arange(len(score)), 0))
    depth = top - score - s.gap_extend * np.abs((i - i[at]) - (j - j[at]))
    k = int(np.argmax(depth))
    return Fall(max(0, int(depth[k])), int(i[at[k]]), int(i[k]), int(j[at[k]]), int(j[k]))


def _until(cigar: str, fall: Fall) -> str:
    """The path up to where its fall begins, which is after a matched pair or a gap."""
    out, i, j = [], 0, 0
    for n, op in parse(cigar):
        if i >= fall.q_from and j >= fall.t_from:
            break
        n = min(n, fall.q_from - i) if op == "M" else n
        out.append(f"{n}{op}")
        i, j = i + (n if op in "MI" else 0), j + (n if op in "MD" else 0)
    return "".join(out)


def inverted_inside(q: np.ndarray, t: np.ndarray, fall: Fall, s: Scoring, limits: Limits) -> bool:
    """Whether the fall's query bases match its target bases on the other strand well enough."""
    long = max(fall.q_to - fall.q_from, fall.t_to - fall.t_from)
    if fall.depth <= min(limits.zdrop_inv, s.zdrop) or long >= limits.max_gap:
        return False
    found = align_local(_turned(q[fall.q_from : fall.q_to]), t[fall.t_from : fall.t_to], s)
    return found.score >= max(limits.min_score * s.match, limits.min_dp_score)


def _begin(q: np.ndarray, t: np.ndarray, at: tuple[int, int], s: Scoring, limits: Limits) -> tuple[str, int, int]:
    """CIGAR of the extension to the left of a cut, and where it begins on both; at most ``max_gap`` bases."""
    a, b = at
    low_q = max(0, a - limits.max_gap)
    low_t = max(0, b - min(limits.max_gap, (a - low_q) * (1 + s.match // s.gap_extend)))
    left = extend(q[low_q:a][::-1], t[low_t:b][::-1], s, limits.band)
    return _reverse(left.cigar), a - left.q_end, b - left.t_end


def _one(q, t, points, span: int, first: int, after_inversion: bool, s: Scoring, limits: Limits):
    """(region, next anchor or None, whether an inversion may follow) of the chain's anchors from ``first`` on."""
    pq, pt, spans = (x[first:] for x in points)
    matched = int(spans[0] + np.minimum(spans[1:], np.minimum(np.diff(pq), np.diff(pt))).sum())
    fixed = repair(pq, pt, spans, matched, limits.band, 2 * limits.min_score, limits.max_gap)
    own = [k for k in range(fixed.first, fixed.stop) if not fixed.skipped[k] or k == fixed.stop - 1]
    half = span // 2
    cut = (int(pq[own[0]]) - half, int(pt[own[0]]) - half)
    lead, q_start, t_start = _begin(q, t, cut, s._replace(zdrop=min(limits.zdrop_inv, s.zdrop)) if after_inversion else s, limits)
    parts = [lead]
    for k in own[1:]:
        to = (int(pq[k]) - half, int(pt[k]) - half)
        dq, dt = to[0] - cut[0], to[1] - cut[1]
        if dq <= 0 or dt <= 0 or not (k == own[-1] or fixed.joins[k] or min(dq, dt) >= limits.min_gap):
            continue
        x, y = q[cut[0] : to[0]], t[cut[1] : to[1]]
        if len(x) == len(y) and (x == y).all():
            parts.append(f"{len(x)}M")
            cut = to
            continue
        cigar = align_global(x, y, s, limits.band).cigar
        fall = deepest_fall(x, y, cigar, s)
        inverted = inverted_inside(x, y, fall, s, limits)
        if inverted or fall.depth > s.zdrop:
            ended = extend(x, y, s._replace(zdrop=min(limits.zdrop_inv, s.zdrop)) if inverted else s, limits.band)
            # An extension from the last cut need not drop where the whole path falls: a gap from its beginning is forgiven.
            piece, dq, dt = (ended.cigar, ended.q_end, ended.t_end) if ended.zdropped else (_until(cigar, fall), fall.q_from, fall.t_from)
            stop = (cut[0] + dq, cut[1] + dt)
            reached = np.flatnonzero(pt[:k] < stop[1])
            following = first + (int(reached[-1]) + 1 if len(reached) else 1)
            region = _region(q, t, (q_start, t_start), stop, [*parts, piece], s, first, following)
            return region, following if len(points[0]) - following >= limits.min_cnt else None, inverted
        parts.append(cigar)
        cut = to
    right = extend(q[cut[0] : cut[0] + limits.max_gap], t[cut[1] :], s, limits.band)
    stop = (cut[0] + right.q_end, cut[1] + right.t_end)
    return _region(q, t, (q_start, t_start), stop, [*parts, right.cigar], s, first, len(points[0])), None, False


def _region(q, t, begin: tuple[int, int], stop: tuple[int, int], parts: list[str], s: Scoring, first: int, after: int, inv: bool = False) -> Region:
    x, y = q[begin[0] : stop[0]], t[begin[1] : stop[1]]
    cigar, q_off, t_off = left_aligned(_merge("".join(parts)), x, y)
    score = _events(x[q_off:], y[t_off:], cigar, s)[0]
    return Region(begin[0] + q_off, stop[0], begin[1] + t_off, stop[1], int(score[-1]) if len(score) else 0, cigar, 0, inv, first, after)


def invert_between(q: np.ndarray, t: np.ndarray, a: Region, b: Region, s: Scoring, limits: Limits) -> Region | None:
    """The alignment, on the other strand, of what lies between two regions; None if it is too short, too long or too bad."""
    n_q, n_t = b.q_start - a.q_end, b.t_start - a.t_end
    if not (limits.min_score <= n_q <= limits.max_gap and limits.min_score <= n_t <= limits.max_gap):
        return None
    x, y = _turned(q[a.q_end : b.q_start]), t[a.t_end : b.t_start]
    found = align_local(x, y, s)
    if found.score < limits.min_dp_score:
        return None
    x, y = x[found.q_start :], y[found.t_start :]
    best = extend(x, y, s, int(limits.band * 1.5))
    if not best.cigar:
        return None
    shift = len(q) - b.q_start + found.q_start  # where x begins on the turned query
    low = a.t_end + found.t_start
    return _region(_turned(q), t, (shift, low), (shift + best.q_end, low + best.t_end), [best.cigar], s, a.first, a.first, True)


def align_regions(
    q: np.ndarray, t: np.ndarray, points: tuple[np.ndarray, np.ndarray, np.ndarray], span: int, s: Scoring = Scoring(), limits: Limits = Limits()  # noqa: B008
) -> list[Region]:
    """All regions of a chain in order, each inversion after the two that it lies between.

    ``points`` are the anchors' last bases on query and target, and their spans, in order.
    """
    out: list[Region] = []
    first, inverted, before = 0, False, None
    while first is not None:
        region, following, next_inverted = _one(q, t, points, span, first, inverted, s, limits)
        split = (GOES_ON if following is not None else 0) | (COMES_ON if before is not None else 0)
        region = region._replace(split=split)
        out.append(region)
        if inverted and before is not None:
            found = invert_between(q, t, before, region, s, limits)
            out.extend([found] if found else [])
        before, first, inverted = region, following, next_inverted
    return out


def ambiguous_bases(q: np.ndarray, t: np.ndarray, cigar: str) -> int:
    """Matched pairs with an ambiguous base, and ambiguous bases in gaps."""
    count = i = j = 0
    for n, op in parse(cigar):
        x, y = q[i : i + n] >= AMBIGUOUS, t[j : j + n] >= AMBIGUOUS
        count += int((x | y).sum() if op == "M" else x.sum() if op == "I" else y.sum())
        i, j = i + (n if op in "MI" else 0), j + (n if op in "MD" else 0)
    return count


def peak_score(q: np.ndarray, t: np.ndarray, cigar: str, s: Scoring = Scoring()) -> float:  # noqa: B008
    """The best score of any stretch of the path where a gap of n costs gap_open and log2(n + 1), not its length."""
    flat = s._replace(gap_extend=0)
    lengths = [n for n, op in parse(cigar) if op != "M"]
    score, i, j = _events(q, t, cigar, flat)
    if not len(score):
        return 0.0
    gain = np.diff(np.concatenate([[0.0], score.astype(float)]))
    in_gap = (np.diff(np.concatenate([[0], i])) == 0) | (np.diff(np.concatenate([[0], j])) == 0)
    gain[in_gap] = -(s.gap_open + np.log2(1.0 + np.array(lengths, float)))
    upto = np.concatenate([[0.0], np.cumsum(gain)])
    return float((upto - np.minimum.accumulate(upto)).max())


_SCHEMA = (
    "piece int, inv boolean, split int, q_start int, q_end int, t_start int, t_end int, score int, cigar string, nm int, md string, "
    "matches int, columns int, n_ambi int, dp_max double, anchors int, cs string"
)


def aligned_regions(df: DataFrame, key: tuple[str, ...], span: int, scoring: Scoring = Scoring(), limits: Limits = Limits(), alphabet: str = "text") -> DataFrame:  # noqa: B008
    """Regions of rows (key, q, t, rev, points): the whole query, a window of the target, the chain's points in both.

    ``points`` are structs (q, t, span) in order, counted on the chain's strand; with ``rev`` the query is turned.  A row
    gives at least one region and is aligned by itself; null texts and no points give none.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.bool_(), *[pa.int32()] * 6, pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, pa.float64(), pa.int32(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            columns = (batch.column(len(key) + k).to_pylist() for k in range(4))
            for r, (q, t, rev, points) in enumerate(zip(*columns, strict=True)):
                if not q or not t or not points:
                    continue
                x, y = base_codes(q, alphabet), base_codes(t, alphabet)
                x = _turned(x) if rev else x
                at = tuple(np.array([p[k] for p in points], np.int64) for k in ("q", "t", "span"))
                for n, region in enumerate(align_regions(x, y, at, span, scoring, limits)):
                    own = _turned(x) if region.inv else x
                    a, b = own[region.q_start : region.q_end], y[region.t_start : region.t_end]
                    edits = edit_summary(a, b, region.cigar)[1:]
                    extra = ambiguous_bases(a, b, region.cigar), peak_score(a, b, region.cigar, scoring), region.stop - region.first, difference_string(a, b, region.cigar)
                    owner.append(r)
                    rows.append((n, region.inv, region.split, *region[:4], region.score, region.cigar, *edits, *extra))
            values = list(zip(*rows, strict=True)) or [()] * len(names)
            taken = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(taken) for k in range(len(key))), *(pa.array(v, kind) for v, kind in zip(values, kinds, strict=True))],
                [*key, *names],
            )

    return df.select(*[F.col(k) for k in key], "q", "t", "rev", "points").mapInArrow(emit, f"{fields}, {_SCHEMA}")
