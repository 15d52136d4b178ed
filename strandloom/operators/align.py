"""Pairwise alignment with affine gaps, a row of the matrix at a time in numpy.

Every kernel works on one (query, target) fragment of base codes; Spark deals the fragments to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMBIGUOUS, base_codes

_LOW = -(1 << 40)


class Scoring(NamedTuple):
    match: int = 2
    mismatch: int = 4
    gap_open: int = 4
    gap_extend: int = 2
    ambiguous: int = 1
    zdrop: int = 400
    end_bonus: int = 0

    def row(self, q: int, target: np.ndarray) -> np.ndarray:
        scores = np.where(target == q, self.match, -self.mismatch)
        return np.where((target >= AMBIGUOUS) | (q >= AMBIGUOUS), -self.ambiguous, scores)


class Alignment(NamedTuple):
    score: int
    q_end: int
    t_end: int
    cigar: str
    zdropped: bool = False


class _Row(NamedTuple):
    """One row of the matrix: its first column, best scores and directions."""

    low: int
    best: np.ndarray
    bits: np.ndarray


def _part(values: np.ndarray, low: int, begin: int, stop: int) -> np.ndarray:
    """Columns ``begin`` to ``stop`` of a row that starts at column ``low``; those outside it can't be reached."""
    out = np.full(stop - begin, _LOW)
    a, b = max(begin, low), min(stop, low + len(values))
    if a < b:
        out[a - begin : b - begin] = values[a - low : b - low]
    return out


def _rows(q: np.ndarray, t: np.ndarray, s: Scoring, floor: int | None = None, band: int | None = None) -> Iterator[_Row]:
    """Rows 0 to len(q): directions have bits 0-1 match/deletion/insertion, 4 and 8 gaps that go on.

    A deletion skips target bases and an insertion query bases; ``floor`` 0 makes the alignment local.  Within ``band``
    only columns so far from the row are computed and kept.
    """
    m = len(t)
    width = m if band is None else band
    low, stop = 0, min(m, width) + 1
    at = np.arange(stop)
    best = -(s.gap_open + s.gap_extend * at)
    best[0] = 0
    if floor is not None:
        best = np.full(stop, floor)
    down = np.full(stop, _LOW)
    first = np.full(stop, 1 | 4, np.uint8)
    first[:2] = (0, 1)[:stop]
    yield _Row(0, best, first)
    for i in range(1, len(q) + 1):
        begin, stop = max(0, i - width) if band is not None else 0, (min(m, i + width) if band is not None else m) + 1
        if begin >= stop:
            return
        above, before = _part(best, low, begin - 1, stop), _part(down, low, begin, stop)
        low, at = begin, np.arange(begin, stop)
        opened, going = above[1:] - s.gap_open - s.gap_extend, before - s.gap_extend
        down = np.maximum(opened, going)
        diagonal = above[:-1].copy()
        if not begin:
            diagonal[0] = _LOW
        diagonal[begin == 0 :] += s.row(int(q[i - 1]), t[max(0, begin - 1) : stop - 1])
        reached = np.maximum(diagonal, down)
        if floor is not None:
            reached = np.maximum(reached, floor)
        # The best horizontal gap is a running maximum once its cost is made linear in the column.
        lead = np.maximum.accumulate(reached + s.gap_extend * at)
        across = np.full(len(at), _LOW)
        across[1:] = lead[:-1] - s.gap_open - s.gap_extend * at[1:]
        best = np.maximum(reached, across)
        bits = np.where(best == diagonal, 0, np.where(best == down, 2, 1)).astype(np.uint8)
        bits |= np.where(going > opened, 8, 0).astype(np.uint8)
        from_gap = np.zeros(len(at), bool)
        from_gap[2:] = across[2:] != best_open(reached, s)[2:]
        bits |= np.where(from_gap, 4, 0).astype(np.uint8)
        yield _Row(low, best, bits)


def best_open(reached: np.ndarray, s: Scoring) -> np.ndarray:
    """Score of a horizontal gap opened just before each column."""
    out = np.full(len(reached), _LOW)
    out[1:] = reached[:-1] - s.gap_open - s.gap_extend
    return out


def _trace(directions: list[tuple[int, np.ndarray]], i: int, j: int) -> str:
    """CIGAR of the path that ends at row i and column j."""
    ops: list[str] = []
    state = "M"
    while i > 0 or j > 0:
        low, row = directions[i]
        bits = int(row[j - low])
        if state == "M":
            kind = bits & 3
            if kind == 0:
                ops.append("M")
                i, j = i - 1, j - 1
                continue
            state = "I" if kind == 2 else "D"
        if state == "I":
            ops.append("I")
            state = "I" if bits & 8 else "M"
            i -= 1
        else:
            ops.append("D")
            state = "D" if bits & 4 else "M"
            j -= 1
    return run_length("".join(reversed(ops)))


def run_length(ops: str) -> str:
    """CIGAR of single operations."""
    if not ops:
        return ""
    codes = np.frombuffer(ops.encode(), np.uint8)
    cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    lengths = np.diff(np.concatenate([cut, [len(codes)]]))
    return "".join(f"{n}{ops[k]}" for n, k in zip(lengths, cut, strict=True))


def align_global(q: np.ndarray, t: np.ndarray, s: Scoring = Scoring(), band: int | None = None) -> Alignment:  # noqa: B008
    """Best alignment of the whole of both, within ``band`` of the diagonal or as far as their lengths differ."""
    directions, row = [], None
    for row in _rows(q, t, s, band=None if band is None else max(band, abs(len(q) - len(t)))):
        directions.append((row.low, row.bits))
    return Alignment(int(row.best[-1]), len(q), len(t), _trace(directions, len(q), len(t)))


def extend(q: np.ndarray, t: np.ndarray, s: Scoring = Scoring(), band: int | None = None) -> Alignment:  # noqa: B008
    """Best alignment that starts at the beginning of both; it may end anywhere, within ``band`` of the diagonal.

    Rows stop when the score has fallen by more than the z-drop below the best, gaps between the two places
    forgiven.  Reaching the query's end is preferred if its score with the end bonus is not below the best.
    """
    directions: list[tuple[int, np.ndarray]] = []
    top, top_i, top_j, dropped = 0, 0, 0, False
    end_score, end_j = _LOW, 0
    for i, row in enumerate(_rows(q, t, s, band=band)):
        directions.append((row.low, row.bits))
        j = int(row.best.argmax())
        score, j = int(row.best[j]), j + row.low
        if i == len(q):
            end_score, end_j = score, j
        if score > top:
            top, top_i, top_j = score, i, j
        elif top - score > s.zdrop + s.gap_extend * abs((i - top_i) - (j - top_j)):
            dropped = True
            break
    if not dropped and end_score + s.end_bonus >= top and len(q):
        return Alignment(end_score, len(q), end_j, _trace(directions, len(q), end_j))
    return Alignment(top, top_i, top_j, _trace(directions, top_i, top_j), dropped)


def local_score(q: np.ndarray, t: np.ndarray, s: Scoring = Scoring()) -> int:  # noqa: B008
    """Best score of any part of one with any part of the other."""
    return max((int(row.best.max()) for row in _rows(q, t, s, floor=0)), default=0)


#: Cells of the rows of the matrices that are computed together.
TOGETHER = 1 << 15


def local_scores(pairs: list[tuple[np.ndarray, np.ndarray]], s: Scoring = Scoring()) -> np.ndarray:  # noqa: B008
    """``local_score`` of many short pairs (q, t), a row of many matrices at a time, the longest first."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])), reverse=True)
    while order:
        count = max(1, TOGETHER // (len(pairs[order[0]][1]) + 1))
        some, order = order[:count], order[count:]
        height, width = (max(len(pairs[k][side]) for k in some) for side in (0, 1))
        # Beyond an end nothing matches, so the best of a matrix stays within it.
        q, t = np.full((height, len(some)), _PAD, np.uint8), np.full((len(some), width), _PAD, np.uint8)
        for row, k in enumerate(some):
            q[: len(pairs[k][0]), row], t[row, : len(pairs[k][1])] = pairs[k]
        unlike = np.where(t == _PAD, _FAR, np.where(t >= AMBIGUOUS, -s.ambiguous, -s.mismatch)).astype(np.int32)
        slope = (s.gap_extend * np.arange(width + 1)).astype(np.int32)
        best, down, top = np.zeros((len(some), width + 1), np.int32), np.full((len(some), width + 1), _FAR, np.int32), np.zeros(len(some), np.int32)
        for codes in q:
            code = codes[:, None]
            gain = np.where((t == code) & (code < AMBIGUOUS), np.int32(s.match), unlike)
            if codes.max() >= AMBIGUOUS:
                gain = np.where(code == _PAD, _FAR, np.where((code >= AMBIGUOUS) & (t != _PAD), np.int32(-s.ambiguous), gain))
            down = np.maximum(best - (s.gap_open + s.gap_extend), down - s.gap_extend)
            reached = np.maximum(down, 0)
            np.maximum(reached[:, 1:], best[:, :-1] + gain, out=reached[:, 1:])
            lead = np.maximum.accumulate(reached + slope, axis=1)
            best = reached
            np.maximum(best[:, 1:], lead[:, :-1] - s.gap_open - slope[1:], out=best[:, 1:])
            np.maximum(top, best.max(axis=1), out=top)
        out[some] = top
    return out


_PAD, _FAR = 255, np.int32(-(1 << 28))


class Local(NamedTuple):
    """Score and half-open ends of a local alignment, and the best score that ends elsewhere on the target."""

    score: int
    q_start: int
    q_end: int
    t_start: int
    t_end: int
    second: int


def align_local(q: np.ndarray, t: np.ndarray, s: Scoring = Scoring()) -> Local:  # noqa: B008
    """Best alignment of any part of one with any part of the other: ends first, starts by a pass over the parts before them reversed.

    Of equal scores the first row's first column ends it.  The second score is the best that ends further from that
    column than the best score's matches are long.
    """
    top, i, j = 0, 0, 0
    columns = np.zeros(len(t) + 1, np.int64)
    for k, row in enumerate(_rows(q, t, s, floor=0)):
        best = int(row.best.max())
        if best > top:
            top, i, j = best, k, row.low + int(row.best.argmax())
        part = columns[row.low : row.low + len(row.best)]
        np.maximum(part, row.best, out=part)
    if not top:
        return Local(0, 0, 0, 0, 0, 0)
    near = -(-top // s.match)
    elsewhere = np.concatenate([columns[: max(0, j - near)], columns[j + near + 1 :]])
    x, y = q[:i][::-1], t[:j][::-1]
    for k, row in enumerate(_rows(x, y, s)):
        if (row.best == top).any():
            a, b = k, row.low + int((row.best == top).argmax())
            break
    return Local(top, i - a, i, j - b, j, int(elsewhere.max(initial=0)))


def edit_summary(q: np.ndarray, t: np.ndarray, cigar: str) -> tuple[str, int, str, int, int]:
    """(CIGAR with = and X, NM, MD, matches, columns) of an alignment of q and t from their beginnings.

    An intron (N) is no edit and no column.
    """
    from strandloom.functions.cigar import parse

    i = j = nm = same = columns = run = 0
    ops, md = [], ""
    for n, op in parse(cigar):
        if op == "M":
            equal = q[i : i + n] == t[j : j + n]
            ops.append("".join("=" if x else "X" for x in equal))
            for k, x in enumerate(equal):
                if x:
                    run += 1
                else:
                    md, run = f"{md}{run}{'ACGTN'[min(int(t[j + k]), 4)]}", 0
            same += int(equal.sum())
            nm += n - int(equal.sum())
            i, j = i + n, j + n
        elif op == "N":
            ops.append(op * n)
            j += n
            continue
        else:
            ops.append(op * n)
            nm += n
            if op == "D":
                md, run = f"{md}{run}^{''.join('ACGTN'[min(int(x), 4)] for x in t[j : j + n])}", 0
                j += n
            else:
                i += n
        columns += n
    return run_length("".join(ops)), nm, f"{md}{run}", same, columns


def difference_string(q: np.ndarray, t: np.ndarray, cigar: str) -> str:
    """cs tag of an alignment of q and t from their beginnings: :n equal bases, *ab a base of t for one of q, +q inserted,
    -t deleted bases, ~ an intron with its first and last two bases."""
    from strandloom.functions.cigar import parse

    letters = np.frombuffer(b"acgtn", np.uint8)
    told = lambda codes: letters[np.minimum(codes, 4)].tobytes().decode()
    out, i, j, equal = [], 0, 0, 0

    def close() -> None:
        nonlocal equal
        if equal:
            out.append(f":{equal}")
        equal = 0

    for n, op in parse(cigar):
        if op == "M":
            x, y = q[i : i + n], t[j : j + n]
            before = -1
            for k in np.flatnonzero(x != y).tolist():
                equal += k - before - 1
                close()
                out.append(f"*{told(y[k : k + 1])}{told(x[k : k + 1])}")
                before = k
            equal += n - before - 1
            i, j = i + n, j + n
            continue
        close()
        if op == "I":
            out.append(f"+{told(q[i : i + n])}")
            i += n
        else:
            out.append(f"-{told(t[j : j + n])}" if op == "D" else f"~{told(t[j : j + 2])}{n}{told(t[j + n - 2 : j + n])}")
            j += n
    close()
    return "".join(out)


_RESULT = "score int, q_end int, t_end int, cigar string, zdropped boolean, eqx string, nm int, md string, matches int, columns int"


def align_fragments(df: DataFrame, key: tuple[str, ...], q: str = "q", t: str = "t", mode: str = "global", scoring: Scoring = Scoring(), alphabet: str = "text", turned: str | None = None, band: int | None = None) -> DataFrame:  # noqa: B008
    """Align the fragments (key, q, t) where they are; ``mode`` is global or extend.

    Within ``band`` a fragment needs memory of its query's length times the band.  Queries whose column ``turned`` holds are reversed and complemented.  The cost of a fragment is len(q) * len(t); deal them out evenly before if they differ much.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    run = {"global": align_global, "extend": extend}[mode]
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, turn in zip(*(batch.column(len(key) + i).to_pylist() for i in range(3)), strict=True):
                x, y = base_codes(a or "", alphabet), base_codes(b or "", alphabet)
                found = run(x := _turned(x) if turn else x, y, scoring, band)
                rows.append((*found, *edit_summary(x, y, found.cigar)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(key)], *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [*key, *names]
            )

    turn = F.coalesce(F.col(turned), F.lit(False)) if turned else F.lit(False)
    return df.select(*[F.col(k) for k in key], q, t, turn.alias("a_turn")).mapInArrow(emit, f"{fields}, {_RESULT}")


def _turned(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < AMBIGUOUS, 3 - codes, codes)[::-1].astype(np.uint8)


def path_scores(q: np.ndarray, t: np.ndarray, cigar: str, s: Scoring = Scoring()) -> tuple[int, int]:  # noqa: B008
    """(score of the path, its deepest fall): the fall is from a best so far to a later place, gaps between the
    two places forgiven as in ``extend``."""
    from strandloom.functions.cigar import parse

    score = i = j = 0
    top, top_i, top_j, fall = 0, 0, 0, 0
    for n, op in parse(cigar):
        if op == "M":
            for k in range(n):
                score += int(s.row(int(q[i + k]), t[j + k : j + k + 1])[0])
                if score > top:
                    top, top_i, top_j = score, i + k + 1, j + k + 1
                else:
                    fall = max(fall, top - score - s.gap_extend * abs((i + k + 1 - top_i) - (j + k + 1 - top_j)))
            i, j = i + n, j + n
        else:
            score -= s.gap_open + s.gap_extend * n
            i, j = (i + n, j) if op == "I" else (i, j + n)
            fall = max(fall, top - score - s.gap_extend * abs((i - top_i) - (j - top_j)))
    return score, fall


class ChainAlignment(NamedTuple):
    score: int
    q_start: int
    q_end: int
    t_start: int
    t_end: int
    cigar: str
    zdropped: bool


def align_chain(q: np.ndarray, t: np.ndarray, points: list[tuple[int, int]], span: int, s: Scoring = Scoring(), min_gap: int = 200, band: int | None = None) -> ChainAlignment:  # noqa: B008
    """Alignment through a chain: extension left of its first anchor, gaps filled between anchors, extension right.

    ``points`` are the last bases (query, target) of the anchors in order.  Cuts lie at the middle of an
    anchor; anchors nearer than ``min_gap`` to the last cut, or not beyond it on both sides, are passed over.  The
    flag tells that a gap's path falls by more than the z-drop, which asks for an exact second look.
    """
    half = span // 2
    cuts = [(points[0][0] - half, points[0][1] - half)]
    for k, (a, b) in enumerate(points[1:], 1):
        dq, dt = a - half - cuts[-1][0], b - half - cuts[-1][1]
        if dq > 0 and dt > 0 and (min(dq, dt) >= min_gap or k == len(points) - 1):
            cuts.append((a - half, b - half))
    (qa, ta), (qz, tz) = cuts[0], cuts[-1]
    left = extend(q[:qa][::-1], t[:ta][::-1], s, band)
    parts, dropped = [_reverse(left.cigar)], left.zdropped
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        x, y = q[a:c], t[b:d]
        same = len(x) == len(y) and bool((x == y).all())
        cigar = f"{len(x)}M" if same else align_global(x, y, s, band).cigar
        dropped |= not same and path_scores(x, y, cigar, s)[1] > s.zdrop
        parts.append(cigar)
    right = extend(q[qz:], t[tz:], s, band)
    cigar = _merge("".join([*parts, right.cigar]))
    begin, stop = (qa - left.q_end, ta - left.t_end), (qz + right.q_end, tz + right.t_end)
    score = path_scores(q[begin[0] : stop[0]], t[begin[1] : stop[1]], cigar, s)[0]
    return ChainAlignment(score, begin[0], stop[0], begin[1], stop[1], cigar, dropped or right.zdropped)


def _reverse(cigar: str) -> str:
    from strandloom.functions.cigar import parse

    return "".join(f"{n}{op}" for n, op in reversed(parse(cigar)))


def _merge(cigar: str) -> str:
    from strandloom.functions.cigar import parse

    out: list[list] = []
    for n, op in parse(cigar):
        if out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


_CHAINED = "score int, q_start int, q_end int, t_start int, t_end int, cigar string, zdropped boolean, nm int, md string, matches int, columns int"


def align_chained(df: DataFrame, key: tuple[str, ...], span: int, scoring: Scoring = Scoring(), alphabet: str = "text", band: int | None = None) -> DataFrame:  # noqa: B008
    """Align rows (key, q, t, rev, points): whole query, a window of the target, the chain's points in both.

    On the reverse strand the query is complemented, as the points are counted there.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    names = [x.split()[0] for x in _CHAINED.split(", ")]
    kinds = [*[pa.int32()] * 5, pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, t, rev, points in zip(*(batch.column(len(key) + k).to_pylist() for k in range(4)), strict=True):
                x, y = base_codes(q, alphabet), base_codes(t, alphabet)
                if rev:
                    x = _turned(x)
                found = align_chain(x, y, [(p["q"], p["t"]) for p in points], span, scoring, band=band)
                edits = edit_summary(x[found.q_start : found.q_end], y[found.t_start : found.t_end], found.cigar)
                rows.append((*found, *edits[1:]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(key)], *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [*key, *names]
            )

    return df.select(*[F.col(k) for k in key], "q", "t", "rev", "points").mapInArrow(emit, f"{fields}, {_CHAINED}")


_LOCAL = "score int, q_start int, q_end int, t_start int, t_end int, second int, cigar string, nm int, md string"


def align_parts(df: DataFrame, key: tuple[str, ...], scoring: Scoring = Scoring(), alphabet: str = "dna", turned: str = "rev") -> DataFrame:  # noqa: B008
    """Best local alignment of rows (key, q, t, turned), with its CIGAR; on the reverse strand the query is turned.

    Places count on the hit's strand and in ``t``.  Null texts and those without a matching base have no row.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    names = [x.split()[0] for x in _LOCAL.split(", ")]
    kinds = [*[pa.int32()] * 6, pa.string(), pa.int32(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for r, (a, b, turn) in enumerate(zip(*(batch.column(len(key) + k).to_pylist() for k in range(3)), strict=True)):
                x, y = base_codes(a or "", alphabet), base_codes(b or "", alphabet)
                x = _turned(x) if turn else x
                found = align_local(x, y, scoring)
                if not found.score:
                    continue
                own, other = x[found.q_start : found.q_end], y[found.t_start : found.t_end]
                cigar = align_global(own, other, scoring).cigar
                owner.append(r)
                rows.append((*found, cigar, *edit_summary(own, other, cigar)[1:3]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            taken = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(taken) for k in range(len(key))), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [*key, *names]
            )

    return df.select(*[F.col(k) for k in key], "q", "t", turned).mapInArrow(emit, f"{fields}, {_LOCAL}")
