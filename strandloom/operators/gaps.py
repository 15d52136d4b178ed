"""Alignment with two gap states a direction: long gaps at a second price, or introns between splice sites.

As in ``align`` a row of the matrix is computed at a time; a gap in the row is a running maximum once its cost is made
linear in the column.  A cell has seven bits: where its best score comes from, and for each gap state whether it goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMBIGUOUS, base_codes
from strandloom.operators.align import _LOW, Alignment, _part, _turned, edit_summary, run_length


class TwoGaps(NamedTuple):
    """A gap of n bases costs the lesser of gap_open + n gap_extend and gap_open2 + n gap_extend2."""

    match: int = 2
    mismatch: int = 4
    gap_open: int = 4
    gap_extend: int = 2
    gap_open2: int = 24
    gap_extend2: int = 1
    ambiguous: int = 1
    zdrop: int = 400
    end_bonus: int = 0


class Splice(NamedTuple):
    """Scores of spliced alignment: an intron costs ``intron`` and ``noncanonical`` for each end without a splice site.

    With ``flanks`` a site whose flanking base isn't the usual one costs half of that.  A known junction's ends gain
    ``junction`` each.  Fixed default values.
    """

    match: int = 1
    mismatch: int = 2
    gap_open: int = 2
    gap_extend: int = 1
    intron: int = 32
    noncanonical: int = 9
    junction: int = 9
    flanks: bool = True
    ambiguous: int = 1


class _Row(NamedTuple):
    low: int
    best: np.ndarray
    bits: np.ndarray


#: Sources of a cell: match, deletion, insertion, and the second states; the bits of states that go on come above.
_MATCH, _DEL, _INS, _DEL2, _INS2 = range(5)
_ON = {_DEL: 8, _INS: 16, _DEL2: 32, _INS2: 64}


def _pairs(q: int, t: np.ndarray, s: TwoGaps | Splice) -> np.ndarray:
    scores = np.where(t == q, s.match, -s.mismatch)
    return np.where((t >= AMBIGUOUS) | (q >= AMBIGUOUS), -s.ambiguous, scores)


def _across(value: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best of all earlier ``value`` less ``cost``, whether it is from before the column just to the left)."""
    lead = np.maximum.accumulate(value)
    out, on = np.full(len(value), _LOW), np.zeros(len(value), bool)
    out[1:] = lead[:-1] - cost[1:]
    on[2:] = lead[1:-1] > value[1:-1]
    return out, on


def _rows(q: np.ndarray, t: np.ndarray, s: TwoGaps | Splice, band: int | None = None, sites: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[_Row]:
    """Rows 0 to len(q) from the beginning of both; ``sites`` are the costs of an intron's begin and end at each column."""
    m, spliced = len(t), sites is not None
    width = m if band is None else band
    open2, extend2 = (s.intron, 0) if spliced else (s.gap_open2, s.gap_extend2)
    low, best, down, down2 = 0, np.zeros(1, np.int64), np.full(1, _LOW), np.full(1, _LOW)
    for i in range(len(q) + 1):
        begin, stop = max(0, i - width) if band is not None else 0, min(m, i + width) + 1 if band is not None else m + 1
        if begin >= stop:
            return
        at = np.arange(begin, stop)
        if i:
            above = _part(best, low, begin - 1, stop)
            opened, going = above[1:] - s.gap_open, _part(down, low, begin, stop)
            opened2, going2 = above[1:] - open2, _part(down2, low, begin, stop)
            down, on = np.maximum(opened, going) - s.gap_extend, going > opened
            # An insertion has the second price only where that is a gap's, not an intron's.
            down2, on2 = (np.full(len(at), _LOW), np.zeros(len(at), bool)) if spliced else (np.maximum(opened2, going2) - extend2, going2 > opened2)
            diagonal = above[:-1].copy()
            if not begin:
                diagonal[0] = _LOW
            diagonal[begin == 0 :] += _pairs(int(q[i - 1]), t[max(0, begin - 1) : stop - 1], s)
            reached = np.maximum(np.maximum(diagonal, down), down2)
        else:
            diagonal = np.full(len(at), _LOW)
            diagonal[0] = 0
            reached, down, down2 = diagonal, np.full(len(at), _LOW), np.full(len(at), _LOW)
            on = on2 = np.zeros(len(at), bool)
        low = begin
        cost = s.gap_open + s.gap_extend * at
        across, goes = _across(reached + s.gap_extend * at, cost)
        if spliced:
            # An intron may follow a deletion, and a deletion an intron.
            start, end = sites[0][begin:stop], sites[1][begin:stop]
            across2, goes2 = _across(np.maximum(reached, across) - start, open2 + end)
            across, goes = _across(np.maximum(reached, across2) + s.gap_extend * at, cost)
        else:
            across2, goes2 = _across(reached + extend2 * at, open2 + extend2 * at)
        best = np.maximum(np.maximum(reached, across), across2)
        source = np.select([best == diagonal, best == down, best == across, best == down2], [_MATCH, _INS, _DEL, _INS2], _DEL2)
        bits = source.astype(np.uint8)
        for flag, state in ((goes, _DEL), (on, _INS), (goes2, _DEL2), (on2, _INS2)):
            bits |= np.where(flag, _ON[state], 0).astype(np.uint8)
        yield _Row(low, best, bits)


def _trace(rows: list[tuple[int, np.ndarray]], i: int, j: int, second: str) -> str:
    """CIGAR of the path that ends at row i and column j; ``second`` is the operation of the second deletion."""
    ops: list[str] = []
    state = _MATCH
    while i > 0 or j > 0:
        low, row = rows[i]
        bits = int(row[j - low])
        if state == _MATCH:
            state = bits & 7
            if state == _MATCH:
                ops.append("M")
                i, j = i - 1, j - 1
                continue
        goes_on = bits & _ON[state]
        if state in (_INS, _INS2):
            ops.append("I")
            i -= 1
        else:
            ops.append("D" if state == _DEL else second)
            j -= 1
        state = state if goes_on else _MATCH
    return run_length("".join(reversed(ops)))


def align_two_gaps(q: np.ndarray, t: np.ndarray, s: TwoGaps = TwoGaps(), band: int | None = None) -> Alignment:  # noqa: B008
    """Best alignment of the whole of both, within ``band`` of the diagonal or as far as their lengths differ."""
    rows, row = [], None
    for row in _rows(q, t, s, None if band is None else max(band, abs(len(q) - len(t)))):
        rows.append((row.low, row.bits))
    return Alignment(int(row.best[-1]), len(q), len(t), _trace(rows, len(q), len(t), "D"))


def extend_two_gaps(q: np.ndarray, t: np.ndarray, s: TwoGaps = TwoGaps(), band: int | None = None) -> Alignment:  # noqa: B008
    """As ``align.extend``: from the beginning of both to the best end, or the query's; gaps are forgiven at the second price."""
    rows: list[tuple[int, np.ndarray]] = []
    top, top_i, top_j, dropped, end_score, end_j = 0, 0, 0, False, _LOW, 0
    for i, row in enumerate(_rows(q, t, s, band)):
        rows.append((row.low, row.bits))
        j = int(row.best.argmax())
        score, j = int(row.best[j]), j + row.low
        if i == len(q):
            end_score, end_j = score, j
        if score > top:
            top, top_i, top_j = score, i, j
        elif top - score > s.zdrop + s.gap_extend2 * abs((i - top_i) - (j - top_j)):
            dropped = True
            break
    if not dropped and len(q) and end_score + s.end_bonus >= top:
        return Alignment(end_score, len(q), end_j, _trace(rows, len(q), end_j, "D"))
    return Alignment(top, top_i, top_j, _trace(rows, top_i, top_j, "D"), dropped)


def splice_sites(t: np.ndarray, s: Splice, forward: bool = True, known: tuple[tuple[int, int], ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Costs of an intron that begins, and that ends, before each base of the target (and at its end).

    A transcript of the target's strand has introns GT..AG, one of the other strand CT..AC; the usual flanks are a purine
    after GT and CT and a pyrimidine before AG and AC.  ``known`` are introns (start, end) of the transcript's strand.
    """
    a, c, g, u = range(4)
    base = np.concatenate([[AMBIGUOUS] * 3, t, [AMBIGUOUS] * 3]).astype(np.int64)
    at = np.arange(len(t) + 1) + 3
    donor = (base[at] == (g if forward else c)) & (base[at + 1] == u)
    acceptor = (base[at - 2] == a) & (base[at - 1] == (g if forward else c))
    usual_after, usual_before = np.isin(base[at + 2], (a, g)), np.isin(base[at - 3], (c, u))
    half = s.noncanonical // 2 if s.flanks else 0
    costs = []
    for site, usual in ((donor, usual_after), (acceptor, usual_before)):
        costs.append(np.where(site, np.where(usual, 0, half), s.noncanonical).astype(np.int64))
    for cost, places in zip(costs, zip(*known, strict=True) if known else ((), ()), strict=True):
        inside = [p for p in set(places) if 0 <= p <= len(t)]
        cost[inside] -= s.junction
    return costs[0], costs[1]


class Spliced(NamedTuple):
    score: int
    cigar: str
    forward: bool


def align_spliced(q: np.ndarray, t: np.ndarray, s: Splice = Splice(), known: tuple[tuple[int, int, bool], ...] = ()) -> Spliced:  # noqa: B008
    """Best alignment of the whole of both with introns as N, for a transcript of either strand; the target's of equals.

    ``known`` are introns (start, end, of the target's strand).
    """
    best = None
    for forward in (True, False):
        own = tuple((a, b) for a, b, strand in known if strand == forward)
        rows, row = [], None
        for row in _rows(q, t, s, sites=splice_sites(t, s, forward, own)):
            rows.append((row.low, row.bits))
        if best is None or row.best[-1] > best[0]:
            best = int(row.best[-1]), rows, forward
    return Spliced(best[0], _trace(best[1], len(q), len(t), "N"), best[2])


_RESULT = "score int, q_end int, t_end int, cigar string, forward boolean, nm int, md string, matches int, columns int"


def align_fragments_by(
    df: DataFrame, key: tuple[str, ...], mode: str, scoring: TwoGaps | Splice, q: str = "q", t: str = "t", alphabet: str = "dna",
    turned: str | None = None, known: str | None = None, band: int | None = None,
) -> DataFrame:
    """Align the fragments (key, q, t) where they are; ``mode`` is global, extend or spliced.

    ``known`` names an array of structs (st, en, forward), introns in ``t``.  Null texts are empty; queries whose column
    ``turned`` holds are reversed and complemented.  A fragment needs a byte for each cell of its band, or of its matrix.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def one(x: np.ndarray, y: np.ndarray, sites) -> tuple:
        if mode == "spliced":
            found = align_spliced(x, y, scoring, tuple((p["st"], p["en"], p["forward"]) for p in sites or ()))
            return found.score, len(x), len(y), found.cigar, found.forward
        found = (align_two_gaps if mode == "global" else extend_two_gaps)(x, y, scoring, band)
        return found.score, found.q_end, found.t_end, found.cigar, True

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, turn, sites in zip(*(batch.column(len(key) + i).to_pylist() for i in range(4)), strict=True):
                x, y = base_codes(a or "", alphabet), base_codes(b or "", alphabet)
                x = _turned(x) if turn else x
                found = one(x, y, sites)
                rows.append((*found, *edit_summary(x, y, found[3])[1:]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*key, *names])

    if mode not in ("global", "extend", "spliced"):
        raise ValueError(f"unknown mode {mode!r}")
    turn = F.coalesce(F.col(turned), F.lit(False)) if turned else F.lit(False)
    sites = F.col(known) if known else F.lit(None).cast("array<struct<st:int,en:int,forward:boolean>>")
    return df.select(*[F.col(k) for k in key], F.col(q), F.col(t), turn.alias("a_turn"), sites.alias("a_known")).mapInArrow(emit, f"{fields}, {_RESULT}")
