"""Chaining anchors into collinear chains.

``islands`` is chaining without gaps as window functions.  The order-dependent chainings run over Arrow batches of sorted
anchors, one read, sequence and strand after the other; most of these have few anchors, so a task holds one at a time.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.shared import Workspace

#: Default limits and penalties.
MAX_GAP, MIN_CNT, MIN_SCORE = 5000, 3, 40
BAND, MAX_SKIP, MAX_ITER, GAP_PENALTY = 500, 25, 5000, 0.12


def islands(anchors: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Chains of anchors on one diagonal with steps of at most ``max_gap``, before any threshold.

    (read_id, rid, rev, diag, island, cnt, score, mlen, blen, span, first_r, last_r, first_q, last_q).
    """
    line = Window.partitionBy("read_id", "rid", "rev", "diag").orderBy("rpos")
    stepped = anchors.withColumn("diag", F.col("rpos") - F.col("qpos")).withColumn("step", F.col("rpos") - F.lag("rpos").over(line))
    opened = stepped.withColumn("island", F.sum(F.when(F.col("step") <= max_gap, 0).otherwise(1)).over(line))
    gained = F.when(F.col("step") <= max_gap, F.least(F.col("span"), F.col("step"))).otherwise(F.col("span"))
    length = F.when(F.col("step") <= max_gap, F.col("step")).otherwise(F.col("span"))
    return (
        opened.withColumn("gained", gained)
        .withColumn("length", length)
        .groupBy("read_id", "rid", "rev", "diag", "island")
        .agg(
            F.count("*").cast("int").alias("cnt"),
            F.sum("gained").cast("int").alias("score"),
            F.sum("gained").cast("int").alias("mlen"),
            F.sum("length").cast("int").alias("blen"),
            F.max("span").alias("span"),
            F.min("rpos").alias("first_r"),
            F.max("rpos").alias("last_r"),
            F.min("qpos").alias("first_q"),
            F.max("qpos").alias("last_q"),
        )
    )


def regions(chains: DataFrame, lengths: DataFrame, min_cnt: int = MIN_CNT, min_score: int = MIN_SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chains of enough anchors and score as half-open regions of read and reference, with the columns ``keep``."""
    turned = chains.where((F.col("cnt") >= min_cnt) & (F.col("score") >= min_score)).join(
        lengths.select(F.col("rid").alias("read_id"), "len"), "read_id"
    )
    start, end = F.col("first_q") + 1 - F.col("span"), F.col("last_q") + 1
    return turned.select(
        "read_id",
        "rid",
        "rev",
        F.when(F.col("rev"), F.col("len") - end).otherwise(start).cast("int").alias("qs"),
        F.when(F.col("rev"), F.col("len") - start).otherwise(end).cast("int").alias("qe"),
        F.greatest(F.lit(0), F.col("first_r") + 1 - F.col("span")).cast("int").alias("rs"),
        (F.col("last_r") + 1).cast("int").alias("re"),
        "score",
        "cnt",
        "mlen",
        "blen",
        *keep,
    )


def ranges(anchors: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Stretches of a read's anchors on one sequence and strand whose steps are at most ``max_gap``."""
    line = Window.partitionBy("read_id", "rid", "rev").orderBy("rpos", "qpos")
    stepped = anchors.withColumn("step", F.col("rpos") - F.lag("rpos").over(line))
    opened = stepped.withColumn("part", F.sum(F.when(F.col("step") <= max_gap, 0).otherwise(1)).over(line))
    return opened.groupBy("read_id", "rid", "rev", "part").agg(
        F.count("*").alias("n"), F.min("rpos").alias("first_r"), F.max("rpos").alias("last_r")
    )


def longest_stretch(anchors: DataFrame) -> DataFrame:
    """(read_id, rid, rev, first_r, last_r, cnt, bases): of each read's anchors on one sequence and strand, the
    stretch on one diagonal, with steps of at most a span, that covers most bases; the first of equals."""
    line = Window.partitionBy("read_id", "rid", "rev", "diag").orderBy("rpos")
    stepped = anchors.withColumn("diag", F.col("rpos") - F.col("qpos")).withColumn("step", F.col("rpos") - F.lag("rpos").over(line))
    opened = stepped.withColumn("part", F.sum(F.when(F.col("step") <= F.col("span"), 0).otherwise(1)).over(line))
    found = opened.groupBy("read_id", "rid", "rev", "diag", "part").agg(
        F.min("rpos").alias("first_r"), F.max("rpos").alias("last_r"), F.count("*").cast("int").alias("cnt"), (F.max("rpos") - F.min("rpos") + F.max("span")).alias("bases")
    )
    best = F.max_by(F.struct("first_r", "last_r", "cnt", "bases"), F.struct("bases", -F.col("first_r"), -F.col("diag")))
    return found.groupBy("read_id", "rid", "rev").agg(best.alias("b")).select("read_id", "rid", "rev", "b.*")


def fast_log2(x: np.ndarray) -> np.ndarray:
    """log2 of numbers of at least 2, from the exponent and a quadratic in the mantissa, in float32."""
    bits = x.astype(np.float32).view(np.uint32)
    exponent = ((bits >> np.uint32(23)) & np.uint32(255)).astype(np.float32) - np.float32(128)
    mantissa = ((bits & np.uint32(0x007FFFFF)) | np.uint32(0x3F800000)).view(np.float32)
    return exponent + (np.float32(-0.34484843) * mantissa + np.float32(2.02466578)) * mantissa - np.float32(0.67487759)


def link_scores(dr: np.ndarray, dq: np.ndarray, span: np.ndarray, gap: float = GAP_PENALTY) -> np.ndarray:
    """Gain of following an anchor of ``span`` after steps dr and dq: matched bases less the gap's cost."""
    dd, dg = np.abs(dr - dq), np.minimum(dr, dq)
    cost = np.float32(gap) * dd.astype(np.float32)
    long = dd >= 1
    cost[long] += np.float32(0.5) * fast_log2(dd[long] + 1)
    gain = np.minimum(span, dg)
    paid = (dd > 0) | (dg > span)
    return gain - np.where(paid, cost.astype(np.int32), 0)


def chain_scores(
    rpos: np.ndarray, qpos: np.ndarray, span: np.ndarray, band: int = BAND, max_gap: int = MAX_GAP, max_skip: int = MAX_SKIP, max_iter: int = MAX_ITER
) -> tuple[np.ndarray, np.ndarray]:
    """Best chain score ending at each anchor, in order of rpos, and its predecessor (-1: none).

    Predecessors are tried from the nearest; a later one must be strictly better, and after ``max_skip`` that
    already precede a tried one and bring nothing the search ends.
    """
    n = len(rpos)
    best, parent, seen = span.astype(np.int64).copy(), np.full(n, -1), np.full(n, -1)
    low = np.searchsorted(rpos, rpos - max(max_gap, band), side="left")
    for i in range(n):
        first = max(int(low[i]), i - max_iter)
        if first >= i:
            continue
        j = np.arange(i - 1, first - 1, -1)
        dr, dq = rpos[i] - rpos[j], qpos[i] - qpos[j]
        fits = (dq > 0) & (dq <= max(max_gap, band)) & (dr != 0) & (np.abs(dr - dq) <= band)
        j = j[fits]
        if not len(j):
            continue
        total = best[j] + link_scores(dr[fits], dq[fits], span[j])
        skipped = 0
        for at, score in zip(j.tolist(), total.tolist(), strict=True):
            if score > best[i]:
                best[i], parent[i] = score, at
                skipped = max(0, skipped - 1)
            elif seen[at] == i:
                skipped += 1
                if skipped > max_skip:
                    break
            if parent[at] >= 0:
                seen[parent[at]] = i
    return best, parent


class _BestOf:
    """Places 0 to n - 1 with a priority each, and the best of a range of them; equal ones go by their number."""

    def __init__(self, n: int):
        self._size = 1 << max(0, (n - 1).bit_length())
        self._value, self._item = [-np.inf] * (2 * self._size), [-1] * (2 * self._size)

    def put(self, place: int, value: float, item: int) -> None:
        """Set a place; a value of minus infinity empties it."""
        v, items, k = self._value, self._item, place + self._size
        v[k], items[k] = value, item
        while k > 1:
            k >>= 1
            a = 2 * k
            b = a + 1
            if v[b] > v[a] or (v[b] == v[a] and items[b] < items[a]):
                a = b
            if v[k] == v[a] and items[k] == items[a]:
                return
            v[k], items[k] = v[a], items[a]

    def best(self, start: int, stop: int) -> int:
        """The number of the best in places start to stop, -1 if they are empty."""
        v, items = self._value, self._item
        top, found = -np.inf, -1
        a, b = start + self._size, stop + self._size
        while a < b:
            for k in (a,) * (a & 1) + (b - 1,) * (b & 1):
                if v[k] > top or (v[k] == top and v[k] > -np.inf and items[k] < found):
                    top, found = v[k], items[k]
            a, b = (a + 1) >> 1, b >> 1
        return found


@cache
def _gap_costs(band: int, gap: float) -> list[int]:
    """Costs of gaps of 0 to ``band``."""
    costs = np.zeros(band + 1, np.float32)
    costs[1:] = np.float32(gap) * np.arange(1, band + 1).astype(np.float32) + np.float32(0.5) * fast_log2(np.arange(2, band + 2))
    return costs.astype(np.int32).tolist()


def range_scores(
    rpos: np.ndarray, qpos: np.ndarray, span: np.ndarray, band: int = 20000, max_gap: int = MAX_GAP, gap: float = GAP_PENALTY, inner: int = 0, max_skip: int = MAX_SKIP
) -> tuple[np.ndarray, np.ndarray]:
    """Chain scores where the predecessor is the in-range anchor of greatest priority, best + gap * (r + q) / 2.

    The anchors in range of rpos are held in a tree by qpos, so that a predecessor costs the logarithm of their number.
    With ``inner``, unless that predecessor goes on without a gap, all those within ``inner`` of both positions are tried
    too, from the nearest on the query; after ``max_skip`` that already precede a tried one and bring nothing this ends.
    """
    n = len(rpos)
    best, parent = span.astype(np.int64).tolist(), [-1] * n
    order = np.lexsort((np.arange(n), qpos))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    by_q = qpos[order]
    first = np.searchsorted(by_q, qpos - max_gap, side="right").tolist()
    stop = np.searchsorted(by_q, qpos, side="left").tolist()
    costs = _gap_costs(band, gap)
    low = np.searchsorted(rpos, rpos - max_gap, side="left").tolist()
    before = np.searchsorted(rpos, rpos, side="left").tolist()
    near = np.searchsorted(rpos, rpos - inner, side="left").tolist()
    r, q, s, rank, at_rank = (x.tolist() for x in (rpos, qpos, span, rank, order))
    tree, entered, left, left_near = _BestOf(n), 0, 0, 0
    close: list[int] = []  # ranks of the anchors within ``inner``
    seen = [-1] * n

    def linked(i: int, j: int) -> int | None:
        """Score of i after j, None beyond the band."""
        dr, dq = r[i] - r[j], q[i] - q[j]
        if abs(dr - dq) > band:
            return None
        return best[j] + min(s[j], dr, dq) - costs[abs(dr - dq)]

    for i in range(n):
        while entered < before[i]:
            tree.put(rank[entered], best[entered] + 0.5 * gap * (r[entered] + q[entered]), entered)
            if inner:
                bisect.insort(close, rank[entered])
            entered += 1
        while left < low[i]:
            tree.put(rank[left], -np.inf, -1)
            left += 1
        while inner and left_near < min(near[i], entered):
            del close[bisect.bisect_left(close, rank[left_near])]
            left_near += 1
        k = tree.best(first[i], stop[i])
        if k < 0:
            continue
        score = linked(i, k)
        if score is not None and score > best[i]:
            best[i], parent[i] = score, k
        if not inner or (r[i] - r[k] == q[i] - q[k] and q[i] - q[k] <= s[k]):
            continue
        skipped, c = 0, bisect.bisect_left(close, stop[i])
        while c:
            c -= 1
            j = at_rank[close[c]]
            if q[j] < q[i] - inner:
                break
            score = linked(i, j)
            if score is None:
                continue
            if score > best[i]:
                best[i], parent[i] = score, j
                skipped = max(0, skipped - 1)
            elif seen[j] == i:
                skipped += 1
                if skipped > max_skip:
                    break
            if parent[j] >= 0:
                seen[parent[j]] = i
    return np.array(best, np.int64), np.array(parent, np.int64)


def backtrack(best: np.ndarray, parent: np.ndarray, min_cnt: int, min_score: int, max_drop: int) -> list[tuple[int, list[int]]]:
    """(score, anchors from first to last) of the chains, the best ends first; ends of one score by place.

    A chain is cut where its score has fallen ``max_drop`` below the most it gains, and stops at an anchor
    that another chain has; anchors of a chain that is too small stay used.
    """
    used = np.zeros(len(best), bool)
    out = []
    for end in np.lexsort((np.arange(len(best)), best))[::-1]:
        if best[end] < min_score or used[end]:
            continue
        path, at, peak, cut = [], int(end), 0, 0
        while at >= 0 and not used[at]:
            path.append(at)
            following = int(parent[at])
            gained = int(best[end] - (best[following] if following >= 0 else 0))
            if gained > peak:
                peak, cut = gained, len(path)
            elif peak - gained > max_drop:
                break
            at = following
        path = path[:cut]
        used[path] = True
        below = int(parent[path[-1]]) if path else -1
        score = int(best[end] - (best[below] if below >= 0 else 0))
        if len(path) >= min_cnt and score >= min_score:
            out.append((score, path[::-1]))
    return out


_CHAIN = "read_id long, rid long, rev boolean, chain int, score int, cnt int, first_r int, last_r int, first_q int, last_q int, span int, mlen int, blen int"


def path_lengths(rpos: np.ndarray, qpos: np.ndarray, span: np.ndarray) -> tuple[int, int]:
    """(mlen, blen) of a chain's anchors: about how many bases match, and the longer of its steps on both sequences."""
    dr, dq = np.diff(rpos), np.diff(qpos)
    matched = np.minimum(span[1:], np.minimum(dr, dq))
    return int(span[0] + matched.sum()), int(span[0] + np.maximum(dr, dq).sum())


#: Rows that a chaining task emits together.
EMITTED = 10_000


def _each(batches: Iterator[pa.RecordBatch], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(read_id, rid, rev) and the values' arrays of every group of sorted rows, which may go on in the next batch."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("read_id", "rid", "rev")]
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in values]
        changes = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        begins = [0, *(np.flatnonzero(changes) + 1).tolist()]
        firsts = zip(*(x[begins].tolist() for x in keys), strict=True)
        for begin, stop, own in zip(begins, [*begins[1:], batch.num_rows], firsts, strict=True):
            if own != key and held:
                yield key, [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]
                held = []
            key = own
            held.append([x[begin:stop] for x in columns])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]


def _over_groups(rows: DataFrame, values: tuple[str, ...], one: Callable[[tuple, list[np.ndarray]], list[dict]], schema: str, kinds: pa.Schema) -> DataFrame:
    """Rows that ``one`` makes of every (read_id, rid, rev) and its values, which are sorted in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, arrays in _each(batches, values):
            out += one(key, arrays)
            if len(out) >= EMITTED:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    key = ("read_id", "rid", "rev")
    dealt = rows.select(*key, *values).repartition(*key).sortWithinPartitions(*key, *values)
    return dealt.mapInArrow(run, schema)


def _grouped(
    anchors: DataFrame, one: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[int, list[int]]]], min_cnt: int = MIN_CNT, points: bool = False
) -> DataFrame:
    """Chains of each (read, sequence, strand), found by ``one`` from sorted positions; with ``points``, their anchors too.

    Groups of fewer than ``min_cnt`` anchors have no chain.
    """

    def chained(key: tuple, arrays: list[np.ndarray]) -> list[dict]:
        rpos, qpos, span = arrays
        rows = []
        if len(rpos) < min_cnt:
            return rows
        for k, (score, path) in enumerate(one(rpos, qpos, span)):
            mlen, blen = path_lengths(rpos[path], qpos[path], span[path])
            rows.append(
                {
                    "read_id": key[0],
                    "rid": key[1],
                    "rev": key[2],
                    "chain": k,
                    "score": score,
                    "cnt": len(path),
                    "first_r": int(rpos[path[0]]),
                    "last_r": int(rpos[path[-1]]),
                    "first_q": int(qpos[path[0]]),
                    "last_q": int(qpos[path[-1]]),
                    "span": int(span[path[0]]),
                    "mlen": mlen,
                    "blen": blen,
                }
            )
            if points:
                rows[-1]["points"] = [{"q": a, "t": b, "span": c} for a, b, c in zip(*(x[path].tolist() for x in (qpos, rpos, span)), strict=True)]
        return rows

    schema = _CHAIN + (", points array<struct<q int, t int, span int>>" if points else "")
    return _over_groups(anchors, ("rpos", "qpos", "span"), chained, schema, _CHAIN_SCHEMA.append(_POINTS) if points else _CHAIN_SCHEMA)


_POINTS = pa.field("points", pa.list_(pa.struct([(k, pa.int32()) for k in ("q", "t", "span")])))
_CHAIN_SCHEMA = pa.schema(
    [("read_id", pa.int64()), ("rid", pa.int64()), ("rev", pa.bool_()), *((k, pa.int32()) for k in ("chain", "score", "cnt", "first_r", "last_r", "first_q", "last_q", "span", "mlen", "blen"))]
)


def chain_dp(anchors: DataFrame, band: int = BAND, min_cnt: int = MIN_CNT, min_score: int = MIN_SCORE) -> DataFrame:
    """Chains by dynamic programming over predecessors within a band."""
    return _grouped(anchors, lambda r, q, s: backtrack(*chain_scores(r, q, s, band), min_cnt, min_score, band), min_cnt)


def chain_rmq(anchors: DataFrame, band: int = 20000, min_cnt: int = MIN_CNT, min_score: int = MIN_SCORE, inner: int = 0) -> DataFrame:
    """Chains by the best predecessor in range, for wide bands; with ``inner``, near predecessors are all tried."""
    return _grouped(anchors, lambda r, q, s: backtrack(*range_scores(r, q, s, band, inner=inner), min_cnt, min_score, band), min_cnt)


def needs_rechaining(chains: DataFrame, lengths: DataFrame, rescue: int = 1000, ratio: float = 0.1) -> DataFrame:
    """(read_id, again): reads with several chains whose first, by reference, leaves or spans enough of the read."""
    firsts = chains.groupBy("read_id").agg(
        F.count("*").alias("n"), F.min(F.struct("rev", "rid", "first_r", "last_r", "first_q", "last_q")).alias("f")
    )
    span = F.col("f.last_q") - F.col("f.first_q")
    wide = (F.col("len") - span > rescue) | (span > F.col("len") * ratio)
    return firsts.join(lengths.select(F.col("rid").alias("read_id"), "len"), "read_id").select("read_id", ((F.col("n") > 1) & wide).alias("again"))


def chain_again(
    anchors: DataFrame, lengths: DataFrame, band: int = BAND, band_long: int = 20000, max_gap: int = MAX_GAP, min_cnt: int = MIN_CNT, min_score: int = MIN_SCORE,
    rescue: int = 1000, ratio: float = 0.1, points: bool = False,
) -> DataFrame:
    """Chains within ``band``; those of reads that ``needs_rechaining`` flags are chained again within ``band_long``.

    With ``points`` a chain has its anchors (q, t, span) in order, at most the read's minimizers.

    Only anchors of the first chains are chained again, when ``band_long`` is the wider.  Both chainings are made
    where a read's anchors on one sequence and strand are, and the read's flag decides between them.
    """
    def both(r: np.ndarray, q: np.ndarray, s: np.ndarray) -> list[tuple[int, list[int]]]:
        first = backtrack(*chain_scores(r, q, s, band, max_gap), min_cnt, min_score, band)
        if band_long <= band or not first:
            return first
        at = np.array(sorted(k for _, path in first for k in path))
        second = backtrack(*range_scores(r[at], q[at], s[at], band_long, max_gap), min_cnt, min_score, band_long)
        # The sign of a score tells the two chainings apart.
        return first + [(-score, at[path].tolist()) for score, path in second]

    found = _grouped(anchors, both, min_cnt, points)
    if band_long <= band:
        return found
    # As ``needs_rechaining``, over a window, so that the anchors are made once.
    read, once = Window.partitionBy("read_id"), F.col("score") > 0
    order = F.struct("rev", "rid", "first_r", "last_r")
    flagged = (
        found.join(lengths.select(F.col("rid").alias("read_id"), "len"), "read_id")
        .withColumn("c_n", F.sum(once.cast("long")).over(read))
        .withColumn("c_first", F.min(F.when(once, F.struct(order.alias("at"), (F.col("last_q") - F.col("first_q")).alias("span")))).over(read))
    )
    span = F.col("c_first.span")
    again = (F.col("c_n") > 1) & ((F.col("len") - span > rescue) | (span > F.col("len") * ratio))
    return flagged.where(again != once).withColumn("score", F.abs("score")).drop("len", "c_n", "c_first")


def greedy(rbeg: np.ndarray, qbeg: np.ndarray, length: np.ndarray, band: int = 100, max_gap: int = 10000) -> list[list[int]]:
    """Chains of exact matches in order of rbeg: each match joins the chain that starts nearest before it.

    It joins when it goes on from the chain's last match within the band and the gap, and is dropped when
    that chain already covers it; otherwise it starts a chain.
    """
    starts: list[int] = []
    chains: list[list[int]] = []
    for i in range(len(rbeg)):
        k = bisect.bisect_right(starts, rbeg[i]) - 1
        if k >= 0:
            first, last = chains[k][0], chains[k][-1]
            if (
                qbeg[i] >= qbeg[first] and qbeg[i] + length[i] <= qbeg[last] + length[last]
                and rbeg[i] >= rbeg[first] and rbeg[i] + length[i] <= rbeg[last] + length[last]
            ):
                continue
            dq, dr = qbeg[i] - qbeg[last], rbeg[i] - rbeg[last]
            if dr >= 0 and dq >= 0 and abs(dq - dr) <= band and dq - length[last] < max_gap and dr - length[last] < max_gap:
                chains[k].append(i)
                continue
        at = bisect.bisect_right(starts, rbeg[i])
        starts.insert(at, int(rbeg[i]))
        chains.insert(at, [i])
    return chains


def union_length(start: np.ndarray, length: np.ndarray) -> int:
    """Length of the union of intervals in order of their starts."""
    if not len(start):
        return 0
    end = np.maximum.accumulate(start + length)
    reach = np.concatenate([[start[0]], end[:-1]])
    return int(np.maximum(0, start + length - np.maximum(start, reach)).sum())


def chain_greedy(matches: DataFrame, band: int = 100, max_gap: int = 10000) -> DataFrame:
    """Greedy chains of exact matches (read_id, rid, rev, rbeg, qbeg, mlen), with their weight: the smaller of
    the lengths that they cover on the read and on the reference."""
    schema = "read_id long, rid long, rev boolean, chain int, cnt int, weight int, rs int, re int, qs int, qe int"
    names = [x.split()[0] for x in schema.split(", ")]

    def chained(key: tuple, arrays: list[np.ndarray]) -> list[dict]:
        r, q, n = arrays
        rows = []
        for k, path in enumerate(greedy(*(x.tolist() for x in arrays), band, max_gap)):
            path = np.array(path)
            by_q = path[np.argsort(q[path], kind="stable")]
            weight = min(union_length(q[by_q], n[by_q]), union_length(r[path], n[path]))
            ends = (r[path].min(), (r[path] + n[path]).max(), q[path].min(), (q[path] + n[path]).max())
            rows.append(dict(zip(names, [*key, k, len(path), weight, *map(int, ends)], strict=True)))
        return rows

    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 7]
    return _over_groups(matches, ("rbeg", "qbeg", "mlen"), chained, schema, pa.schema(list(zip(names, kinds, strict=True))))


def keep_chains(qs: np.ndarray, qe: np.ndarray, weight: np.ndarray, mask: float = 0.5, drop: float = 0.5, min_seed: int = 19, max_gap: int = 10000) -> np.ndarray:
    """Which of a read's chains stay, heaviest first: one that a kept, much heavier chain overlaps goes.

    The overlap must be at least ``mask`` of the shorter, which must be below ``max_gap``; much heavier is by the
    ratio ``drop`` and by two seeds.
    """
    out = np.zeros(len(qs), bool)
    begin, end, heavy = (np.asarray(x, np.int64) for x in (qs, qe, weight))
    kept, n = np.zeros((3, len(out)), np.int64), 0
    for i in range(len(out)):
        s, e, w = kept[:, :n]
        shared, shorter = np.minimum(e, end[i]) - np.maximum(s, begin[i]), np.minimum(e - s, end[i] - begin[i])
        if not ((shared > 0) & (shared >= shorter * mask) & (shorter < max_gap) & (heavy[i] < w * drop) & (w - heavy[i] >= 2 * min_seed)).any():
            kept[:, n] = begin[i], end[i], heavy[i]
            n, out[i] = n + 1, True
    return out


def filter_chains(found: DataFrame, mask: float = 0.5, drop: float = 0.5) -> DataFrame:
    """Greedy chains of each read without those that heavier ones make unlikely.

    Only a lighter chain goes, and by its place on the read and its weight alone, so it is decided once for all chains of a
    read that have these in common, however many references there are.  The chains are stored and read twice.
    """
    found = Workspace(found.sparkSession).stash(found, "chains")
    key = ["read_id", "qs", "qe", "weight"]
    spans = found.select(*key).distinct()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("weight", "descending"), ("qs", "ascending"), ("qe", "ascending")])
        return table.filter(pa.array(keep_chains(*(table.column(k).to_numpy() for k in ("qs", "qe", "weight")), mask, drop)))

    return found.join(spans.groupBy("read_id").applyInArrow(run, fields), key, "left_semi").select(*found.columns)
