"""Range-maximum chaining by a tree against plain scans, and its cost on one large read."""

import time

import numpy as np
import pytest

from strandloom import alignment_queries  # noqa: F401  registers its queries
from strandloom.operators import chains
from strandloom.queries import QUERIES
from tests.test_records import DATA, _anchors


def scanned(rpos, qpos, span, band, max_gap, inner=0, max_skip=25, gap=chains.GAP_PENALTY):
    """Every anchor in range looked at; with ``inner`` the near ones tried from the nearest on the query."""
    n = len(rpos)
    best, parent, seen = span.astype(np.int64).copy(), np.full(n, -1), np.full(n, -1)

    def linked(i, j):
        if abs((rpos[i] - rpos[j]) - (qpos[i] - qpos[j])) > band:
            return None
        return best[j] + chains.link_scores(rpos[[i]] - rpos[[j]], qpos[[i]] - qpos[[j]], span[[j]], gap)[0]

    for i in range(n):
        j = np.flatnonzero((rpos < rpos[i]) & (rpos >= rpos[i] - max_gap) & (qpos < qpos[i]) & (qpos > qpos[i] - max_gap))
        if not len(j):
            continue
        k = j[np.argmax(best[j] + 0.5 * gap * (rpos[j] + qpos[j]))]
        score = linked(i, k)
        if score is not None and score > best[i]:
            best[i], parent[i] = score, k
        if not inner or (rpos[i] - rpos[k] == qpos[i] - qpos[k] <= span[k]):
            continue
        near = [x for x in np.flatnonzero((rpos < rpos[i]) & (rpos >= rpos[i] - inner) & (qpos < qpos[i]) & (qpos >= qpos[i] - inner))]
        skipped = 0
        for x in sorted(near, key=lambda x: (qpos[x], x), reverse=True):
            score = linked(i, x)
            if score is None:
                continue
            if score > best[i]:
                best[i], parent[i] = score, x
                skipped = max(0, skipped - 1)
            elif seen[x] == i:
                skipped += 1
                if skipped > max_skip:
                    break
            if parent[x] >= 0:
                seen[parent[x]] = i
    return best, parent


@pytest.mark.parametrize("inner", [0, 30, 300])
def test_tree_equals_scan(inner):
    rng = np.random.default_rng(inner)
    for _ in range(40):
        n, width = int(rng.integers(0, 120)), int(rng.choice([50, 400, 3000]))
        r, q = rng.integers(0, width, n), rng.integers(0, width, n)
        line = rng.random(n) < 0.6
        q[line] = np.maximum(0, r[line] + rng.integers(-3, 4, line.sum()))
        at = np.lexsort((q, r))
        r, q, span = r[at], q[at], rng.integers(10, 20, n)
        band, max_gap = int(rng.choice([5, 100, 20000])), int(rng.choice([60, 5000]))
        found = chains.range_scores(r, q, span, band, max_gap, inner=inner, max_skip=int(3))
        wanted = scanned(r, q, span, band, max_gap, inner, 3)
        assert found[0].tolist() == wanted[0].tolist() and found[1].tolist() == wanted[1].tolist()


def test_a_large_read_takes_seconds():
    rng = np.random.default_rng(1)
    n = 200_000
    r = np.sort(rng.integers(0, 1_000_000, n))
    q = np.maximum(0, r + rng.integers(-2000, 2000, n))
    at = np.lexsort((q, r))
    began = time.perf_counter()
    best, _ = chains.range_scores(r[at], q[at], np.full(n, 15))
    assert time.perf_counter() - began < 40 and best.max() > 60_000


def test_inner_pass_finds_the_near_predecessor():
    """The anchor of greatest priority is beyond the band; a near one isn't."""
    r, q, span = np.array([100, 1000, 1100, 1120]), np.array([100, 1000, 60, 1120]), np.array([15, 500, 15, 15])
    plain, inner = chains.range_scores(r, q, span, 5), chains.range_scores(r, q, span, 5, inner=200)
    assert plain[1].tolist()[-1] == inner[1].tolist()[-1] == 1
    r, q = np.array([500, 990, 1010]), np.array([900, 990, 1010])
    span = np.array([800, 15, 15])
    assert chains.range_scores(r, q, span, 5)[1].tolist() == [-1, -1, -1]
    assert chains.range_scores(r, q, span, 5, inner=100)[1].tolist() == [-1, -1, 1]


def test_registered_chains_equal_scanned_ones(spark):
    wanted = []
    for (read, rid, rev), a in _anchors(spark).items():
        r, q, span = (np.array(a[:, k], np.int64) for k in range(3))
        for k, (score, path) in enumerate(chains.backtrack(*scanned(r, q, span, 20000, 5000, 1000), 3, 40, 20000)):
            wanted.append((read, rid, rev, k, score, len(path), r[path[0]], r[path[-1]], q[path[0]], q[path[-1]], span[path[0]]))
    names = ["read_id", "rid", "rev", "chain", "score", "cnt", "first_r", "last_r", "first_q", "last_q", "span"]
    assert sorted(map(tuple, QUERIES["chain_rmq_inner"](spark, DATA).select(*names).collect())) == sorted(wanted) and wanted
