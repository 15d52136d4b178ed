import itertools

import numpy as np
import pytest

from strandloom.functions import cigar as C
from strandloom.operators import align


def score_of(q, t, cigar, s):
    total = i = j = 0
    for n, op in C.parse(cigar):
        if op == "M":
            for k in range(n):
                total += int(s.row(int(q[i + k]), t[j + k : j + k + 1])[0])
            i, j = i + n, j + n
        else:
            total -= s.gap_open + n * s.gap_extend
            i, j = (i + n, j) if op == "I" else (i, j + n)
    return total, i, j


def brute_matrix(q, t, s, local=False):
    n, m = len(q), len(t)
    low = -10**9
    H = np.full((n + 1, m + 1), low)
    E, G = H.copy(), H.copy()
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if i == j == 0:
            H[0, 0] = 0
            continue
        if i:
            E[i, j] = max(H[i - 1, j] - s.gap_open, E[i - 1, j]) - s.gap_extend
        if j:
            G[i, j] = max(H[i, j - 1] - s.gap_open, G[i, j - 1]) - s.gap_extend
        d = H[i - 1, j - 1] + s.row(int(q[i - 1]), t[j - 1 : j])[0] if i and j else low
        H[i, j] = max(d, E[i, j], G[i, j], 0 if local else low)
    return H


@pytest.mark.parametrize("seed", range(60))
def test_kernels_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(0, 5 if seed % 4 == 0 else 4, int(rng.integers(0, 25))).astype(np.uint8)
    t = rng.integers(0, 4, int(rng.integers(0, 25))).astype(np.uint8)
    if seed % 2 and len(q) > 6:
        t = np.concatenate([q[:4], q[6:], q[:2]])
    s = align.Scoring(2, 4, int(rng.integers(0, 6)), int(rng.integers(1, 3)))
    H = brute_matrix(q, t, s)
    found = align.align_global(q, t, s)
    assert found.score == H[-1, -1]
    assert score_of(q, t, found.cigar, s) == (found.score, len(q), len(t))
    out = align.extend(q, t, s)
    assert score_of(q, t, out.cigar, s) == (out.score, out.q_end, out.t_end)
    assert out.score == H.max() or out.q_end == len(q)
    local = brute_matrix(q, t, s, local=True)
    assert align.local_score(q, t, s) == local.max()


def test_extension_stops_at_the_drop():
    rng = np.random.default_rng(1)
    same, a, b = (rng.integers(0, 4, 80).astype(np.uint8) for _ in range(3))
    found = align.extend(np.concatenate([same, a]), np.concatenate([same, b]), align.Scoring(zdrop=20))
    assert found.zdropped and 70 <= found.q_end <= 100


def test_edit_summary():
    q, t = (np.array([["ACGT".index(c) for c in x]], np.uint8)[0] for x in ("ACGTAC", "ACTTGAC"))
    eqx, nm, md, same, columns = align.edit_summary(q, t, "4M1D2M")
    assert (eqx, nm, md, same, columns) == ("2=1X1=1D2=", 2, "2T1^G2", 5, 7)


def test_cigar_forms(spark):
    assert C.normalise("5I6D7I") == "12I6D"
    assert C.normalise("3M0I4M2D") == "7M2D"
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2M3M1I4D",), ("",), (None,), ("3D5M2D",)], "c string")
    rows = df.select(
        C.merged(F.col("c")).alias("m"), C.query_length(F.col("c")).alias("q"), C.reference_length(F.col("c")).alias("r"),
        C.gap_opens(F.col("c")).alias("g"), C.clipped(F.col("c"), F.lit(2), F.lit(0)).alias("s"),
    ).collect()
    assert [tuple(x) for x in rows] == [("5M1I4D", 6, 9, 2, "2S2M3M1I"), ("", 0, 0, 0, "2S"), ("", 0, 0, 0, None), ("3D5M2D", 5, 10, 2, "2S5M")]


@pytest.mark.parametrize("seed", range(20))
def test_chain_alignment_recovers_a_planted_read(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 4, 900).astype(np.uint8)
    q = np.concatenate([t[100:350], rng.integers(0, 4, 3).astype(np.uint8), t[350:500], t[505:800]])
    points = [(30, 130), (200, 300), (260, 357), (390, 487), (420, 522), (690, 792)]
    points = [(a, b) for a, b in points if (q[a - 6 : a + 1] == t[b - 6 : b + 1]).all()]
    s = align.Scoring()
    found = align.align_chain(q, t, points, 7, s, min_gap=50)
    part_q, part_t = q[found.q_start : found.q_end], t[found.t_start : found.t_end]
    assert score_of(part_q, part_t, found.cigar, s) == (found.score, len(part_q), len(part_t))
    assert (found.q_start, found.q_end) == (0, len(q)) and (found.t_start, found.t_end) == (100, 800) and not found.zdropped
    assert found.score >= 2 * (len(q) - 3) - (4 + 3 * 2) - (4 + 5 * 2) - 12
    assert align.path_scores(np.zeros(40, np.uint8), np.ones(40, np.uint8), "40M", align.Scoring(zdrop=20))[1] == 160


def banded_matrix(q, t, s, band):
    n, m, low = len(q), len(t), -10**9
    H = np.full((n + 1, m + 1), low)
    E, G = H.copy(), H.copy()
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if abs(i - j) > band:
            continue
        if i == j == 0:
            H[0, 0] = 0
            continue
        if i:
            E[i, j] = max(H[i - 1, j] - s.gap_open, E[i - 1, j]) - s.gap_extend
        if j:
            G[i, j] = max(H[i, j - 1] - s.gap_open, G[i, j - 1]) - s.gap_extend
        d = H[i - 1, j - 1] + s.row(int(q[i - 1]), t[j - 1 : j])[0] if i and j else low
        H[i, j] = max(d, E[i, j], G[i, j], low)
    return H


@pytest.mark.parametrize("seed", range(40))
def test_banded_kernels_equal_brute_force(seed):
    rng = np.random.default_rng(1000 + seed)
    q = rng.integers(0, 4, int(rng.integers(0, 25))).astype(np.uint8)
    t = rng.integers(0, 4, int(rng.integers(0, 25))).astype(np.uint8)
    if seed % 2 and len(q) > 6:
        t = np.concatenate([q[:4], q[6:], q[:2]])
    s, band = align.Scoring(2, 4, 4, 2), int(rng.integers(0, 8))
    wide = max(band, abs(len(q) - len(t)))
    found = align.align_global(q, t, s, band)
    assert found.score == banded_matrix(q, t, s, wide)[-1, -1]
    assert score_of(q, t, found.cigar, s) == (found.score, len(q), len(t))
    out = align.extend(q, t, s, band)
    H = banded_matrix(q, t, s, band)
    assert score_of(q, t, out.cigar, s) == (out.score, out.q_end, out.t_end)
    assert out.score == H.max() or out.q_end == len(q)
    assert align.extend(q, t, s, 100) == align.extend(q, t, s) and align.align_global(q, t, s, 100) == align.align_global(q, t, s)


def test_a_band_bounds_memory_of_long_fragments():
    rng = np.random.default_rng(7)
    q = rng.integers(0, 4, 20_000).astype(np.uint8)
    t = np.concatenate([q[:9_000], q[9_100:]])
    rows = list(zip(range(50), align._rows(q, t, align.Scoring(), band=500), strict=False))
    assert all(len(r.bits) <= 1001 for _, r in rows)
    assert align.extend(q, t, align.Scoring(), 500).q_end == 20_000
