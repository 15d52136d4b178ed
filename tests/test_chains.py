import numpy as np
import pytest

from strandloom.operators import chains, hits, intervals


def anchors(spark, rows):
    return spark.createDataFrame(rows, "read_id long, rid long, rev boolean, rpos int, qpos int, span int")


@pytest.mark.parametrize("seed", range(20))
def test_chain_scores_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    r = np.sort(rng.integers(0, 400, n)).astype(np.int64)
    q = rng.integers(0, 400, n).astype(np.int64)
    span = np.full(n, 15, np.int64)
    best, parent = chains.chain_scores(r, q, span, band=50, max_gap=200, max_skip=10**6, max_iter=10**6)
    wanted = span.copy()
    for i in range(n):
        for j in range(i):
            dr, dq = r[i] - r[j], q[i] - q[j]
            if 0 < dq <= 200 and 0 < dr <= 200 and abs(dr - dq) <= 50:
                wanted[i] = max(wanted[i], wanted[j] + chains.link_scores(np.array([dr]), np.array([dq]), span[[j]])[0])
    assert best.tolist() == wanted.tolist()
    for i, p in enumerate(parent):
        assert p < i


def test_no_band_chaining_equals_islands(spark):
    rng = np.random.default_rng(3)
    rows = []
    for read in range(6):
        for diag in rng.integers(0, 3, 1 + read):
            for x in np.unique(rng.integers(0, 300, 8)):
                rows.append((read, 1, False, int(x + diag), int(x), 15))
    df = anchors(spark, sorted(set(rows)))
    found = chains.islands(df, max_gap=60).where("cnt >= 3 AND score >= 40")
    islands = sorted((r.read_id, r.first_r, r.last_r, r.cnt, r.score) for r in found.collect())
    out = chains._grouped(df, lambda r, q, s: chains.backtrack(*chains.chain_scores(r, q, s, 0, 60, 10**6, 10**6), 3, 40, 0))
    assert sorted((r.read_id, r.first_r, r.last_r, r.cnt, r.score) for r in out.collect()) == islands


def test_range_chaining_follows_a_planted_line(spark):
    rows = [(1, 1, False, 100 * i + (i % 2), 100 * i, 15) for i in range(1, 30)] + [(1, 1, False, 5000 + i, 10, 15) for i in range(3)]
    best = chains.chain_rmq(anchors(spark, rows), min_score=40).orderBy("score", ascending=False).first()
    assert best.cnt == 29 and best.first_r == 101


def test_greedy_chains_and_weight(spark):
    assert chains.greedy(np.array([0, 30, 5000]), np.array([0, 30, 40]), np.array([20, 20, 20])) == [[0, 1], [2]]
    assert chains.union_length(np.array([0, 10, 40]), np.array([20, 20, 5])) == 35


def brute_parents(qs, qe, mask):
    parent, primaries = list(range(len(qs))), []
    for i in range(len(qs)):
        bare = sum(not any(qs[p] <= x < qe[p] for p in primaries) for x in range(qs[i], qe[i]))
        for j in primaries:
            both = min(qe[i], qe[j]) - max(qs[i], qs[j])
            lengths = sorted((qe[i] - qs[i], qe[j] - qs[j]))
            if both > 0 and both / lengths[0] - bare / lengths[1] > mask:
                parent[i] = j
                break
        else:
            primaries.append(i)
    return parent


@pytest.mark.parametrize("seed", range(30))
def test_parents_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    qs = rng.integers(0, 60, n)
    qe = qs + rng.integers(1, 50, n)
    parent, subsc, n_sub = hits.assign_parents(qs, qe, np.arange(n, 0, -1), np.ones(n, int))
    assert parent.tolist() == brute_parents(qs.tolist(), qe.tolist(), 0.5)
    assert n_sub.sum() == (parent != np.arange(n)).sum()


def test_parents_secondaries_and_quality(spark):
    rows = [(1, 1, False, 0, 100, 0, 100, 90, 20, 90, 100), (1, 2, False, 0, 100, 5, 105, 85, 19, 85, 100), (1, 3, True, 0, 100, 9, 109, 20, 3, 20, 100), (2, 1, False, 0, 50, 0, 50, 60, 9, 50, 50)]
    df = spark.createDataFrame(rows, "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int, score int, cnt int, mlen int, blen int")
    out = {(r.read_id, r.rid): r for r in hits.mapq_long(hits.select_secondary(hits.set_parents(df), slack=0)).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1)}
    assert out[1, 1].mapq < out[2, 1].mapq and out[1, 2].mapq == 0


def test_pairs(spark):
    schema = "read_id long, rid long, rev boolean, rs int, re int, score int"
    left = spark.createDataFrame([(1, 1, False, 100, 200, 90), (1, 2, False, 0, 100, 80)], schema)
    right = spark.createDataFrame([(1, 1, True, 400, 500, 70), (1, 1, True, 90000, 90100, 99), (1, 2, False, 300, 400, 99)], schema)
    found = hits.pair_hits(left, right, 1000).collect()
    assert [(r.rid, r.m_rs, r.total) for r in found] == [(1, 400, 160)]


def test_mask_drops_covered_minimizers(spark):
    m = spark.createDataFrame([(1, 20, 0, 7, 15), (1, 60, 0, 8, 15)], "rid long, pos int, strand int, hash long, span int")
    mask = spark.createDataFrame([(1, 0, 30)], "rid long, st int, en int")
    assert [r.pos for r in intervals.drop_masked(m, mask).collect()] == [60]


def test_interval_inside(spark):
    w = spark.createDataFrame([(1, 1, 100, 9000)], "window_id long, rid long, w_st int, w_en int")
    i = spark.createDataFrame([(1, 100, 200), (1, 50, 150), (1, 8990, 9000), (2, 100, 200)], "rid long, st int, en int")
    assert sorted(r.st for r in intervals.inside(i, w).collect()) == [100, 8990]


def test_chain_filter_and_qualities(spark):
    kept = chains.keep_chains(np.array([0, 10, 200, 5]), np.array([100, 90, 300, 95]), np.array([100, 40, 60, 90]))
    assert kept.tolist() == [True, False, True, True]
    from pyspark.sql import functions as F

    from strandloom.operators import scoring

    rows = [(1, 1, False, 0, 100, 0, 100, 100, 0, 0, 0.0), (1, 2, False, 0, 100, 0, 100, 90, 90, 2, 0.0), (2, 1, False, 0, 100, 0, 100, 95, 60, 1, 0.5)]
    df = spark.createDataFrame(rows, "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int, score int, sub int, sub_n int, frac_rep double")
    out = {(r.read_id, r.rid): r.mapq for r in scoring.mapq_short(df).collect()}
    assert out[1, 1] == 60 and out[1, 2] == 0 and 0 < out[2, 1] < 60
    inv = spark.createDataFrame([(1, 1, 0, 10, False, 50), (1, 1, 20, 30, True, 9), (1, 1, 40, 50, False, 20)], "read_id long, rid long, rs int, re int, inv boolean, mapq int")
    assert [r.mapq for r in scoring.inversion_quality(inv).orderBy("rs").collect()] == [50, 20, 20]
    assert df.select(scoring.alt_score(F.col("score")).alias("s")).first().s == 85


@pytest.mark.parametrize("seed", range(12))
def test_reseeding_intervals_occur_as_said(seed):
    from strandloom.operators.exact import shorter_seeds

    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    begin = rng.integers(0, 60, n)
    end = begin + rng.integers(15, 60, n)
    count = lambda s, e: int(((begin <= s) & (end >= e)).sum())
    found = shorter_seeds(begin, end, few=6)
    for kind, s, e, occ in found:
        assert occ == count(s, e) > 0 and e - s >= 19
        if kind == 3:
            assert occ < 6 and (e - s == 20 or count(s, e - 1) >= 6)
    third = [x for x in found if x[0] == 3]
    assert all(a[2] <= b[1] for a, b in zip(third, third[1:], strict=False))
    for kind, s, e, occ in found:
        if kind == 2:  # no longer interval around the same middle occurs as often
            for a in range(s + 1):
                for b in range(e, int(end.max()) + 1):
                    assert (a, b) == (s, e) or count(a, b) < occ or b - a <= e - s
