"""Two gap prices and introns against five-matrix recurrences, cell by cell."""

import random

import numpy as np
import pytest

from strandloom.functions import cigar as cigars
from strandloom.functions.sequence import base_codes
from strandloom.operators import align, gaps
from tests.test_alignment import applied, dna, edited, turned

LOW = -(10**9)


def pair(a, b, s):
    return -s.ambiguous if max(a, b) >= 4 else s.match if a == b else -s.mismatch


def five_matrices(q, t, s):
    """Global score by the plain recurrence of one match and four gap matrices."""
    prices = ((s.gap_open, s.gap_extend), (s.gap_open2, s.gap_extend2))
    n, m = len(q), len(t)
    h = [[LOW] * (m + 1) for _ in range(n + 1)]
    e = [[[LOW] * (m + 1) for _ in range(n + 1)] for _ in range(2)]
    f = [[[LOW] * (m + 1) for _ in range(n + 1)] for _ in range(2)]
    for i in range(n + 1):
        for j in range(m + 1):
            best = 0 if i == j == 0 else LOW
            if i and j:
                best = h[i - 1][j - 1] + pair(q[i - 1], t[j - 1], s)
            for k, (o, x) in enumerate(prices):
                if i:
                    e[k][i][j] = max(h[i - 1][j] - o, e[k][i - 1][j]) - x
                if j:
                    f[k][i][j] = max(h[i][j - 1] - o, f[k][i][j - 1]) - x
                best = max(best, e[k][i][j], f[k][i][j])
            h[i][j] = best
    return h


def path_cost(q, t, cigar, s, sites=None):
    score = i = j = 0
    for n, op in cigars.parse(cigar):
        if op == "M":
            score += sum(pair(q[i + k], t[j + k], s) for k in range(n))
            i, j = i + n, j + n
        elif op == "N":
            score -= s.intron + sites[0][j] + sites[1][j + n]
            j += n
        else:
            score -= min(s.gap_open + n * s.gap_extend, s.gap_open2 + n * s.gap_extend2) if isinstance(s, gaps.TwoGaps) else s.gap_open + n * s.gap_extend
            i, j = (i + n, j) if op == "I" else (i, j + n)
    assert (i, j) == (len(q), len(t))
    return score


def related(rng, n):
    a = dna(rng.random(), n)
    cut, size = rng.randrange(n + 1), rng.choice([0, 3, 12, 30])
    b = edited(a[:cut], 0.05, rng.random()) + dna(rng.random(), size) + edited(a[cut:], 0.05, rng.random())
    return (a, b) if rng.random() < 0.5 else (b, a)


@pytest.mark.parametrize("scoring", [gaps.TwoGaps(), gaps.TwoGaps(1, 3, 2, 2, 8, 1), gaps.TwoGaps(2, 4, 0, 3, 5, 1)])
def test_two_gaps_equal_five_matrices(scoring):
    rng = random.Random(1)
    for _ in range(40):
        a, b = related(rng, rng.randrange(0, 45))
        a = a.replace("A", "N", 1) if rng.random() < 0.2 else a
        q, t = base_codes(a, "dna"), base_codes(b, "dna")
        h = five_matrices(q.tolist(), t.tolist(), scoring)
        found = gaps.align_two_gaps(q, t, scoring)
        assert found.score == h[-1][-1] == path_cost(q.tolist(), t.tolist(), found.cigar, scoring)
        assert gaps.align_two_gaps(q, t, scoring, band=len(q) + len(t)).score == found.score
        free = gaps.extend_two_gaps(q, t, scoring._replace(zdrop=10**6))
        top, last = max(max(r) for r in h), max(h[-1])
        assert free.score == (last if last >= top and len(q) else top)
        assert path_cost(q[: free.q_end].tolist(), t[: free.t_end].tolist(), free.cigar, scoring) == free.score


def test_long_gaps_are_cheaper_than_at_one_price():
    a = dna(2, 400)
    q, t = base_codes(a[:200] + a[280:], "dna"), base_codes(a, "dna")
    two, one = gaps.align_two_gaps(q, t), align.align_global(q, t)
    assert two.cigar == one.cigar and sorted(n for n, op in cigars.parse(two.cigar) if op == "D") == [80]
    assert two.score - one.score == (4 + 160) - (24 + 80)
    short = base_codes(a[:200] + a[210:], "dna")
    assert gaps.align_two_gaps(short, t).score == align.align_global(short, t).score
    # A drop ends an extension sooner where the long gap isn't there to forgive it.
    x, y = base_codes(a[:150] + dna(3, 300), "dna"), base_codes(a[:150] + dna(4, 300), "dna")
    dropped = gaps.extend_two_gaps(x, y, gaps.TwoGaps(zdrop=50))
    assert dropped.zdropped and 145 <= dropped.q_end <= 170


def spliced_matrices(q, t, s, sites):
    """Global score with one gap matrix a direction and one of introns."""
    n, m = len(q), len(t)
    h, e, f, g = ([[LOW] * (m + 1) for _ in range(n + 1)] for _ in range(4))
    for i in range(n + 1):
        for j in range(m + 1):
            best = 0 if i == j == 0 else LOW
            if i and j:
                best = h[i - 1][j - 1] + pair(q[i - 1], t[j - 1], s)
            if i:
                e[i][j] = max(h[i - 1][j] - s.gap_open, e[i - 1][j]) - s.gap_extend
            if j:
                f[i][j] = max(h[i][j - 1] - s.gap_open, f[i][j - 1]) - s.gap_extend
                g[i][j] = max(h[i][j - 1] - s.intron - sites[0][j - 1], g[i][j - 1])
            h[i][j] = max(best, e[i][j], f[i][j], g[i][j] - sites[1][j])
    return h[n][m]


def slow_sites(t, s, forward):
    """Costs by looking at the letters around each place."""
    donor, acceptor = [], []
    for p in range(len(t) + 1):
        begins, ends = t[p : p + 2] == ("GT" if forward else "CT"), t[max(0, p - 2) : p] == ("AG" if forward else "AC")
        after, before = t[p + 2 : p + 3] in ("A", "G") and t[p + 2 : p + 3] != "", p >= 3 and t[p - 3] in "CT"
        half = s.noncanonical // 2 if s.flanks else 0
        donor.append((0 if after else half) if begins else s.noncanonical)
        acceptor.append((0 if before else half) if ends else s.noncanonical)
    return donor, acceptor


@pytest.mark.parametrize("scoring", [gaps.Splice(), gaps.Splice(intron=6, flanks=False), gaps.Splice(2, 4, 4, 2, 10, 5, 4)])
def test_splicing_equals_plain_matrices(scoring):
    rng = random.Random(5)
    seen = 0
    for _ in range(40):
        one, two = dna(rng.random(), rng.randrange(3, 20)), dna(rng.random(), rng.randrange(3, 20))
        intron = rng.choice(["GTA", "GTC", "CTG", "AAA"]) + dna(rng.random(), rng.randrange(5, 25)) + rng.choice(["CAG", "AAG", "TAC", "TTT"])
        a, b = edited(one + two, 0.04, rng.random()), one + intron + two
        q, t = base_codes(a, "dna"), base_codes(b, "dna")
        for forward in (True, False):
            sites = gaps.splice_sites(t, scoring, forward)
            assert [x.tolist() for x in sites] == list(slow_sites(b, scoring, forward))
        known = ((len(one), len(one) + len(intron), rng.random() < 0.5),) if rng.random() < 0.5 else ()
        found = gaps.align_spliced(q, t, scoring, known)
        wanted = []
        for forward in (True, False):
            sites = [list(x) for x in slow_sites(b, scoring, forward)]
            for st, en, strand in known:
                if strand == forward:
                    sites[0][st] -= scoring.junction
                    sites[1][en] -= scoring.junction
            wanted.append((spliced_matrices(q.tolist(), t.tolist(), scoring, sites), sites))
        best = max(w[0] for w in wanted)
        assert found.score == best and found.forward == (wanted[0][0] == best)
        assert path_cost(q.tolist(), t.tolist(), found.cigar, scoring, wanted[0 if found.forward else 1][1]) == best
        seen += "N" in found.cigar
    assert seen > 4


def test_planted_introns_come_out(spark):
    exons = [dna(10 + k, 80) for k in range(3)]
    introns = ["GTA" + dna(20 + k, 300) + "CAG" for k in range(2)]
    genome = exons[0] + introns[0] + exons[1] + introns[1] + exons[2]
    read = "".join(exons)
    other = turned(genome)  # its transcript is that of the other strand
    odd = exons[0] + "CC" + dna(30, 200) + "CC" + exons[1]
    rows = [
        (0, read, genome, False, None),
        (1, turned(read), other, False, None),
        (2, turned(read), genome, True, None),
        (3, exons[0] + exons[1], odd, False, None),
        (4, exons[0] + exons[1], odd, False, [(80, 284, True), (10, 20, False)]),
        (5, None, None, False, None),
        (6, "", "ACGT", None, []),
    ]
    df = spark.createDataFrame(rows, "k long, q string, t string, rev boolean, known array<struct<st:int,en:int,forward:boolean>>")
    found = {x.k: x for x in gaps.align_fragments_by(df, ("k",), "spliced", gaps.Splice(), turned="rev", known="known").collect()}
    clean = "80M306N80M306N80M"
    assert (found[0].cigar, found[0].forward, found[0].nm, found[0].md, found[0].columns) == (clean, True, 0, "240", 240)
    assert (found[1].cigar, found[1].forward) == (clean, False) and found[2].cigar == clean
    assert found[0].score == found[1].score == 240 - 64
    assert "204N" in found[4].cigar and found[4].score == 160 - 32 - 18 + 18 and found[3].score < found[4].score
    assert found[5].cigar == "" and found[6].cigar == "4D" and len(found) == 7


def test_fragments_by_two_gaps(spark):
    a = dna(40, 300)
    df = spark.createDataFrame([(1, a[:100] + a[160:], a), (2, turned(a), a), (3, None, a)], "k long, q string, t string").selectExpr("*", "k = 2 AS rev", "'x' AS cigar")
    found = {x.k: x for x in gaps.align_fragments_by(df, ("k",), "global", gaps.TwoGaps(), turned="rev").collect()}
    assert found[1].score == 480 - 84 and found[1].nm == 60 and found[2].cigar == "300M" and found[3].cigar == "300D"
    free = {x.k: x for x in gaps.align_fragments_by(df, ("k",), "extend", gaps.TwoGaps(), turned="rev").collect()}
    assert free[1].t_end == 300 and free[3].cigar == "" and np.isfinite(free[1].score)
    with pytest.raises(ValueError, match="mode"):
        gaps.align_fragments_by(df, ("k",), "other", gaps.TwoGaps())
