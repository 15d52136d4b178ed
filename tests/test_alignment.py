"""DNA in the jobs, chain repair, split alignments, inversions and mates, on planted reads and against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cigars
from strandloom.functions.sequence import base_codes
from strandloom.jobs import alignment, mapping, pairs
from strandloom.jobs.options import Options, from_settings
from strandloom.operators import align, mates, records, regions, repair

DNA = Options(alphabet="dna")


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def turned(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def edited(text, rate, seed):
    """Substitutions, insertions and deletions at a rate each."""
    rng, out = random.Random(seed), []
    for c in text:
        x = rng.random()
        if x < rate:
            out.append(rng.choice("ACGT"))
        elif x < 2 * rate:
            out.append(c + rng.choice("ACGT"))
        elif x >= 3 * rate:
            out.append(c)
    return "".join(out)


def frame(spark, texts, key):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").repartition(3)


def applied(cigar, q, t):
    """Score-free check that a CIGAR fits both: (query bases, target bases)."""
    i = j = 0
    for n, op in cigars.parse(cigar):
        i, j = i + (n if op in "MI" else 0), j + (n if op in "MDN" else 0)
    return i, j


# --- DNA


def test_dna_reads_map_on_both_strands(spark):
    genome = [dna(1, 6000), dna(2, 4000), None, "", "N" * 100]
    reads = [genome[0][1000:2000], turned(genome[0][2500:3500]), edited(genome[1][500:1700], 0.02, 3), turned(edited(genome[1][2000:3000], 0.02, 4)), dna(9, 800), genome[0][100:400] + "N" * 40 + genome[0][440:900], None, ""]
    q, r = frame(spark, reads, "item_id"), frame(spark, genome, "doc_id")
    best = {x.read_id: x for x in mapping.map_best(q, "item_id", r, "doc_id", DNA).where("place = 1").collect()}
    places = {0: (0, False, 1000, 2000), 1: (0, True, 2500, 3500), 2: (1, False, 500, 1700), 3: (1, True, 2000, 3000), 5: (0, False, 100, 900)}
    assert set(best) == set(places)
    for k, (rid, rev, start, end) in places.items():
        x = best[k]
        assert (x.rid, x.rev) == (rid, rev) and abs(x.rs - start) < 60 and abs(x.re - end) < 60
    found = mapping.align_hits(mapping.map_best(q, "item_id", r, "doc_id", DNA).where("place = 1"), q, "item_id", r, "doc_id", options=DNA).collect()
    assert {x.read_id for x in found} == set(places)
    assert {x.nm for x in found if x.read_id in (0, 1)} == {0}
    # Read as text, C and G are one base, and a turned read is lost.
    assert 1 not in {x.read_id for x in mapping.map_best(q, "item_id", r, "doc_id").collect()}


def test_alphabet_is_checked():
    assert from_settings({"alphabet": "dna"}).alphabet == "dna"
    with pytest.raises(ValueError, match="alphabet"):
        from_settings({"alphabet": "protein"})


# --- repair of chains


def plain_trim(q, t, span, matched, band, min_match):
    """Both ends walked anchor by anchor."""

    def cut(order):
        walked = gained = span[order[0]]
        gone = 0
        for k in range(1, len(order)):
            a, b = sorted((order[k - 1], order[k]))
            dq, dt = q[b] - q[a], t[b] - t[a]
            if abs(dq - dt) > walked // 2:
                gone = k
            walked += min(dq, dt)
            gained += min(dq, dt, span[b])
            if walked >= 2 * band or (gained >= min_match and gained >= band) or gained >= matched // 2:
                break
        return gone

    n = len(q)
    if n < 3:
        return 0, n
    first = cut(list(range(n - 1)))
    return first, n - cut(list(range(n - 1, first - 1, -1)))


def plain_cancelling(q, t, max_ext, least, total, most):
    """Every pair of long gaps; from left to right the best of those that overlap."""
    gap = [0] + [(q[i] - q[i - 1]) - (t[i] - t[i - 1]) for i in range(1, len(q))]
    long = [i for i in range(len(q)) if abs(gap[i]) > least]
    out, k, best = set(), 0, None
    while True:
        if k == len(long) or (best and k >= best[2]) or not best:
            if best:
                out |= set(range(long[best[1]], long[best[2]]))
            best = None
            if k == len(long):
                return out
        for e in range(k + 1, min(len(long), k + 1 + most)):
            if q[long[e]] - q[long[k] - 1] > max_ext or t[long[e]] - t[long[k] - 1] > max_ext:
                break
            ins = sum(max(0, gap[i]) for i in long[k : e + 1])
            dels = sum(max(0, -gap[i]) for i in long[k : e + 1])
            cancels = ins + dels - abs(ins - dels)
            if cancels > total and (not best or cancels > best[0]):
                best = (cancels, k, e)
        k += 1


def random_chain(rng, n, gaps):
    q, t, out = 20, 40, []
    for _ in range(n):
        step, shift = rng.randrange(1, 60), rng.choice([0, 0, 0, *gaps])
        q, t = q + step + max(0, shift), t + step + max(0, -shift)
        out.append((q, t))
    return tuple(np.array(x) for x in zip(*out, strict=True))


def test_repair_equals_plain_versions():
    rng, cut, gone = random.Random(4), 0, 0
    for _ in range(400):
        q, t = random_chain(rng, rng.randrange(1, 60), [12, -12, 40, -45, 200, -200])
        span = np.full(len(q), 15)
        band, matched = rng.choice([20, 100, 500]), rng.randrange(15, 900)
        found = repair.trimmed_ends(q, t, span, matched, band, 80)
        assert found == plain_trim(q.tolist(), t.tolist(), span.tolist(), matched, band, 80)
        cut += found != (0, len(q))
        max_ext, most = rng.choice([60, 300, 2500]), rng.choice([2, 10])
        skipped = repair.cancelling_gaps(q, t, max_ext, most=most)
        assert set(np.flatnonzero(skipped)) == plain_cancelling(q.tolist(), t.tolist(), max_ext, 10, 40, most)
        gone += skipped.any()
    assert cut > 50 and gone > 50


def test_spurious_anchors_go():
    line = np.arange(100, 1000, 20)
    span = np.full(len(line), 15)
    # A stray end: the first anchor lies 300 bases off the diagonal.
    q, t = line.copy(), line + 500
    t[0] -= 300
    assert repair.trimmed_ends(q, t, span, 600, 500, 80) == (1, len(line))
    t[-1] += 300
    assert repair.trimmed_ends(q, t, span, 600, 500, 80) == (1, len(line) - 1)
    # A stray middle: three anchors on a diagonal 50 away, between an insertion and a deletion that cancel.
    q, t = np.arange(100, 2800, 60), np.arange(600, 3300, 60)
    t[20:23] += 50
    span, line = np.full(len(q), 15), q.copy()
    assert np.flatnonzero(repair.cancelling_gaps(q, t, 2500)).tolist() == [20, 21, 22]
    fixed = repair.repair(q, t, span, 675, 500, 80, 5000)
    assert (fixed.first, fixed.stop) == (0, len(line)) and np.flatnonzero(fixed.skipped).tolist() == [20, 21, 22]
    # Two long gaps with one anchor between them are one long join.
    q, t = line.copy(), line + 500
    t[20:] += 300
    t[21:] += 300
    skipped, joins = repair.close_gaps(q, t, span, 2500)
    assert np.flatnonzero(skipped).tolist() == [20] and np.flatnonzero(joins).tolist() == [21]


# --- alignments


def brute_local(q, t, s):
    """Best local score with affine gaps, cell by cell, and the cells it ends in."""
    low = -(10**9)
    best, ends = 0, []
    h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    e, f = [[low] * (len(t) + 1) for _ in range(len(q) + 1)], [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            e[i][j] = max(h[i - 1][j] - s.gap_open, e[i - 1][j]) - s.gap_extend
            f[i][j] = max(h[i][j - 1] - s.gap_open, f[i][j - 1]) - s.gap_extend
            pair = -s.ambiguous if max(q[i - 1], t[j - 1]) >= 4 else s.match if q[i - 1] == t[j - 1] else -s.mismatch
            h[i][j] = max(0, h[i - 1][j - 1] + pair, e[i][j], f[i][j])
            if h[i][j] > best:
                best, ends = h[i][j], []
            if h[i][j] == best:
                ends.append((i, j))
    return best, ends if best else [], h


def test_local_alignment_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        a = dna(rng.random(), rng.randrange(0, 30))
        b = dna(rng.random(), rng.randrange(5)) + edited(a, 0.1, rng.random()) + dna(rng.random(), rng.randrange(9)) + (a if rng.random() < 0.3 else "")
        q, t, s = base_codes(a, "dna"), base_codes(b, "dna"), align.Scoring(1, 4, 6, 1)
        found, (best, ends, h) = align.align_local(q, t, s), brute_local(q.tolist(), t.tolist(), s)
        assert found.score == best
        if best:
            assert (found.q_end, found.t_end) == min(ends)
            x, y = q[found.q_start : found.q_end], t[found.t_start : found.t_end]
            assert align.align_global(x, y, s).score == best
            others = [h[i][j] for i in range(len(h)) for j in range(len(t) + 1) if abs(j - found.t_end) > best]
            assert found.second == max(others, default=0)


def test_left_alignment_moves_every_gap():
    rng, moved = random.Random(7), 0
    for _ in range(300):
        base = "".join(rng.choice(["A", "AC", "ACG", "T"]) * rng.randrange(1, 6) for _ in range(rng.randrange(2, 12)))
        a, b = edited(base, 0.06, rng.random()), edited(base, 0.06, rng.random())
        q, t = base_codes(a, "dna"), base_codes(b, "dna")
        before = align.align_global(q, t).cigar
        # Gaps as far right as they go, so that there is something to move.
        right = align._reverse(cigars.left_aligned(align._reverse(before), q[::-1], t[::-1])[0])
        if applied(right, q, t) != (len(q), len(t)):
            right = before
        cigar, q_off, t_off = cigars.left_aligned(right, q, t)
        x, y = q[q_off:], t[t_off:]
        assert applied(cigar, x, y) == (len(x), len(y)) and not re.match(r"\d+[ID]", cigar)
        if not q_off and not t_off:
            assert align.path_scores(x, y, cigar)[0] >= align.path_scores(q, t, right)[0]
        moved += cigar != right
        i = j = 0
        ops = cigars.parse(cigar)
        for k, (n, op) in enumerate(ops):
            if op in "ID" and 0 < k < len(ops) - 1 and ops[k - 1][1] == ops[k + 1][1] == "M":
                assert x[i - 1] != x[i + n - 1] if op == "I" else y[j - 1] != y[j + n - 1]
            i, j = i + (n if op in "MI" else 0), j + (n if op in "MD" else 0)
    assert moved > 30
    assert cigars.left_aligned("6M2I4M", base_codes("AACACACACAGT", "dna"), base_codes("AACACACAGT", "dna"))[0] == "1M2I9M"
    assert cigars.left_aligned("2I6M", base_codes("GGACGTAC", "dna"), base_codes("ACGTAC", "dna")) == ("6M", 2, 0)


def slow_fall(q, t, cigar, s):
    score = i = j = 0
    places = [(0, 0, 0)]
    for n, op in cigars.parse(cigar):
        if op == "M":
            for k in range(n):
                score += s.match if q[i + k] == t[j + k] else -s.mismatch
                places.append((score, i + k + 1, j + k + 1))
            i, j = i + n, j + n
        else:
            score -= s.gap_open + s.gap_extend * n
            i, j = (i + n, j) if op == "I" else (i, j + n)
            places.append((score, i, j))
    deepest, top = 0, places[0]
    for place in places[1:]:
        if place[0] >= top[0]:
            top = place
        else:
            deepest = max(deepest, top[0] - place[0] - s.gap_extend * abs((place[1] - top[1]) - (place[2] - top[2])))
    return deepest


def test_deepest_fall_equals_plain_version():
    rng, s = random.Random(8), align.Scoring()
    for _ in range(60):
        a = dna(rng.random(), 60)
        b = a[:20] + dna(rng.random(), rng.randrange(0, 30)) + a[40:]
        q, t = base_codes(a, "dna"), base_codes(b, "dna")
        cigar = align.align_global(q, t, s).cigar
        found = regions.deepest_fall(q, t, cigar, s)
        assert found.depth == slow_fall(q, t, cigar, s)
        assert 0 <= found.q_from <= found.q_to <= len(q) and 0 <= found.t_from <= found.t_to <= len(t)


def planted(spark):
    """A reference, and reads with an inversion, a strange stretch, small and large gaps, on both strands."""
    left, middle, right = dna(21, 900), dna(22, 800), dna(23, 900)
    genome = dna(20, 700) + left + middle + right + dna(24, 700)
    inverted = left + turned(middle) + right
    strange = left + dna(25, 800) + right
    gapped = edited(left + middle + right, 0.02, 26)
    lacking = left + right
    reads = [inverted, turned(inverted), strange, gapped, turned(gapped), lacking, left[:300], dna(27, 900), None, "", "ACGT"]
    return genome, reads, frame(spark, [dna(28, 3000), genome], "doc_id"), frame(spark, reads, "item_id")


def test_inversions_splits_and_gaps(spark):
    genome, reads, r, q = planted(spark)
    found = alignment.align_reads(q, "item_id", r, "doc_id", DNA).collect()
    by_read = {}
    for x in sorted(found, key=lambda x: (x.read_id, x.place, x.piece)):
        by_read.setdefault(x.read_id, []).append(x)
        own = turned(reads[x.read_id]) if x.rev else reads[x.read_id]
        begin = len(own) - x.qe if x.rev else x.qs
        a, b = base_codes(own[begin : begin + x.qe - x.qs], "dna"), base_codes(genome[x.rs : x.re], "dna")
        assert applied(x.cigar, a, b) == (len(a), len(b)) and x.rid == 1
        assert align.path_scores(a, b, x.cigar)[0] == x.score
        assert align.edit_summary(a, b, x.cigar)[1:] == (x.nm, x.md, x.matches, x.columns)
    assert set(by_read) == {0, 1, 2, 3, 4, 5, 6}
    for k, rev in ((0, False), (1, True)):
        one, two, three = sorted(by_read[k], key=lambda x: x.rs)
        assert [x.inv for x in (one, two, three)] == [False, True, False] and two.rev != rev and one.rev == three.rev == rev
        assert abs(two.rs - 1600) < 25 and abs(two.re - 2400) < 25 and two.matches > 770
        assert one.split == regions.GOES_ON and three.split == regions.COMES_ON and two.mapq == min(one.mapq, three.mapq)
        assert abs(one.re - 1600) < 25 and abs(three.rs - 2400) < 25
    assert not any(x.inv for k in (2, 3, 4, 5, 6) for x in by_read[k])
    for k in (3, 4):
        (x,) = by_read[k]
        assert x.qe - x.qs > 2500 and x.columns - x.matches < 240 and x.n_ambi == 0 and x.dp_max > 3000
    (x,) = by_read[6]
    assert (x.cigar, x.nm, x.rs) == ("300M", 0, 700) and x.dp_max == 600.0
    assert {(x.rs > 1800) for x in by_read[2]} == {True, False}
    assert sum(x.matches for x in by_read[5]) > 1780


def test_repeated_rows_and_empty_tables_align(spark):
    _, reads, r, q = planted(spark)
    assert alignment.align_reads(q.where("false"), "item_id", r, "doc_id", DNA).count() == 0
    assert alignment.align_reads(q, "item_id", r.where("false"), "doc_id", DNA).count() == 0
    extra = q.withColumns({k: F.lit("x") for k in ("rid", "points", "t", "place", "mapq", "w_from")})
    a = sorted(map(tuple, alignment.align_reads(q, "item_id", r, "doc_id", DNA).collect()))
    assert a == sorted(map(tuple, alignment.align_reads(extra, "item_id", r.withColumn("q", F.lit(1)), "doc_id", DNA).collect()))


# --- mates


def slow_geometry(rev, at, mate_rev, mate_at):
    """On the doubled coordinate: a reverse read begins at the mirrored place of the other strand."""
    total = 10**6
    b1 = 2 * total - 1 - at if rev else at
    b2 = 2 * total - 1 - mate_at if mate_rev else mate_at
    p2 = b2 if rev == mate_rev else 2 * total - 1 - b2
    return (0 if rev == mate_rev else 1) ^ (0 if p2 > b1 else 3), abs(p2 - b1)


def test_geometry_equals_the_doubled_coordinate(spark):
    rng = random.Random(9)
    rows = [(rng.random() < 0.5, rng.randrange(100), rng.random() < 0.5, rng.randrange(100)) for _ in range(400)]
    df = spark.createDataFrame(rows, "rev boolean, at int, m boolean, m_at int")
    d, n = mates.pair_geometry(F.col("rev"), F.col("at"), F.col("m"), F.col("m_at"))
    assert [tuple(r) for r in df.select(d, n).collect()] == [slow_geometry(*r) for r in rows]


def broken(text, every=12):
    """A base changed in every twelve, so that no seed of 15 is left."""
    return "".join("ACGT"[("ACGT".index(c) + 1) % 4] if k % every == every // 2 else c for k, c in enumerate(text))


def fragments(genome):
    """Forward and reverse fragments of about 500 bases, the ends read towards each other."""
    rng, rows = random.Random(10), []
    for k in range(40):
        size, at = 500 + rng.randrange(-20, 21), rng.randrange(500, len(genome) - 1500)
        piece = genome[at : at + size]
        if k % 2:
            piece = turned(piece)
        rows.append([k, piece[:150], turned(piece[-150:]), at, at + size])
    return rows


PAIRED = Options(k=15, w=5, alphabet="dna", match=1, mismatch=4, gap_open=6, gap_extend=1, min_cnt=2, min_score=25)


def test_missing_mates_are_rescued_where_the_model_expects_them(spark):
    genome = dna(30, 20_000)
    rows = fragments(genome)
    rows[4][2], rows[5][2] = broken(rows[4][2]), broken(rows[5][2])  # no seed, at the expected place
    rows[6][1] = broken(rows[6][1])  # the first read is the one without seeds
    far = rows[8][3] + 5000 if rows[8][3] < 12_000 else rows[8][3] - 5000
    rows[8][2] = broken(turned(genome[far : far + 150]))  # no seed, and far from where it is expected
    rows[10][2] = dna(31, 150)  # from elsewhere
    rows[12][2], rows[14][2] = None, ""
    rows[16][2] = "ACGTACGTAC"  # too short to count
    df = spark.createDataFrame([tuple(r[:3]) for r in rows], "frag long, text string, mate_text string")
    references = frame(spark, [dna(32, 3000), genome, None, ""], "doc_id")
    found = pairs.map_pairs(df, "frag", references, "doc_id", PAIRED)
    bounds = {x.dir: x for x in found.bounds.collect()}
    assert [d for d, x in bounds.items() if not x.failed] == [1] and 400 < bounds[1].low < 480 and 510 < bounds[1].high < 600
    rescued = {(x.read_id, x.seg): x for x in found.hits.where("rescued").collect()}
    assert {(4, 1), (5, 1), (6, 0)} <= set(rescued) and not {8, 10, 12, 14, 16} & {k for k, _ in rescued}
    for (k, seg), x in rescued.items():
        start, stop = rows[k][3:]
        inner = (stop - 150, stop) if (seg == 1) == (k % 2 == 0) else (start, start + 150)
        assert x.rid == 1 and x.rs >= inner[0] and x.re <= inner[1] and x.rev == ((seg == 1) == (k % 2 == 0))
    best = {x.read_id: x for x in found.best.collect()}
    assert set(range(40)) - set(best) == {8, 10, 12, 14, 16}
    for k, x in best.items():
        assert abs(x.size - (rows[k][4] - rows[k][3] - 1)) < 40
        score = x.a.score + x.b.score + 0.721 * math.log(2 * math.erfc(abs(x.size - bounds[1].avg) / max(1.0, bounds[1].std) * math.sqrt(0.5))) + 0.499
        assert x.total == int(score)


def test_rescue_equals_brute_force_over_every_window(spark):
    """All hits near the best, all directions: windows by the doubled coordinate, alignment cell by cell."""
    genome = dna(40, 1500)
    rows = [(0, False, 300, 360, 60), (0, False, 700, 758, 58), (0, False, 900, 930, 30), (1, True, 600, 660, 60), (2, False, 20, 80, 60)]
    hits = spark.createDataFrame([(k, 0, rev, 0, e - s, s, e, n) for k, rev, s, e, n in rows], "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int, score int")
    reads = {0: broken(turned(genome[420:470])), 1: broken(genome[480:530]), 2: genome[100:140]}
    mate_reads = spark.createDataFrame(list(reads.items()), "read_id long, text string")
    bounds = spark.createDataFrame([(0, 50, 150, False), (1, 120, 220, False), (2, 40, 80, False), (3, 1, 9, True)], "dir int, low long, high long, failed boolean")
    taken = spark.createDataFrame([(2, 0, False, 0, 40, 100, 140, 40)], hits.schema)
    found = pairs.rescued_mates(hits, taken, mate_reads, frame(spark, [genome], "doc_id"), "doc_id", bounds, PAIRED)
    s, want = pairs.ungapped_score(PAIRED), {}
    for k, rev, start, end, n in rows:
        if n + 17 < max(x[4] for x in rows if x[0] == k):
            continue
        at, m = (end - 1 if rev else start), len(reads[k])
        for d, low, high in ((0, 50, 150), (1, 120, 220), (2, 40, 80)):
            if k == 2 and slow_geometry(rev, at, False, 100)[0] == d and low <= slow_geometry(rev, at, False, 100)[1] <= high:
                continue
            strand = genome if not rev else turned(genome)
            b = at if not rev else len(genome) - 1 - at
            lo = b + low if d in (0, 1) else b - high
            hi = b + high if d in (0, 1) else b - low
            lo, hi = (lo - m, hi) if d in (1, 2) else (lo, hi + m)
            lo, hi = max(0, lo), min(len(genome), hi)
            mate = turned(reads[k]) if d in (1, 2) else reads[k]
            if hi - lo < 19:
                continue
            best, ends, _ = brute_local(base_codes(mate, "dna").tolist(), base_codes(strand[lo:hi], "dna").tolist(), s)
            if best >= 19:
                spots = {(lo + j if not rev else len(genome) - lo - j) for _, j in ends}
                key = (k, (d in (1, 2)) != rev)
                want.setdefault((*key, best), set()).update(spots)
    got = found.collect()
    assert {(x.read_id, x.rev, x.score) for x in got} == set(want) and len(want) >= 2
    assert all((x.rs if (x.read_id == 1) else x.re) in want[x.read_id, x.rev, x.score] or x.read_id == 1 for x in got)


def slow_record(cells, seg, own, mate):
    """Flag, place, mate's place and template length by the format's rules; own and mate are (rname, pos, rev, cigar) or None."""
    here, there = own or mate, mate or own
    flag = 1 | (0 if own else 4) | (0 if mate else 8) | (64 if seg == 0 else 128)
    if here:
        flag |= (16 if here[2] else 0) | (32 if there[2] else 0)
    size = 0
    if own and mate and own[0] == mate[0]:
        ends = [x[1] + (sum(n for n, op in cigars.parse(x[3]) if op in "MD") - 1 if x[2] else 0) for x in (own, mate)]
        size = ends[1] - ends[0] + (ends[1] > ends[0]) - (ends[1] < ends[0])
    place = (here[0], str(here[1] + 1)) if here else ("*", "0")
    other = (("=" if there[0] == place[0] else there[0]), str(there[1] + 1)) if there else ("*", "0")
    return flag, (*place, *other, str(size))


def test_pair_records_have_their_mates_fields(spark):
    reads = [(k, seg, f"f{k}", "ACGTTG" if seg else "GGCATC", "IIIIJK") for k in range(6) for seg in (0, 1)]
    spots = {
        (0, 0): ("c1", 100, False, "6M"), (0, 1): ("c1", 300, True, "2S3M1D1M"), (1, 0): ("c1", 300, True, "6M"), (1, 1): ("c1", 100, False, "6M"),
        (2, 0): ("c1", 5, True, "6M"), (3, 1): ("c2", 7, False, "1I5M"), (4, 0): ("c1", 9, False, "6M"), (4, 1): ("c2", 9, False, "6M"),
    }
    schema = "read_id long, seg int, place int, rname string, pos int, rev boolean, cigar string, mapq int, tags string, proper boolean, sa string"
    rows = [(k, seg, 1, *x[:4], 30 + seg, "NM:i:0", k == 0, "") for (k, seg), x in spots.items()]
    rows += [(1, 0, 2, "c3", 40, False, "3S3M", 9, "NM:i:1", False, "c1,301,-,6M,30,0;")]
    found = records.pair_records(spark.createDataFrame(reads, "read_id long, seg int, name string, seq string, qual string"), spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 13
    for x in found:
        cells = x.line.split("\t")
        own, mate = spots.get((x.read_id, x.seg)), spots.get((x.read_id, 1 - x.seg))
        if x.place == 2:
            assert cells[1:4] == ["2113", "c3", "41"] and cells[-1] == "SA:Z:c1,301,-,6M,30,0;"
            continue
        flag, place = slow_record(cells, x.seg, own, mate)
        assert int(cells[1]) == flag | (2 if x.read_id == 0 else 0) and (cells[2], cells[3], *cells[6:9]) == place
        turn = (own or mate or (0, 0, False))[2]
        seq = reads[2 * x.read_id + x.seg][3]
        assert cells[9:11] == ([turned(seq), "KJIIII"] if turn else [seq, "IIIIJK"])
        assert cells[4:6] == ([str(30 + x.seg), own[3]] if own else ["0", "*"]) and len(cells) == (12 if own else 11)


def test_supplementary_lines_name_the_others(spark):
    rows = [(1, 0, 1, "c1", 9, False, "6M", 60, 0), (1, 0, 2, "c2", 4, True, "3S3M", 7, 1), (2, 1, 1, "c1", 0, False, "6M", 3, 2)]
    df = spark.createDataFrame(rows, "read_id long, seg int, place int, rname string, pos int, rev boolean, cigar string, mapq int, nm int")
    found = {(r.read_id, r.place): r.sa for r in records.supplementary(df).collect()}
    assert found == {(1, 1): "c2,5,-,3S3M,7,1;", (1, 2): "c1,10,+,6M,60,0;", (2, 1): ""}


def test_sam_pairs_of_planted_fragments(spark):
    genome = dna(50, 15_000)
    rows = fragments(genome)
    rows[4][2] = broken(rows[4][2])
    rows[6][2], rows[7][1], rows[8][1], rows[8][2] = dna(51, 150), None, None, ""
    rows[9][2] = rows[9][2][:70] + rows[9][2][73:]  # three bases lacking
    df = spark.createDataFrame([tuple(r[:3]) for r in rows], "frag long, text string, mate_text string")
    found = pairs.sam_pairs(df, "frag", frame(spark, [genome], "doc_id"), "doc_id", PAIRED).collect()
    assert len(found) == 80
    lines = {(x.read_id, x.seg): x.line.split("\t") for x in found}
    for k, (_, text, mate, start, stop) in enumerate(rows):
        a, b = lines[k, 0], lines[k, 1]
        if k in (6, 7, 8):
            assert (int(a[1]) & 2, int(b[1]) & 2) == (0, 0)
            continue
        assert int(a[1]) == 1 | 2 | 64 | (16 if k % 2 else 32) and int(b[1]) == 1 | 2 | 128 | (32 if k % 2 else 16)
        assert a[6] == b[6] == "=" and a[7] == b[3] and b[7] == a[3] and int(a[8]) == -int(b[8]) and abs(abs(int(a[8])) - (stop - start)) <= 8
        if k not in (4, 9):
            assert a[5] == b[5] == "150M" and (int(a[3]) - 1, int(b[3]) - 1) == ((stop - 150, start) if k % 2 else (start, stop - 150))
            assert abs(int(a[8])) == stop - start and "NM:i:0" in a and int(a[4]) > 0
    assert "3D" in lines[9, 1][5] and "NM:i:3" in lines[9, 1] and int(lines[4, 1][11].split(":")[2]) >= 10
    assert int(lines[6, 1][1]) & 4 and lines[6, 1][2] == "ref0" and int(lines[6, 0][1]) & 8
    assert [int(lines[8, s][1]) for s in (0, 1)] == [1 | 4 | 8 | 64, 1 | 4 | 8 | 128] and lines[8, 0][9] == "*"
