"""The registered alignment queries against plain versions over the smallest given tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import alignment_queries as aq
from strandloom.functions.sequence import base_codes
from strandloom.jobs import mapping, pairs
from strandloom.operators import align, chains, gaps, hits, mates, repair
from strandloom.queries import QUERIES
from tests.test_alignment import applied, brute_local, plain_cancelling, plain_trim, slow_geometry, turned
from tests.test_gaps import five_matrices, path_cost, slow_sites, spliced_matrices

DATA = "/root/testdata/sf0.001"


def letters(text):
    return "".join("ACGT"[ord(c) % 4] for c in text)


@pytest.fixture(scope="module")
def tables(spark):
    found = spark.read.parquet(f"{DATA}/benchmark.parquet").collect(), spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return {r.item_id: letters(r.text) for r in found[0]}, {r.doc_id: letters(r.text) for r in found[1]}


def thirds(text):
    n = len(text) // 3
    return text[:n], text[n : 2 * n], text[2 * n :]


def check_regions(rows, reads, genome):
    for x in rows:
        own = turned(reads[x.read_id]) if x.rev else reads[x.read_id]
        begin = len(own) - x.qe if x.rev else x.qs
        a, b = base_codes(own[begin : begin + x.qe - x.qs], "dna"), base_codes(genome[x.rid][x.rs : x.re], "dna")
        assert applied(x.cigar, a, b) == (len(a), len(b))
        assert align.path_scores(a, b, x.cigar)[0] == x.score
        assert align.edit_summary(a, b, x.cigar)[1:] == (x.nm, x.md, x.matches, x.columns)


def test_inverted_passages_are_three_records(spark, tables):
    benchmark, genome = tables
    reads = {k: f + turned(m) + e for k, (f, m, e) in ((k, thirds(t)) for k, t in benchmark.items())}
    rows = QUERIES["inverted_passages"](spark, DATA).collect()
    check_regions(rows, reads, genome)
    whole = {(k, d): g.index(t) for k, t in benchmark.items() for d, g in genome.items() if len(t) > 180 and g.count(t) == 1}
    assert len(whole) >= 3
    for (k, d), at in whole.items():
        found = sorted((x for x in rows if (x.read_id, x.rid) == (k, d) and at - 20 <= x.rs < at + len(benchmark[k])), key=lambda x: x.rs)
        n = len(benchmark[k]) // 3
        assert [x.inv for x in found] == [False, True, False] and [x.rev for x in found] == [False, True, False]
        edges = [(at, at + n), (at + n, at + 2 * n), (at + 2 * n, at + len(benchmark[k]))]
        for x, (start, stop) in zip(found, edges, strict=True):
            # Turned bases may go on as the others do, by chance.
            assert abs(x.rs - start) < 20 and abs(x.re - stop) < 20 and x.matches >= 0.8 * (stop - start)


def test_aligned_nucleotides_cover_whole_passages(spark, tables):
    benchmark, genome = tables
    rows = QUERIES["aligned_nucleotides"](spark, DATA).collect()
    check_regions(rows, benchmark, genome)
    for k, t in benchmark.items():
        held = {d for d, g in genome.items() if t in g}
        assert not held or {x.rid for x in rows if x.read_id == k and x.cigar == f"{len(t)}M"} & held


def test_repaired_chains_equal_plain_repair(spark, tables):
    s = mapping.sketch_both(*[f for x in ((aq._reads(spark, DATA, F.concat(*aq._third()[::2])), "item_id"), (aq._genome(spark, DATA), "doc_id")) for f in x], aq.SHORT)
    found = chains.chain_again(mapping.all_anchors(s), s.lengths, 500, 20_000, points=True).collect()
    wanted = []
    for x in found:
        q, t, span = ([p[k] for p in x.points] for k in ("q", "t", "span"))
        assert len(q) == x.cnt and q == sorted(q) and t == sorted(t)
        first, stop = plain_trim(q, t, span, x.mlen, 500, 80)
        gone = {first + k for k in plain_cancelling(q[first:stop], t[first:stop], 2500, 10, 40, 10)}
        close = np.flatnonzero(repair.close_gaps(*(np.array(v[first:stop]) for v in (q, t, span)), 2500)[0]) + first
        gone |= set(close.tolist())
        left = [k for k in range(first, stop) if k not in gone]
        wanted.append((x.read_id, x.rid, x.rev, x.chain, x.cnt, x.cnt - (stop - first), len(gone), q[left[0]], t[left[0]], q[left[-1]], t[left[-1]]))
    rows = QUERIES["repaired_chains"](spark, DATA).collect()
    assert sorted((x.read_id, x.rid, x.rev, x.chain, x.cnt, x.trimmed, x.skipped, x.first_q, x.first_t, x.last_q, x.last_t) for x in rows) == sorted(wanted)
    assert any(x.trimmed for x in rows)


def parts(reads, genome, rows, best):
    """Query and target bases of each row, by its hit."""
    spans = {(x.read_id, x.rid, x.rev, x.rs, x.re): (x.qs, x.qe) for x in best}
    for x in rows:
        qs, qe = spans[x.read_id, x.rid, x.rev, x.rs, x.re]
        piece = reads[x.read_id][qs:qe]
        yield x, base_codes(turned(piece) if x.rev else piece, "dna"), base_codes(genome[x.rid][x.rs : x.re], "dna")


def best_of(spark, reads):
    return mapping.map_best(reads, "item_id", aq._genome(spark, DATA), "doc_id", aq.SHORT).where("place = 1").collect()


def test_long_gaps_equal_five_matrices(spark, tables):
    benchmark, genome = tables
    frame = aq._reads(spark, DATA, F.concat(*aq._third()[::2]))
    reads = {k: thirds(t)[0] + thirds(t)[2] for k, t in benchmark.items()}
    assert {r.item_id: r.text for r in frame.collect()} == reads
    rows = QUERIES["long_gap_alignments"](spark, DATA).collect()
    s = gaps.TwoGaps()
    for x, q, t in parts(reads, genome, rows, best_of(spark, frame)):
        assert x.score == five_matrices(q.tolist(), t.tolist(), s)[-1][-1] == path_cost(q.tolist(), t.tolist(), x.cigar, s)
    assert len(rows) >= 3 and any("D" in x.cigar for x in rows)


def test_spliced_passages_equal_plain_matrices(spark, tables):
    benchmark, genome = tables
    frame = aq._reads(spark, DATA, aq._without_intron())
    reads = {}
    for k, t in benchmark.items():
        begin = t.find("GT", 60)
        end = t.find("AG", begin + 40) if begin >= 0 else -1
        reads[k] = t[:begin] + t[end + 2 :] if end >= 0 else t
    assert {r.item_id: r.text for r in frame.collect()} == reads
    rows, s = QUERIES["spliced_passages"](spark, DATA).collect(), gaps.Splice()
    for x, q, t in parts(reads, genome, rows, best_of(spark, frame)):
        text = "".join("ACGT"[c] for c in t)
        sites = {f: [list(c) for c in slow_sites(text, s, f)] for f in (True, False)}
        scores = {f: spliced_matrices(q.tolist(), t.tolist(), s, sites[f]) for f in sites}
        assert x.score == max(scores.values()) and x.forward == (scores[True] == x.score)
        assert path_cost(q.tolist(), t.tolist(), x.cigar, s, sites[x.forward]) == x.score
    assert any("N" in x.cigar and x.nm == 0 for x in rows)


def test_rescued_mates_equal_brute_force(spark, tables):
    benchmark, genome = tables
    ends = {r.item_id: (r.text, r.mate_text) for r in aq._pairs(spark, DATA).collect()}
    for k, t in benchmark.items():
        tail = turned(t[-60:])
        broken = "".join("CGTA"["ACGT".index(c)] if i % 12 == 6 else c for i, c in enumerate(tail))
        assert ends[k] == (t[:60], broken if k % 5 == 0 else tail)
    rows = QUERIES["rescued_mates"](spark, DATA).collect()
    seeded = [[x for x in rows if x.seg == seg and not x.rescued] for seg in (0, 1)]
    frames = [spark.createDataFrame([tuple(x)[:-2] for x in found], "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int, score int") for found in seeded]
    bounds = [x for x in hits.pair_statistics(mates.unique_pairs(*frames), 3).collect() if not x.failed]
    assert bounds
    s, wanted = pairs.ungapped_score(aq.PAIRED), {}
    at = lambda x: x.re - 1 if x.rev else x.rs
    for seg, (own, other) in enumerate((seeded, seeded[::-1])):
        for x in own:
            if x.score + 17 < max(y.score for y in own if y.read_id == x.read_id):
                continue
            text, mate = genome[x.rid], ends[x.read_id][1 - seg]
            for b in bounds:
                met = [slow_geometry(x.rev, at(x), y.rev, at(y)) for y in other if (y.read_id, y.rid) == (x.read_id, x.rid)]
                if any(d == b.dir and b.low <= n <= b.high for d, n in met):
                    continue
                strand = turned(text) if x.rev else text
                p = len(text) - 1 - at(x) if x.rev else at(x)
                lo, hi = (p + b.low, p + b.high) if b.dir in (0, 1) else (p - b.high, p - b.low)
                lo, hi = (lo - len(mate), hi) if b.dir in (1, 2) else (lo, hi + len(mate))
                lo, hi = max(0, lo), min(len(text), hi)
                best = brute_local(base_codes(turned(mate) if b.dir in (1, 2) else mate, "dna").tolist(), base_codes(strand[lo:hi], "dna").tolist(), s)[0] if hi - lo >= 19 else 0
                if best >= 19:
                    wanted.setdefault((x.read_id, 1 - seg, x.rid, x.rev != (b.dir in (1, 2))), set()).add(best)
    found = {}
    for x in rows:
        if x.rescued:
            found.setdefault((x.read_id, x.seg, x.rid, x.rev), set()).add(x.score)
    assert found == wanted and len(wanted) >= 1
    modelled = {x.read_id: x for x in QUERIES["modelled_pairs"](spark, DATA).collect()}
    by_read = {}
    for x in rows:
        by_read.setdefault((x.read_id, x.seg), []).append(x)
    for k in ends:
        scored = []
        for a in by_read.get((k, 0), []):
            for b in by_read.get((k, 1), []):
                d, n = slow_geometry(a.rev, at(a), b.rev, at(b))
                for m in bounds:
                    if a.rid == b.rid and m.dir == d and m.low <= n <= m.high:
                        likely = 0.721 * math.log(2 * math.erfc(abs(n - m.avg) / max(1.0, m.std) * math.sqrt(0.5)))
                        scored.append(max(0, int(a.score + b.score + likely + 0.499)))
        scored.sort(reverse=True)
        assert (k in modelled) == bool(scored)
        if scored:
            assert (modelled[k].total, modelled[k].sub, modelled[k].pairs) == (scored[0], (scored + [0])[1] if len(scored) > 1 else 0, len(scored))
    assert modelled


def redone(cs, target):
    """(query, edits, gap bases of both sides) that a cs tag makes of a target, which it must agree with."""
    import re

    at, out, edits = 0, [], 0
    for op, value in re.findall(r"([:*+\-~])([a-z0-9]+)", cs):
        if op == ":":
            out.append(target[at : at + int(value)])
            at += int(value)
        elif op == "*":
            assert target[at] == value[0].upper() and value[0] != value[1]
            out.append(value[1].upper())
            at, edits = at + 1, edits + 1
        elif op == "+":
            out.append(value.upper())
            edits += len(value)
        elif op == "-":
            assert target[at : at + len(value)] == value.upper()
            at, edits = at + len(value), edits + len(value)
    assert at == len(target)
    return "".join(out), edits


def test_paf_records_make_the_query_again(spark, tables):
    benchmark, genome = tables
    reads = {k: f + turned(m) + e for k, (f, m, e) in ((k, thirds(t)) for k, t in benchmark.items())}
    rows = [r.line.split("\t") for r in QUERIES["paf_alignments"](spark, DATA).collect()]
    kinds = set()
    for cells in rows:
        name, q_len, qs, qe, strand, rid, r_len, rs, re_, matches, columns, mapq = cells[:12]
        tags = dict(x.split(":", 1) for x in cells[12:])
        read, target = reads[int(name)], genome[int(rid)]
        assert (int(q_len), int(r_len)) == (len(read), len(target)) and 0 <= int(mapq) <= 60
        part = read[int(qs) : int(qe)]
        query, edits = redone(tags["cs"][2:], target[int(rs) : int(re_)])
        assert query == (turned(part) if strand == "-" else part)
        assert edits == int(tags["NM"][2:]) == int(columns) - int(matches)
        kinds.add(tags["tp"])
    assert {"A:P", "A:I"} <= kinds and len(rows) == QUERIES["inverted_passages"](spark, DATA).count()


def test_difference_string():
    q, t = base_codes("ACGTTTGA", "dna"), base_codes("ACCTGA", "dna")
    assert align.difference_string(q, t, "4M2I2M") == ":2*cg:1+tt:2"
    assert align.difference_string(t, q, "4M2D2M") == ":2*gc:1-tt:2"
    assert align.difference_string(base_codes("ACGT", "dna"), base_codes("ACGTCCAGGT", "dna"), "2M6N2M") == ":2~gt6ag:2"
    assert align.difference_string(q, t, "") == ""
