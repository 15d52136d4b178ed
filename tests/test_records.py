"""Records, alignments and the order-dependent chainings of the registered queries against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.functions import cigar as cigars
from strandloom.functions.arrays import largest, running
from strandloom.functions.sequence import subsequence, unescape
from strandloom.jobs import mapping
from strandloom.operators import align, chains, exact, hits, intervals, records, scoring, seeds
from strandloom.queries import QUERIES
from strandloom.sources import sequences

DATA = "/root/testdata/sf0.01"


def tables(spark):
    read = lambda name, key: {r[key]: r.text for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()}
    return read("benchmark", "item_id"), read("documents", "doc_id")


def codes(text, rev=False):
    found = np.array([ord(c) % 4 for c in text], np.int64)
    return 3 - found[::-1] if rev else found


def edits(q, t, cigar):
    """(query bases, reference bases, edits, score) of a CIGAR, operation by operation."""
    i = j = nm = score = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            same = int((q[i : i + n] == t[j : j + n]).sum())
            nm, score, i, j = nm + n - same, score + 2 * same - 4 * (n - same), i + n, j + n
        else:
            nm, score = nm + n, score - 4 - 2 * n
            i, j = (i + n, j) if op == "I" else (i, j + n)
    return i, j, nm, score


def test_alignments_of_best_hits_score_as_they_say(spark):
    queries, documents = tables(spark)
    rows = QUERIES["align_passages"](spark, DATA).collect()
    best = QUERIES["whole_passages"](spark, DATA).where("place = 1").collect()
    assert {(r.read_id, r.rid, r.rev) for r in rows} == {(r.read_id, r.rid, r.rev) for r in best}
    for r in rows:
        q, t = codes(queries[r.read_id], r.rev)[r.q_start :], codes(documents[r.rid])[r.rs :]
        assert edits(q, t, r.cigar) == (r.q_end, r.t_end, r.nm, r.score)
        window = t[: len(q) + 32]
        assert r.score >= align.extend(q.astype(np.uint8), window.astype(np.uint8)).score


def test_reverse_hits_are_aligned_and_turned(spark):
    rng = random.Random(1)
    letters = "ACGT"
    reference = "".join(rng.choice(letters) for _ in range(900))
    piece = reference[300:520]
    read = piece[:100] + piece[103:]  # three bases fewer
    turned = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    # In the text alphabet A, C, G and T are 1, 3, 3 and 0: letters of all four codes are taken instead.
    as_text = str.maketrans("ACGT", "@ABC")
    queries = spark.createDataFrame([(1, read.translate(as_text)), (2, turned.translate(as_text)), (3, "@" * 200), (4, None)], "item_id long, text string")
    documents = spark.createDataFrame([(7, reference.translate(as_text))], "doc_id long, text string")
    found = mapping.map_best(queries, "item_id", documents, "doc_id").where("place = 1")
    rows = {r.read_id: r for r in mapping.align_hits(found, queries, "item_id", documents, "doc_id").collect()}
    assert set(rows) == {1, 2} and rows[2].rev and not rows[1].rev
    for r in rows.values():
        assert "3D" in r.cigar and r.nm == 3 and r.rs + r.t_end == 520
    assert rows[1].cigar == rows[2].cigar and rows[1].md == rows[2].md


def test_sam_lines_turn_reverse_reads(spark):
    reads = spark.createDataFrame([(1, "r1", "ACCGT", "abcde"), (2, "r2", "ACCGT", "abcde"), (3, "r3", "", None)], "read_id long, name string, seq string, qual string")
    one = "read_id long, rev boolean, flag int, rname string, pos int, mapq int, cigar string, tags string"
    found = spark.createDataFrame([(1, False, 0, "c", 4, 60, "5M", "NM:i:0"), (2, True, 16, "c", 4, 60, "5M", "NM:i:0")], one)
    lines = {r.read_id: r.line.split("\t") for r in records.sam_records(reads, found).collect()}
    assert lines[1] == ["r1", "0", "c", "5", "60", "5M", "*", "0", "0", "ACCGT", "abcde", "NM:i:0"]
    assert lines[2] == ["r2", "16", "c", "5", "60", "5M", "*", "0", "0", "ACGGT", "edcba", "NM:i:0"]
    assert lines[3] == ["r3", "4", "*", "0", "0", "*", "*", "0", "0", "*", "*"]


def test_sam_alignments_agree_with_the_bases(spark):
    queries, documents = tables(spark)
    for r in QUERIES["sam_alignments"](spark, DATA).collect():
        f = r.line.split("\t")
        assert f[0] == f"item{r.read_id}" and len(f[9]) == len(queries[r.read_id])
        if f[1] == "4":
            assert f[2] == f[5] == "*"
            continue
        seq = np.array(["ACGT".index(c) for c in f[9]])
        assert (seq == codes(queries[r.read_id], f[1] == "16")).all()
        lead = re.match(r"(\d+)S", f[5])
        core = re.sub(r"\d+S", "", f[5])
        i, _, nm, score = edits(seq[int(lead[1]) if lead else 0 :], codes(documents[int(f[2][3:])])[int(f[3]) - 1 :], core)
        clipped = sum(map(int, re.findall(r"(\d+)S", f[5])))
        assert i + clipped == len(seq) and f"NM:i:{nm}" in f and f"AS:i:{score}" in f and 0 <= int(f[4]) <= 60


def _anchors(spark):
    s = mapping.sketch_both(spark.read.parquet(f"{DATA}/benchmark.parquet"), "item_id", spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    out = {}
    for r in mapping.all_anchors(s).collect():
        out.setdefault((r.read_id, r.rid, r.rev), []).append((r.rpos, r.qpos, r.span))
    return {k: np.array(sorted(v)) for k, v in out.items()}


def _gain(dr, dq, span):
    dd, dg = abs(dr - dq), min(dr, dq)
    if not dd and dg <= span:
        return min(span, dg)
    cost = np.float32(0.12) * np.float32(dd)
    if dd:
        cost += np.float32(0.5) * chains.fast_log2(np.array([dd + 1]))[0]
    return min(span, dg) - int(cost)


@pytest.mark.parametrize("name", ["chain_dp", "chain_rmq"])
def test_best_chains_equal_plain_recurrence(spark, name):
    """The best chain of each read, sequence and strand scores as an unpruned recurrence over all predecessors."""
    band, reach = (500, 5000) if name == "chain_dp" else (20000, 5000)
    found = {}
    for r in QUERIES[name](spark, DATA).collect():
        key = (r.read_id, r.rid, r.rev)
        found[key] = max(found.get(key, 0), r.score)
    wanted = {}
    for key, a in _anchors(spark).items():
        best, count = a[:, 2].copy(), np.ones(len(a), int)
        for i in range(len(a)):
            near = [j for j in range(i) if 0 < a[i, 0] - a[j, 0] <= reach and 0 < a[i, 1] - a[j, 1] <= reach]
            if name == "chain_rmq":
                near = [j for j in near if a[i, 1] - a[j, 1] < reach]
                near = [max(near, key=lambda j: (best[j] + 0.06 * (a[j, 0] + a[j, 1]), -j))] if near else []  # noqa: B023
            for j in near:
                dr, dq = a[i, 0] - a[j, 0], a[i, 1] - a[j, 1]
                if abs(dr - dq) <= band and best[j] + _gain(dr, dq, a[j, 2]) > best[i]:
                    best[i], count[i] = best[j] + _gain(dr, dq, a[j, 2]), count[j] + 1
        end = int(best.argmax())
        if best[end] >= 40 and count[end] >= 3:
            wanted[key] = int(best[end])
    assert found == wanted


def test_greedy_chains_and_their_filter_equal_plain_lists(spark):
    matches = {}
    for r in QUERIES["exact_matches"](spark, DATA).collect():
        matches.setdefault((r.read_id, r.rid, r.rev), []).append((r.rbeg, r.qbeg, r.qend - r.qbeg))
    wanted, by_read = set(), {}
    for key, found in matches.items():
        lines: list[list[tuple]] = []
        for m in sorted(found):
            before = [x for x in lines if x[0][0] <= m[0]]
            if before:
                line = max(before, key=lambda x: (x[0][0], lines.index(x)))
                (r0, q0, _), (r1, q1, n1) = line[0], line[-1]
                if q0 <= m[1] and m[1] + m[2] <= q1 + n1 and r0 <= m[0] and m[0] + m[2] <= r1 + n1:
                    continue
                dq, dr = m[1] - q1, m[0] - r1
                if dq >= 0 and dr >= 0 and abs(dq - dr) <= 100 and dq - n1 < 10000 and dr - n1 < 10000:
                    line.append(m)
                    continue
            lines.insert(sum(x[0][0] <= m[0] for x in lines), [m])
        for line in lines:
            on = lambda k: len({p for m in line for p in range(m[k], m[k] + m[2])})  # noqa: B023, E731
            ends = (min(m[0] for m in line), max(m[0] + m[2] for m in line), min(m[1] for m in line), max(m[1] + m[2] for m in line))
            row = (*key, len(line), min(on(0), on(1)), *ends)
            wanted.add(row)
            by_read.setdefault(key[0], []).append(row)
    take = lambda rows: {(r.read_id, r.rid, r.rev, r.cnt, r.weight, r.rs, r.re, r.qs, r.qe) for r in rows}
    assert take(QUERIES["chain_greedy"](spark, DATA).collect()) == wanted
    kept = set()
    for rows in by_read.values():
        stay: list[tuple] = []
        for r in sorted(rows, key=lambda r: (-r[4], r[1], r[2], r[5], r[7])):
            def lost(o, r=r):
                shared, short = min(r[8], o[8]) - max(r[7], o[7]), min(r[8] - r[7], o[8] - o[7])
                return shared > 0 and shared >= short / 2 and short < 10000 and r[4] < o[4] / 2 and o[4] - r[4] >= 38
            if not any(map(lost, stay)):
                stay.append(r)
        kept |= set(stay)
    assert take(QUERIES["chain_filter"](spark, DATA).collect()) == kept


def test_reseeding_equals_counts_over_places(spark):
    places = {}
    for r in QUERIES["exact_matches"](spark, DATA).collect():
        places.setdefault((r.read_id, r.rev), []).append((r.qbeg, r.qend))
    found = QUERIES["reseed_matches"](spark, DATA).collect()
    assert found
    for r in found:
        own = places[r.read_id, r.rev]
        times = lambda s, e: sum(a <= s and b >= e for a, b in own)  # noqa: B023, E731
        assert r.occ == times(r.qbeg, r.qend) > 0 and r.qend - r.qbeg >= exact.MIN_SEED
        if r.round == 3:
            shorter = r.qend - r.qbeg == exact.MIN_SEED + 1
            assert r.occ < 20 or shorter
            assert shorter or times(r.qbeg, r.qend - 1) >= 20


def test_primary_hits_equal_pairwise_rule(spark):
    by_read = {}
    for r in QUERIES["whole_regions"](spark, DATA).collect():
        by_read.setdefault(r.read_id, []).append(r)
    wanted = {}
    for read, rows in by_read.items():
        rows.sort(key=lambda r: (-r.score, -r.cnt, r.rid, r.rev, r.rs, r.qs))
        primaries: list[int] = []
        for i, r in enumerate(rows):
            covered = set()
            for j in primaries:
                covered |= set(range(max(r.qs, rows[j].qs), min(r.qe, rows[j].qe)))
            bare = r.qe - r.qs - len(covered)
            for j in primaries:
                o = rows[j]
                shared, short, wide = min(r.qe, o.qe) - max(r.qs, o.qs), min(r.qe - r.qs, o.qe - o.qs), max(r.qe - r.qs, o.qe - o.qs)
                if shared > 0 and shared / short - bare / wide > 0.5:
                    wanted[read, i + 1] = j + 1
                    break
            else:
                primaries.append(i)
                wanted[read, i + 1] = i + 1
    rows = QUERIES["primary_hits"](spark, DATA).collect()
    assert rows and all(wanted[r.read_id, r.place] == r.parent and (r.mapq == 0 or r.place == r.parent) for r in rows)
    assert {k for k, v in wanted.items() if k[1] == v} <= {(r.read_id, r.place) for r in rows}


def perfect(seq, window=64, threshold=20):
    """Union of the stretches that score above the threshold and above or as high as all their parts."""
    def score(s, e):
        words = [tuple(seq[k : k + 3]) for k in range(s, e - 2)]
        return sum(c * (c - 1) // 2 for c in (words.count(w) for w in set(words))), len(words) - 1

    marked = set()
    for s in range(len(seq)):
        for e in range(s + 4, min(len(seq), s + window) + 1):
            total, n = score(s, e)
            if total * 10 <= threshold * n:
                continue
            parts = (score(a, b) for a in range(s, e) for b in range(a + 4, e + 1) if (a, b) != (s, e))
            if all(x * n <= total * m for x, m in parts):
                marked |= set(range(s, e))
    return marked


def test_low_complexity_equals_perfect_stretches():
    rng = random.Random(2)
    for _ in range(40):
        seq = [rng.randrange(4) for _ in range(rng.randint(3, 14))] + rng.choice([[0] * 9, [0, 1] * 6, [2, 3, 1] * 4, []]) + [rng.randrange(4) for _ in range(rng.randint(0, 8))]
        found = {p for s, e in intervals.low_complexity(np.array(seq)) for p in range(s, e)}
        assert found == perfect(seq), seq


def test_masks_of_the_registered_queries(spark):
    queries, _ = tables(spark)
    masked = {}
    for r in QUERIES["low_complexity"](spark, DATA).collect():
        masked.setdefault(r.rid, set()).update(range(r.st, r.en))
    for rid, text in queries.items():
        found = {p for s, e in intervals.low_complexity(codes(text)) for p in range(s, e)}
        assert masked.get(rid, set()) == found
    every = QUERIES["minimizer_sketch"](spark, DATA).collect()
    wanted = {(r.rid, r.pos) for r in every if 2 * len(masked.get(r.rid, set()) & set(range(r.pos + 1 - r.span, r.pos + 1))) <= r.span}
    assert {(r.rid, r.pos) for r in QUERIES["masked_minimizers"](spark, DATA).collect()} == wanted


def test_running_totals_and_merged_cigars(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 9, 10, 17, 200])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, v array<int>").select("v", running(F.col("v")).alias("s"), running(F.col("v"), largest).alias("m"))
    for r in df.collect():
        v = r.v or []
        assert r.s == [sum(v[:i]) for i in range(len(v))] and r.m == [max([0, *v[:i]]) for i in range(len(v))]
    texts = [(None,), ("",), ("3M2M1I",), ("1M" * 500 + "2D1D",), ("4=1X2X",)]
    found = [r[0] for r in spark.createDataFrame(texts, "c string").select(cigars.merged(F.col("c"))).collect()]
    assert found == ["", "", "5M1I", "500M3D", "4=3X"]


def test_small_functions(spark):
    df = spark.createDataFrame([("@ABC@", 1, 99, True), ("@ABC@", -2, 3, False), ("@ABC@", 4, 2, False)], "t string, s int, e int, r boolean")
    assert [x[0] for x in df.select(subsequence(F.col("t"), F.col("s"), F.col("e"), F.col("r"))).collect()] == ["TACG", "ACG", ""]
    text = spark.createDataFrame([("a\\tb\\\\tc\\n",)], "t string").select(unescape(F.col("t"))).first()[0]
    assert text == "a\tb\\tc\n"
    anchors = spark.createDataFrame([(1, 1, False, 5, 5), (1, 1, False, 9, 5), (2, 1, True, 5, 5), (1, 2, False, 1, 1)], "read_id long, rid long, rev boolean, rpos int, qpos int")
    assert seeds.skip_pairs(anchors, no_diagonal=True).count() == 3 and seeds.skip_pairs(anchors, no_dual=True).count() == 3
    assert seeds.skip_pairs(anchors, forward=False).count() == 1 and seeds.skip_pairs(anchors, reverse=False).count() == 3


def test_seed_coverage_needs_both_axes(spark):
    found = spark.createDataFrame([(1, 1, False, 10, 60, 110, 160), (1, 1, True, 10, 60, 110, 160)], "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int")
    matches = spark.createDataFrame(
        [(1, 1, False, 10, 30, 110), (1, 1, False, 0, 20, 120), (1, 1, False, 40, 60, 150), (1, 1, True, 40, 60, 120)], "read_id long, rid long, rev boolean, qbeg int, qend int, rbeg int"
    )
    lens = spark.createDataFrame([(1, 70)], "rid long, len int")
    assert {r.rev: r.seedcov for r in scoring.seed_coverage(found, matches, lens).collect()} == {False: 20, True: 20}


def test_hit_markers(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 1, 1)], "read_id long, place int, parent int")
    assert {(r.read_id, r.place) for r in hits.first_primary(rows).where("sam_pri").collect()} == {(1, 1), (2, 1)}


def test_files_of_pairs_holes_and_ordered_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@x/1\nACGT\n+\nIIII\n@y/1\nAAAA\n+\nIIII\n@z/1\nCCCC\n+\nIIII\n")
    (tmp_path / "b.fq").write_text("@y/2\nTTTT\n+\nJJJJ\n@x/2\nGGGG\n+\nJJJJ\n")
    paired = records.pair_reads(sequences.read_fastq(spark, str(tmp_path / "a.fq")), sequences.read_fastq(spark, str(tmp_path / "b.fq")))
    assert {(r.fragment, r.seq, r.mate_seq) for r in paired.collect()} == {("x", "ACGT", "GGGG"), ("y", "AAAA", "TTTT"), ("z", "CCCC", None)}
    (tmp_path / "i.ann").write_text("30 2 11\n0 chr1 first one\n0 20 1\n0 chr2 (null)\n20 10 0\n")
    (tmp_path / "i.amb").write_text("30 2 1\n3 4 N\n")
    found = [tuple(r) for r in sequences.read_annotations(spark, str(tmp_path / "i.ann")).orderBy("rid").collect()]
    assert found == [(0, "chr1", "first one", 0, 20, 1), (1, "chr2", "(null)", 20, 10, 0)]
    assert [tuple(r) for r in sequences.read_holes(spark, str(tmp_path / "i.amb")).collect()] == [(3, 4, "N")]
    lines = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).withColumn("line", F.format_string("%05d", "k"))
    records.write_ordered(lines, str(tmp_path / "out"), "k")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split() == sorted(text.split()) and len(text.split()) == 500


def test_entry_has_the_record_queries():
    assert {"sam_alignments", "paired_hits"} <= set(entry.queries())
