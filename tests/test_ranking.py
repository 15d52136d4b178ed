"""Marking in two rounds, several index parts and seed quality, against plain versions."""

import random

import numpy as np

from strandloom import alignment_queries  # noqa: F401  registers its queries
from strandloom.functions.sequence import base_codes
from strandloom.jobs import mapping, parts, seed_quality
from strandloom.jobs.options import Options
from strandloom.operators import align, hits
from strandloom.queries import QUERIES
from tests.test_alignment import brute_local
from tests.test_mapping import frame, words

DATA = "/root/testdata/sf0.001"


def plain_rounds(rows, mask, near):
    """rows (qs, qe, score, alt) in rank order: dictionaries of one hit each, marked round by round."""
    made = [{"i": i, "qs": a, "qe": b, "score": c, "alt": d, "parent": None, "first": None, "sub": 0, "sub_n": 0, "alt_score": 0} for i, (a, b, c, d) in enumerate(rows)]

    def mark(some):
        tops = []
        for x in some:
            for p in tops:
                shared = min(p["qe"], x["qe"]) - max(p["qs"], x["qs"])
                if shared > 0 and shared >= mask * min(p["qe"] - p["qs"], x["qe"] - x["qs"]):
                    if p["sub"] == 0:
                        p["sub"] = x["score"]
                    if p["score"] - x["score"] <= near and not (x["alt"] and not p["alt"]):
                        p["sub_n"] += 1
                    x["parent"] = p["i"]
                    break
            else:
                tops.append(x)

    mark(made)
    for x in made:
        x["first"] = x["parent"]
        if x["parent"] is not None and not x["alt"] and made[x["parent"]]["alt"]:
            x["alt_score"] = made[x["parent"]]["score"]
    main = [x for x in made if not x["alt"]]
    if main and len(main) < len(made):
        for x in main:
            x["sub"], x["parent"] = 0, None
        mark(main)
    return [(x["parent"], x["first"], x["sub"], x["sub_n"], x["alt_score"]) for x in made]


def test_rounds_equal_plain_recurrence():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(a := rng.randrange(80), a + rng.randrange(1, 60), 0, rng.random() < rng.choice([0, 0.4, 1])) for _ in range(rng.randrange(1, 12))]
        scores = sorted((rng.randrange(20, 60) for _ in rows), reverse=True)
        rows = [(a, b, s, d) for (a, b, _, d), s in zip(rows, scores, strict=True)]
        found = hits.mark_in_rounds(*(np.array(v) for v in zip(*rows, strict=True)))
        none = lambda v: [None if x < 0 else x for x in v.tolist()]
        got = list(zip(none(found.parent), none(found.first_parent), found.sub.tolist(), found.sub_n.tolist(), found.alt_score.tolist(), strict=True))
        assert got == plain_rounds(rows, 0.5, 7)


def test_marked_query_equals_plain_recurrence(spark):
    rows = QUERIES["hits_marked_in_rounds"](spark, DATA).collect()
    by_read = {}
    for x in rows:
        by_read.setdefault(x.read_id, []).append(x)
    for found in by_read.values():
        found.sort(key=lambda x: (-x.score, x.is_alt, x.rid, x.rev, x.rs, x.qs, x.qe, x.re))
        assert [x.place for x in found] == list(range(1, len(found) + 1))
        less = lambda v: None if v is None else v - 1
        got = [(less(x.parent), less(x.first_parent), x.sub, x.sub_n, x.alt_score) for x in found]
        assert got == plain_rounds([(x.qs, x.qe, x.score, x.is_alt) for x in found], 0.5, 7)
    assert sorted((x.read_id, x.rid, x.rs) for x in rows) == sorted((x.read_id, x.rid, x.rs) for x in QUERIES["map_regions"](spark, DATA).collect())


def test_alternatives_give_way(spark):
    """A hit on an alternative sequence outranks the one on the main sequence, which is primary all the same."""
    schema = "read_id long, rid long, rev boolean, qs int, qe int, rs int, re int, score int, is_alt boolean"
    df = spark.createDataFrame([(1, 9, False, 0, 100, 0, 100, 90, True), (1, 1, False, 0, 100, 5, 105, 85, False), (1, 2, False, 10, 90, 0, 80, 60, False), (2, 1, False, 0, 50, 0, 50, 40, True)], schema)
    found = {(r.read_id, r.rid): r for r in hits.mark_primaries(df).collect()}
    assert found[1, 9].parent is None and found[1, 1].parent is None and found[1, 1].first_parent == 1
    assert found[1, 1].alt_score == 90 and found[1, 2].parent == 2 and found[1, 1].sub == 60 and found[2, 1].parent is None
    assert hits.mark_primaries(df.where("false")).count() == 0


def test_parts_equal_one_index(spark):
    passage = words(1, 240)
    texts = [words(10 + k, 200) + passage[: 240 - 10 * k] + words(40 + k, 200) for k in range(9)] + [None, ""]
    reads = [passage, passage[40:200], words(2, 200), None, ""]
    q, r = frame(spark, reads, "item_id"), frame(spark, texts, "doc_id")
    one = sorted(map(tuple, mapping.map_primary(q, "item_id", r, "doc_id").collect()))
    for n in (1, 3, 20):
        assert sorted(map(tuple, parts.map_by_parts(q, "item_id", r, "doc_id", n).collect())) == one
    assert one and len({x[2] for x in one}) > 3


def test_parts_of_the_given_tables_equal_one_index(spark):
    one, three = (sorted(map(tuple, QUERIES[n](spark, DATA).drop("mapq").collect())) for n in ("primary_hits", "primary_hits_by_parts"))
    assert one == three and one


def test_seed_scores_equal_brute_force(spark):
    found = QUERIES["scored_seeds"](spark, DATA).collect()
    reads = {r.item_id: base_codes(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    texts = {r.doc_id: base_codes(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    s, checked = align.Scoring(1, 4, 6, 1), 0
    assert len(found) == QUERIES["exact_matches"](spark, DATA).count()
    for x in found:
        q, t = reads[x.read_id], texts[x.rid]
        q = align._turned(q) if x.rev else q
        a, b = q[max(0, x.qbeg - 50) : x.qend + 50], t[max(0, x.rbeg - 50) : x.rbeg + x.qend - x.qbeg + 50]
        if x.qend - x.qbeg >= 200 or len(a) >= 200 or len(b) >= 200:
            assert x.seed_score == x.qend - x.qbeg and x.good
            continue
        least = int(5.5 * np.log(len(q)) + 0.499)
        assert x.good == (x.seed_score >= least or 5.5 * np.log(len(q)) > len(q))
        if checked < 60:  # cell by cell for these, the row kernel equals it elsewhere
            assert x.seed_score == brute_local(a.tolist(), b.tolist(), s)[0]
            checked += 1
    assert checked >= 10


def test_seed_scores_of_planted_matches(spark):
    shared, stray = words(5, 120), words(6, 24)
    texts = [words(7, 300) + shared + words(8, 300), words(9, 300) + stray + words(11, 300)]
    read = words(12, 700) + shared + words(13, 500) + stray + words(14, 800)
    q, r = frame(spark, [read, None, ""], "item_id"), frame(spark, texts, "doc_id")
    matches = spark.createDataFrame([(0, 0, False, 700, 820, 300), (0, 1, False, 1320, 1344, 300)], "read_id long, rid long, rev boolean, qbeg int, qend int, rbeg int")
    scored = {x.rid: x for x in seed_quality.score_seeds(matches, q, "item_id", r, "doc_id").collect()}
    assert scored[0].seed_score == 120 and scored[0].good and not scored[1].good and 24 <= scored[1].seed_score < 42
    short = {x.rid: x for x in seed_quality.score_seeds(matches, q, "item_id", r, "doc_id", short_part=0.01).collect()}
    assert short[1].good and short[1].seed_score == scored[1].seed_score
    weighed = {x.rid: x for x in seed_quality.score_seeds(matches, q, "item_id", r, "doc_id", min_weight=10).collect()}
    assert weighed[1].good
    assert seed_quality.score_seeds(matches.where("false"), q, "item_id", r, "doc_id").count() == 0
    assert Options().max_occ == 0
