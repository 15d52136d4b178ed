"""Bounded seeds: hot k-mers, hot reads, and the second round for reads that the first leaves without a chain."""

import pytest

from strandloom import alignment_queries  # noqa: F401  registers its queries
from strandloom.jobs import mapping, seeding
from strandloom.jobs.options import Options
from strandloom.queries import QUERIES
from tests.test_mapping import frame, words

DATA = "/root/testdata/sf0.001"


def regions(df):
    return {(r.read_id, r.rid) for r in df.collect()}


@pytest.fixture(scope="module")
def crowded(spark):
    """A passage that forty documents share, one that three share, and one of its own for a read."""
    often, seldom, own = words(1, 240), words(2, 240), words(3, 240)
    texts = [words(10 + k, 300) + often + words(60 + k, 200) for k in range(40)] + [words(110 + k, 200) + seldom for k in range(3)] + [words(120, 100) + own, None, ""]
    reads = [often, seldom, own + often, own, words(130, 240), None, "", "short"]
    return frame(spark, reads, "item_id"), frame(spark, texts, "doc_id")


def test_second_round_is_only_for_reads_without_a_chain(spark, crowded):
    reads, documents = crowded
    low = Options(min_mid_occ=5, max_mid_occ=5, max_max_occ=5)
    first = seeding.map_seeded(reads, "item_id", documents, "doc_id", low)
    assert regions(first) == {(1, k) for k in (40, 41, 42)} | {(2, 43), (3, 43)}
    covered = {r.read_id: r.rep_len for r in first.collect()}
    assert covered[1] == covered[3] == 0 and covered[2] > 200
    again = Options(min_mid_occ=5, max_mid_occ=5, max_max_occ=5, max_occ=50)
    both = seeding.map_seeded(reads, "item_id", documents, "doc_id", again)
    # Read 0 had no chain; read 2 has one, by its own part, and isn't seeded again.
    assert regions(both) == regions(first) | {(0, k) for k in range(40)}
    assert {r.rep_len for r in both.collect() if r.read_id == 0} == {0}
    too_low = Options(min_mid_occ=5, max_mid_occ=5, max_max_occ=5, max_occ=4)
    assert regions(seeding.map_seeded(reads, "item_id", documents, "doc_id", too_low)) == regions(first)


def test_some_of_a_run_of_frequent_seeds_stay(spark, crowded):
    reads, documents = crowded
    options = Options(min_mid_occ=5, max_mid_occ=5, occ_dist=20)
    s = mapping.sketch_both(reads, "item_id", documents, "doc_id", options)
    selected = seeding.select_seeds(s, options).collect()
    kept = [r for r in selected if r.rid == 0 and not r.flt]
    assert 8 <= len(kept) <= 240 // 20 + 1 and all(r.occ >= 40 for r in kept)
    # All of the forty documents are found by those that stay.
    assert {(0, k) for k in range(40)} <= regions(seeding.map_seeded(reads, "item_id", documents, "doc_id", options))


def test_hot_seeds_are_bounded(spark):
    """A k-mer that every document has, and a read that is one k-mer over and over."""
    unit = words(5, 16)
    texts = [unit * 30 + words(200 + k, 300) for k in range(60)]
    reads = [unit * 40, words(200, 300), unit + words(201, 280)]
    options = Options(min_mid_occ=10, max_mid_occ=10, max_max_occ=30)
    q, r = frame(spark, reads, "item_id"), frame(spark, texts, "doc_id")
    s = mapping.sketch_both(q, "item_id", r, "doc_id", options)
    selected = seeding.select_seeds(s, options).collect()
    assert all(x.occ <= 30 for x in selected if not x.flt and x.rid != 0)
    own = [x for x in selected if x.rid == 0]
    assert len(own) < 40  # those that the read itself has very often have no row
    assert regions(seeding.map_seeded(q, "item_id", r, "doc_id", options)) == {(1, 0), (2, 1)}


def test_empty_sides(spark, crowded):
    reads, documents = crowded
    assert seeding.map_seeded(reads.where("false"), "item_id", documents, "doc_id", Options(max_occ=20)).count() == 0
    assert seeding.map_seeded(reads, "item_id", documents.where("false"), "doc_id", Options(max_occ=20)).count() == 0


def test_bounded_passages_contain_the_bounded_regions(spark):
    """Chaining across gaps finds at least the places of chaining on a diagonal."""
    loose = {(r.read_id, r.rid, r.rev) for r in QUERIES["bounded_passages"](spark, DATA).collect()}
    strict = {(r.read_id, r.rid, r.rev) for r in QUERIES["bounded_regions"](spark, DATA).collect()}
    assert strict and strict <= loose
