"""Mapping jobs on texts that many documents share."""

import random

from strandloom.jobs import mapping
from strandloom.jobs.options import Options
from strandloom.operators import hits

#: In so small an index few hashes are in the top 0.02 %; this fraction has a hash frequent above ten places.
FEW = {"mid_occ_fraction": 0.9}
LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def words(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(LETTERS) for _ in range(n))


def frame(spark, texts, key):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").repartition(3)


def test_passages_of_many_documents_are_found(spark):
    passage, copy = words(1, 240), words(2, 900)
    texts = [copy] * 40 + [words(10 + k, 300) + passage + words(60 + k, 300) for k in range(30)] + [words(100 + k, 700) for k in range(10)]
    reads = frame(spark, [passage, copy[200:440], words(200, 240)], "item_id")
    documents = frame(spark, texts, "doc_id")
    assert mapping.map_rare(reads, "item_id", documents, "doc_id", Options(**FEW)).count() == 0
    found = mapping.map_reads(reads, "item_id", documents, "doc_id", Options(**FEW)).collect()
    assert {(r.read_id, r.rid) for r in found} == {(0, k) for k in range(40, 70)} | {(1, k) for k in range(40)}
    best = mapping.map_best(reads, "item_id", documents, "doc_id", Options(**FEW)).collect()
    assert {(r.read_id, r.rid) for r in best} == {(0, k) for k in range(40, 46)} | {(1, k) for k in range(6)}


def test_copies_overlap(spark):
    shared, copy = words(3, 400), words(4, 900)
    texts = [copy] * 40 + [words(5, 300) + shared, shared + words(6, 300), copy[:600] + words(7, 200)] + [words(300 + k, 700) for k in range(10)]
    documents = frame(spark, [*texts, None, ""], "doc_id")
    pairs = {(r.a, r.b): r for r in mapping.overlap_classes(documents, "doc_id", Options(min_score=100, **FEW)).collect()}
    assert set(pairs) == {(0, k) for k in range(1, 40)} | {(40, 41), (0, 42)}
    two = {(r.a, r.b): r for r in mapping.overlap_all(frame(spark, [copy, copy], "doc_id"), "doc_id", Options(min_score=100, **FEW)).collect()}
    assert pairs[0, 7].score == two[0, 1].score and pairs[0, 7].shared == two[0, 1].shared and pairs[0, 7].chains == two[0, 1].chains
    assert (0, 1) not in {(r.a, r.b) for r in mapping.overlap_all(documents, "doc_id", Options(min_score=100, **FEW)).collect()}


def test_gaps_do_not_split_a_passage(spark):
    passage = words(8, 300)
    gapped = "".join(passage[k : k + 25] + "#" for k in range(0, 300, 25))
    long = words(9, 4000)
    joined = long[:1500] + words(11, 900) + long[1500:]
    reads = frame(spark, [passage, long], "item_id")
    texts = [words(12, 200) + gapped + words(13, 200), joined, *(words(400 + k, 700) for k in range(4)), words(14, 100) + long[:400]]
    documents = frame(spark, texts, "doc_id")
    rare = mapping.map_rare(reads, "item_id", documents, "doc_id").collect()
    assert not [r for r in rare if r.read_id == 0] and len([r for r in rare if (r.read_id, r.rid) == (1, 1)]) == 2
    found = {(r.read_id, r.rid): r for r in mapping.map_reads(reads, "item_id", documents, "doc_id").collect()}
    assert set(found) == {(0, 0), (1, 1), (1, 6)}
    one = found[0, 0]
    assert one.qe - one.qs > 250 and one.blen >= one.mlen >= one.score and not one.rev
    # 900 inserted letters are beyond the band; a second chaining within band_long joins the two parts.
    assert found[1, 1].qe - found[1, 1].qs > 3900 and found[1, 1].re - found[1, 1].rs > 4800
    narrow = Options(band_long=500)
    assert len([r for r in mapping.map_reads(reads, "item_id", documents, "doc_id", narrow).collect() if r.rid == 1]) == 2


def test_a_sequence_is_not_mapped_to_itself(spark):
    texts = frame(spark, [words(20, 600), words(20, 600), words(21, 600)], "doc_id")
    pairs = lambda o: {(r.read_id, r.rid) for r in mapping.map_reads(texts, "doc_id", texts, "doc_id", o).collect()}
    assert pairs(Options()) == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}
    assert pairs(Options(no_diagonal=True)) == {(0, 1), (1, 0)}
    assert pairs(Options(no_diagonal=True, no_dual=True)) == {(0, 1)}


def test_frequent_seeds_lower_the_quality(spark):
    common, own = words(15, 200), words(16, 60)
    reads = frame(spark, [own + common, own + words(17, 200)], "item_id")
    documents = frame(spark, [own + common, own + words(17, 200), *(words(500 + k, 200) + common for k in range(15))], "doc_id")
    repeats = mapping.repeat_lengths(mapping.sketch_both(reads, "item_id", documents, "doc_id", Options(**FEW)))
    found = {r.read_id: r.rep_len for r in repeats.collect()}
    assert set(found) == {0} and 150 < found[0] <= 215
    parented = hits.set_parents(mapping.map_reads(reads, "item_id", documents, "doc_id")).where("read_id = 0 AND place = 1")
    assert hits.mapq_long(parented, repeats).first().mapq < hits.mapq_long(parented).first().mapq
