"""Steps whose work must grow no faster than the references: looked-up seeds, counted thresholds, batched scores and chains."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.jobs import mapping, seed_quality
from strandloom.jobs.options import Options
from strandloom.operators import chains, exact, index, seeds, sketch, tiles
from strandloom.operators.align import Scoring, local_score, local_scores
from tests.test_mapping import frame, words


@pytest.fixture(scope="module")
def sides(spark):
    passages = [words(k, 240) for k in range(4)]
    texts = [words(20 + k, 300) + passages[k % 4] + words(60 + k, 200) for k in range(40)] + [None, "", "short"]
    return frame(spark, [*passages, None], "item_id"), frame(spark, texts, "doc_id")


def test_only_looked_up_minimizers_are_stored(spark, sides):
    reads, documents = sides
    s = mapping.sketch_both(reads, "item_id", documents, "doc_id")
    every = sketch.minimizers(documents, "doc_id")
    wanted = every.join(s.queries.select("hash").distinct(), "hash", "left_semi").select(every.columns)
    assert sorted(s.references.collect()) == sorted(wanted.collect()) and 0 < s.references.count() < every.count() / 2
    # The threshold is still that of all minimizers.
    assert s.mid_occ.collect() == index.frequency_threshold(index.occurrences(every)).collect()


def test_many_queries_keep_every_minimizer(spark, sides, monkeypatch):
    reads, documents = sides
    few = sorted(mapping.map_rare(reads, "item_id", documents, "doc_id").collect())
    monkeypatch.setattr(mapping, "BROADCAST_ROWS", 10)
    s = mapping.sketch_both(reads, "item_id", documents, "doc_id")
    assert s.references.count() == sketch.minimizers(documents, "doc_id").count()
    assert sorted(mapping.map_rare(reads, "item_id", documents, "doc_id").collect()) == few


@pytest.mark.parametrize("k", [3, 15, 21])
def test_histogram_counts_every_minimizer(spark, sides, k, monkeypatch):
    monkeypatch.setattr(sketch, "COUNTED", 500)
    found = sketch.occurrence_histogram(sides[1], "doc_id", k=k)
    wanted = index.occurrences(sketch.minimizers(sides[1], "doc_id", k=k)).groupBy("occ").agg(F.count("*").alias("n"))
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_known_hashes():
    some = np.array([5, 5 + (1 << 22), 9, 1 << 40])
    asked = np.array([5, 6, 9 + (1 << 22), 9, 5 + (1 << 22), 1 << 40, 5 + (1 << 23)])
    assert sketch.Known(some).where(asked).tolist() == [0, 3, 4, 5]
    assert sketch.Known(some[:0]).where(asked).tolist() == []


@pytest.mark.parametrize("scoring", [Scoring(1, 4, 6, 1), Scoring(), Scoring(2, 3, 0, 1, ambiguous=2)])
def test_scores_of_many_pairs(scoring):
    rng = np.random.default_rng(1)
    pairs = []
    for k in range(60):
        q, t = (rng.integers(0, 5 if k % 3 == 0 else 4, rng.integers(0, 90)).astype(np.uint8) for _ in range(2))
        pairs.append((q, np.concatenate([t[:20], q[3 : len(q) // 2], t[: k % 5], q[len(q) // 2 :]]) if k % 2 else t))
    assert local_scores(pairs, scoring).tolist() == [local_score(*p, scoring) for p in pairs]
    assert local_scores([], scoring).tolist() == []


def test_copies_have_the_same_score(spark):
    reads, documents = frame(spark, [words(1, 60)], "item_id"), frame(spark, [words(1, 60)] * 30, "doc_id")
    k = exact.all_kmers(reads, "item_id", k=15)
    found = exact.maximal_matches(seeds.anchors(k, exact.all_kmers(documents, "doc_id", k=15), mapping.lengths(reads, "item_id")))
    rows = seed_quality.score_seeds(found, reads, "item_id", documents, "doc_id").where("qend - qbeg = 60").collect()
    assert len(rows) == 30 and {(r.seed_score, r.good) for r in rows} == {(60, True)}


def test_groups_go_on_in_the_next_batch():
    rows = [(1, 2, False, 5, 6), (1, 2, False, 7, 8), (1, 2, True, 1, 1), (1, 3, True, 2, 2), (1, 3, True, 3, 3), (2, 3, True, 4, 4)]
    names = ["read_id", "rid", "rev", "rpos", "qpos"]
    for cuts in ([6], [1, 5], [1, 1, 1, 1, 1, 1], [4, 0, 2]):
        at, batches = 0, []
        for n in cuts:
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at : at + n]], pa.bool_() if c == 2 else pa.int64()) for c in range(5)], names))
            at += n
        found = [(key, r.tolist(), q.tolist()) for key, (r, q) in chains._each(iter(batches), ("rpos", "qpos"))]
        assert found == [((1, 2, False), [5, 7], [6, 8]), ((1, 2, True), [1], [1]), ((1, 3, True), [2, 3], [2, 3]), ((2, 3, True), [4], [4])]


def test_equal_chains_are_filtered_once(spark):
    """A read's chains on many references differ in few spans and weights; the filter sees each of these once."""
    rng = np.random.default_rng(3)
    spans = [(int(s), int(s + n), int(w)) for s, n, w in zip(rng.integers(0, 150, 40), rng.integers(15, 90, 40), rng.integers(15, 200, 40), strict=True)]
    rows = [(0, rid, False, 0, 1, w, s, e, s, e) for rid in range(50) for s, e, w in spans]
    found = spark.createDataFrame(rows, "read_id long, rid long, rev boolean, chain int, cnt int, weight int, rs int, re int, qs int, qe int")
    ordered = sorted(rows, key=lambda r: (-r[5], r[1], r[2], r[6], r[8]))
    kept = chains.keep_chains(*(np.array([r[k] for r in ordered]) for k in (8, 9, 5)))
    result = chains.filter_chains(found)
    assert sorted(map(tuple, result.collect())) == sorted(r for r, x in zip(ordered, kept, strict=True) if x)
    assert result.columns == found.columns and 0 < kept.sum() < len(rows)


@pytest.mark.parametrize("options", [Options(min_score=100), Options(min_score=60, compressed=True, k=13), Options(min_score=100, k=21, max_gap=100), Options(min_score=100, mid_occ_fraction=0.9)])
def test_blocks_give_the_pairs_of_the_join(spark, options, monkeypatch):
    shared, turned = words(3, 500), words(4, 400)
    back = "".join(chr(ord("`") + 3 - ord(c) % 4) for c in reversed(turned))
    texts = [words(20 + k, 200) + shared[k * 9 :] + words(60 + k, 200) for k in range(14)] + [turned + words(5, 99), back, shared[:200] + words(6, 300) + shared[200:], None, ""]
    documents = frame(spark, texts, "doc_id")
    wanted = sorted(mapping.overlap_all(documents, "doc_id", options, stored=mapping.stored_index(documents, "doc_id", options)).collect())
    monkeypatch.setattr(tiles, "HELD", 300)
    assert sorted(mapping.overlap_all(documents, "doc_id", options).collect()) == wanted and (wanted or options.mid_occ_fraction > 0.5)
    whole = mapping.overlap_all(documents, "doc_id", options)
    assert whole.dtypes == mapping.overlap_all(documents, "doc_id", options, stored=mapping.stored_index(documents, "doc_id", options)).dtypes


def _chunk(rng, rids, sizes, hashes, compressed=False):
    """Random minimizers, of which those of the last sequences repeat others'."""
    parts, at = [], []
    for n, size in enumerate(sizes):
        hashed, places = rng.integers(0, hashes, size), np.sort(rng.choice(40 * size, size, replace=False))
        if n % 2 and size > 30:
            hashed[:30], places[:30] = parts[0][:30], at[0][:30] // 2 + n
            places = np.maximum.accumulate(places + np.arange(size))
        parts.append(hashed)
        at.append(2 * places + rng.integers(0, 2, size))
    found, nth = np.unique(np.concatenate(parts), return_inverse=True)
    span = rng.integers(15, 30, len(nth)) if compressed else np.zeros(0, np.int64)
    return tiles.Chunk(pa.array(rids), np.array([int(x.max()) // 2 + 20 for x in at]), np.array(sizes), found, nth, np.concatenate(at), span)


def _gathered(chunks, often=(), k=15, compressed=False):
    held = tiles._Gathered(sum(len(c.nth) for c in chunks), sketch.Known(np.array(often, np.int64)), k, compressed)
    for c in chunks:
        held.add(c)
    return tiles.Comparison(held.group(), k, compressed, 500, 3, 60)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("held", [7, 300, 1 << 17])
def test_groups_and_chunks_give_the_islands_of_every_two(spark, compressed, held, monkeypatch):
    rng = np.random.default_rng(5)
    chunks = [_chunk(rng, [f"s{x * 7 % 11:02}" for x in range(a, a + 4)], [40, 60, 50, 45], 60, compressed) for a in (0, 4)]
    rows = []
    for c in chunks:
        doc = np.repeat(np.arange(4), c.count)
        rows += [(c.rids[int(d)].as_py(), int(a) >> 1, int(a) & 1, int(h), int(s), int(c.len[d])) for d, a, h, s in zip(doc, c.at, c.hash[c.nth], c.span if compressed else [15] * len(doc), strict=True) if h not in (3, 9)]
    m = spark.createDataFrame(rows, "rid string, pos int, strand int, hash long, span int, len int")
    found = seeds.anchors(m.drop("len"), m.drop("len"), m.select("rid", "len").distinct()).where("read_id < rid")
    regions = chains.islands(found, 500).where("cnt >= 3 AND score >= 60")
    wanted = regions.groupBy("read_id", "rid", "rev").agg(F.max("score"), F.sum("mlen"), F.count("*")).collect()
    monkeypatch.setattr(tiles, "HELD", held)
    monkeypatch.setattr(tiles, "CHUNK", 64)
    by, whole = _gathered(chunks[:1], (3, 9), compressed=compressed), _gathered(chunks, (3, 9), compressed=compressed)
    other = _gathered(chunks[1:], (3, 9), compressed=compressed)
    dealt = [tuple(r.values()) for x in itertools.chain(by.own(), by.other(chunks[1]), other.own()) for r in x.to_pylist()]
    assert sorted(dealt) == sorted(map(tuple, wanted)) == sorted(tuple(r.values()) for x in whole.own() for r in x.to_pylist()) and dealt


@pytest.mark.parametrize("sizes", [[4000] * 20, [40, 79_960]])
def test_anchors_are_held_a_bounded_number_at_a_time(sizes):
    """Over six million anchors, of twenty sequences or most of them of one."""
    rng = np.random.default_rng(6)
    by, c = _gathered([_chunk(rng, list(range(100, 120)), [4000] * 20, 1000)]), _chunk(rng, list(range(len(sizes))), sizes, 1000)
    tracemalloc.start()
    list(by.other(c))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20


def test_stored_chunks_are_small_rows(spark):
    documents = frame(spark, [words(k, 4000) for k in range(300)], "doc_id").coalesce(1)
    sizes = tiles.chunks(documents, "doc_id", 10, 15, "text", False).select("n", F.size("rids").alias("d"), F.expr("length(hash) + length(nth) + length(at)").alias("b")).collect()
    assert sum(r.n for r in sizes) == sketch.minimizers(documents, "doc_id").count() and sum(r.d for r in sizes) == 300
    assert len(sizes) > 1 and max(r.n for r in sizes) < 2 * tiles.CHUNK and max(r.b for r in sizes) < 1 << 20


def test_every_two_groups_meet_once():
    for n in range(1, 9):
        dealt = tiles._dealt(np.full(n, 5), 3)
        assert [x for a, b in dealt for x in range(a, b)] == list(range(n)) and len(dealt) <= max(3, n)
        met = [frozenset((g, x)) for g in range(n) for x in tiles._others(g, n)]
        assert sorted(map(sorted, met)) == [[a, b] for a in range(n) for b in range(a + 1, n)]
    assert max(b - a for a, b in tiles._dealt(np.full(100, tiles.CHUNK), 3)) * tiles.CHUNK <= tiles.GROUP
