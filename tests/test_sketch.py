import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.sequence import base_codes, hash_codes, hash_column, reverse_complement
from strandloom.operators import index, intervals, sketch


def brute(codes, w, k):
    """Minima of all windows of w k-mers, a run of fewer k-mers being one window."""
    out = set()
    for start, stop in _runs(codes):
        found = []
        for i in range(start + k - 1, stop):
            word = codes[i - k + 1 : i + 1]
            f = int("".join(map(str, word)), 4)
            r = int("".join(str(3 - c) for c in reversed(word)), 4)
            if f != r:
                h = int(hash_codes(np.array([min(f, r)], np.uint64), 2 * k)[0])
                found.append((h, i, int(r < f)))
        for j in range(max(1, len(found) - w + 1)):
            window = found[j : j + w]
            if window:
                low = min(window)[0]
                out |= {x for x in window if x[0] == low}
    return sorted((i, s, h) for h, i, s in out)


def _runs(codes):
    start = None
    for i, c in enumerate([*codes, 4]):
        if c < 4 and start is None:
            start = i
        elif c >= 4 and start is not None:
            yield start, i
            start = None


@pytest.mark.parametrize("seed", range(40))
def test_sketch_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 120))
    unit = rng.integers(0, 4, max(1, int(rng.integers(1, 8))))
    codes = rng.integers(0, 4, n) if seed % 2 else np.resize(unit, n)
    if seed % 3 == 0 and n:
        codes[rng.integers(0, n, 3)] = 4
    w, k = int(rng.integers(1, 7)), int(rng.integers(2, 8))
    pos, strand, hashed, span = sketch.sketch(codes.astype(np.uint8), w, k)
    assert sorted(zip(pos.tolist(), strand.astype(int).tolist(), hashed.tolist(), strict=True)) == brute(codes.tolist(), w, k)
    assert (np.asarray(span) == k).all()


def test_compressed_spans_reach_over_repeats():
    codes = base_codes("AAACCCGGGTTTACGT", "dna")
    pos, _, _, span = sketch.sketch(codes, 1, 3, compressed=True)
    assert span[0] == 9 and pos[0] == 8


def test_expression_form_equals_numpy_form(spark):
    rows = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "abcabcabcabcabcabcabcabc" * 3), (5, "é日😀" * 12)]
    df = spark.createDataFrame(rows, "k long, text string")
    columns = ["rid", "pos", "strand", "hash", "span"]
    a = sorted(map(tuple, sketch.minimizers(df, "k", w=4, k=7).select(columns).collect()))
    b = sorted(map(tuple, sketch.minimizers_by_expression(df, "k", w=4, k=7).select(columns).collect()))
    assert a == b and a


def test_hash_forms_agree(spark):
    values = [0, 1, 5, 12345, (1 << 30) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    found = [r.h for r in df.select(hash_column(F.col("x"), 30).alias("h")).collect()]
    assert found == hash_codes(np.array(values, np.uint64), 30).tolist()
    assert len(set(hash_codes(np.arange(1 << 12), 12).tolist())) == 1 << 12


def test_reverse_complement_twice_is_the_sequence(spark):
    df = spark.createDataFrame([("ACGTNacgtn",), ("",), (None,)], "s string")
    rows = df.select("s", reverse_complement(reverse_complement(F.col("s"))).alias("t")).collect()
    assert [r.t for r in rows] == [r.s for r in rows]


def test_threshold_ranks_exactly(spark):
    counts = [1] * 9000 + [2] * 900 + list(range(3, 103))
    occ = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "hash long, occ long")
    wanted = sorted(counts)[int((1 - 0.005) * len(counts))] + 1
    assert index.frequency_threshold(occ, 0.005).first().mid_occ == wanted
    assert index.frequency_threshold(occ.limit(0)).first().mid_occ == 10


def test_bucketed_index_joins_without_shuffle(spark):
    df = spark.createDataFrame([(i, "some text that repeats itself " * (i % 3 + 1)) for i in range(20)], "k long, text string")
    index.write_index(sketch.minimizers(df, "k"), "idx_test", 4)
    table = index.read_index(spark, "idx_test")
    plan = index.occurrences(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE idx_test")


def test_low_complexity_finds_repeats_only():
    rng = np.random.default_rng(5)
    plain = rng.integers(0, 4, 60).astype(np.uint8)
    repeat = np.resize(np.array([0, 1], np.uint8), 50)
    found = intervals.low_complexity(np.concatenate([plain, repeat, plain[::-1]]))
    assert found and all(e > 50 and s < 120 for s, e in found)
    assert intervals.low_complexity(np.zeros(0, np.uint8)) == []
