"""Filter audit, line dedup and fill-in-middle against plain versions on small fixtures."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import fill_middle, filter_audit, line_dedup, queries
from tests.llm.test_operators import DATA, DOCUMENTS, HARD, empty, hard

WHITE = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, quality int, toxic int, n int, part string"


def written(spark, tmp_path, rows, labels=(), files=1):
    hard(spark, rows).repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


# --- 11. filter audit


def failed(rows):
    """The letters that each row fails, by the contract's words."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        letters = "A" if len(words) < 200 else ""
        letters += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        letters += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        letters += "D" if re.search("[#$%&*|]", text) else ""
        twins = [k for k, t, *_ in rows if (t or "") == text and k is not None and doc_id is not None and k < doc_id]
        out.append(letters + ("E" if twins else ""))
    return out


def walked(rows, labels):
    """Every order applied to every document in turn."""
    good = {k for k, q, *_ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t, *_ in labels if t == 1 and k is not None}
    fails, out, sums = failed(rows), [], Counter()
    for part in sorted({r[2] or "" for r in rows}):
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(k, f) for k, f in left if letter in f]
                left = [x for x in left if letter not in x[1]]
                failing = sum(letter in f for _, f in own)
                sums[part, letter] += len(gone)
                lost = (sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
                out.append([part, order, step, len(left), len(gone), failing - len(gone), sum(f == letter for _, f in own), *lost])
    return [(*r, sums[r[0], r[1][r[2] - 1]]) for r in out]


def long_text(rng, words, extra=""):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(words)) + extra


def audit_rows():
    rng, rows = random.Random(5), list(HARD)
    for k in range(20, 90):
        text = long_text(rng, rng.choice([150, 250, 400]), rng.choice(["", " #", " ABCDEFGHIJ" * 20, " same" * 600, " 100% SURE " * 40]))
        rows.append((k, text, rng.choice(["en", "fr", None, ""]), "s", len(text)))
    copied = [(k + 200, r[1], rng.choice(["en", None]), None, 0) for k, r in enumerate(rows) if k % 3 == 0]
    return rows + copied + [(None, rows[-1][1], "en", None, 0)] * 2 + [(1, rows[-1][1], "fr", None, 0)] * 2


AUDIT_LABELS = [(k, k % 2, int(k % 5 == 0), 0, "x") for k in range(0, 230, 2)] + [(1, 1, None, 0, "x"), (1, 1, 0, 0, "x"), (1, None, 1, 0, "x"), (None, 1, 1, 0, "x"), (99999, 1, 1, 0, "x")]


def test_audit_query_equals_walking_every_order(spark, tmp_path):
    rows = audit_rows()
    found = queries.op11_filter_audit(spark, written(spark, tmp_path, rows, AUDIT_LABELS, 3))
    wanted = walked(rows, AUDIT_LABELS)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert len(wanted) % 600 == 0 and any(r[-1] for r in wanted)


def test_audit_of_empty_tables(spark, tmp_path):
    assert queries.op11_filter_audit(spark, written(spark, tmp_path, [], [])).count() == 0
    one = filter_audit.audit(hard(spark, HARD[:1]), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r.part for r in one} == {"en"}


def test_audit_of_other_conditions(spark):
    """Two filters of the caller's and the copies: 3! orders of three steps."""
    rows = [(1, "a b", "en", "s", 0), (2, "a b", "en", "s", 0), (3, "c", "en", "s", 0), (4, "long text of words", "en", "s", 0)]
    conditions = {"S": lambda text, words: len(words) < 2, "L": lambda text, words: len(words) > 3}
    found = filter_audit.audit(hard(spark, rows), spark.createDataFrame([], LABELS), conditions).collect()
    assert len(found) == 18
    assert {(r.filter_order[r.step - 1], r.removed, r.shapley) for r in found} == {("S", 1, 6), ("L", 1, 6), ("E", 1, 6)}


def test_potentials_give_the_shapley_value():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(0, 50, 32)
        game = filter_audit.removal_game(counts)
        assert [int(counts[[m for m in range(32) if m & s]].sum()) for s in range(32)] == game.tolist()
        sums = [0] * 5
        for order in itertools.permutations(range(5)):
            done = 0
            for i in order:
                sums[i] += int(game[done | 1 << i] - game[done])
                done |= 1 << i
        assert filter_audit.shapley_sums(game, 5) == sums


# --- 12. line dedup


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def without_lines(rows, least=10):
    held = Counter(k for r in rows for k in {key_of(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stays = [x for x in lines if held[key_of(x)] < least]
        out.append((r[0], len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def line_rows():
    rng, rows = random.Random(8), list(HARD)
    common = ["Common line", "ÉTÉ déjà", "x", "\x1c", "nine", "© all rights\x0b"]
    for k in range(100, 260):
        lines = [rng.choice(["", " ", "own %d %d" % (k, i), " " + rng.choice(common).upper() + "\t\r", rng.choice(common)]) for i in range(rng.randrange(1, 9))]
        rows.append((k, "\n".join(lines), "en", "s", 0))
    rows += [(k, "nine of these", "en", "s", 0) for k in range(300, 309)] + [(400, "ten of these\n" * 50, "en", "s", 0)]
    rows += [(None if k % 2 else 5, "Ten of these \n", "en", "s", 0) for k in range(9)]
    return rows + [(500, "ten of these\n" + "long line " * 30_000, "en", "s", 0)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_line_query_equals_plain_version(spark, tmp_path):
    rows = line_rows()
    found = queries.op12_line_dedup(spark, written(spark, tmp_path, rows, files=11))
    wanted = [(k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in without_lines(rows)]
    assert ordered(found.collect()) == ordered(wanted) and any(r[2] for r in wanted)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("bound", [0, 3, 1000])
def test_keys_joined_equal_keys_sent(spark, bound):
    rows = line_rows()
    df = hard(spark, rows)
    frequent = line_dedup.count_keys(df).where("docs >= 10").select("key")
    found = line_dedup.drop_lines(df, frequent, broadcast_keys=bound)
    assert ordered(found.collect()) == ordered(without_lines(rows))


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_runs_count_over_batches(spark, fanout):
    """Levels fill and merge; settled keys don't grow; what is frequent equals one count over all batches."""
    rng = random.Random(fanout)
    batches = [[(k, "\n".join("line %d" % int(rng.expovariate(0.1)) for _ in range(4)), "en", "s", 0) for k in range(12)] for _ in range(7)]
    runs = line_dedup.LineRuns(spark, 6, fanout, 3)
    held = Counter()
    for batch in batches:
        runs.add(line_dedup.count_keys(hard(spark, batch)))
        held.update(k for r in batch for k in set(line_dedup.line_keys(r[1].encode())))
        assert all(n < fanout for _, n in runs.levels)
        stored = Counter()
        for level, (name, n) in enumerate(runs.levels):
            if n:
                assert "Bucket" in spark.sql(f"DESCRIBE EXTENDED {name}").toPandas().to_string()
                for r in runs.rows(level).collect():
                    stored[bytes(r.key)] += r.docs
        assert all(min(stored[k], 6) == min(n, 6) for k, n in held.items()) and len(stored) == len(held)
    found = [bytes(r.key) for r in runs.frequent().collect()]
    assert len(found) == len(set(found)) and set(found) == {k for k, n in held.items() if n >= 6}
    names = [name for name, n in runs.levels if n]
    runs.drop()
    assert names and not any(spark.catalog.tableExists(n) for n in names)


def test_merging_runs_shuffles_nothing(spark):
    runs = line_dedup.LineRuns(spark, 2, 9)
    for k in range(3):
        runs.add(line_dedup.count_keys(hard(spark, [(k, "a\nb\n%d" % k, "en", "s", 0)])))
    merged = runs.rows(0).groupBy("key").agg(F.sum("docs").alias("docs"))
    settled = runs.rows(0).where("docs >= 2").select("key").hint("merge")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (merged, runs.rows(0).join(settled, "key", "left_anti"))]
    assert not any("Exchange" in p for p in plans)
    assert sorted(r.docs for r in merged.collect()) == [1, 1, 1, 3, 3]
    runs.drop()


def test_lines_of_hard_and_empty_rows(spark, tmp_path):
    rows = HARD * 10
    found = line_dedup.dedup_lines([hard(spark, rows)], hard(spark, rows))
    assert ordered(found.collect()) == ordered(without_lines(rows))
    assert line_dedup.dedup_lines([empty(spark)], empty(spark)).count() == 0
    assert line_dedup.dedup_lines([], hard(spark)).where("n_dropped > 0").count() == 0
    assert queries.op12_line_dedup(spark, written(spark, tmp_path, [])).count() == 0


# --- 13. fill in middle

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def moved(rows):
    out = []
    for key, text, *_ in rows:
        text = text or ""
        units = re.findall(UNIT, text)
        digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        n = len(units)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            out.append((key, n, "plain", None, None, text))
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h4 % 100 < 80 else "psm"
        out.append((key, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"))
    return out


def unit_rows():
    rng, rows = random.Random(13), list(HARD)
    for k in range(100, 900):
        text = "".join(rng.choice([" ", "\t", "\n", "\x0b", "\r", "a", "b!", "é", "日", "😀", "\x08", "\x0e", "\x1f", "\xa0", "<P", ">", "<S>" if k % 40 == 0 else "<"]) for _ in range(rng.randrange(60)))
        rows.append((k, text, "en", "s", 0))
    return rows


def test_middle_query_equals_plain_version(spark, tmp_path):
    rows = unit_rows()
    found = queries.op13_fill_middle(spark, written(spark, tmp_path, rows, files=2))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = [(*m[:5], sha(m[5]), sha(r[1])) for m, r in zip(moved(rows), rows, strict=True)]
    assert ordered(found.collect()) == ordered(wanted)
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}


def test_middle_of_every_rate_restores(spark):
    df = hard(spark, unit_rows()).withColumn("text", F.translate("text", "<", "{"))
    for rate, first in ((100, 0), (100, 100), (0, 50)):
        made = fill_middle.fill_in_middle(df, rate=rate, suffix_first=first, seed=7)
        forms = {r.form for r in made.select("form").distinct().collect()}
        assert forms == ({"plain"} if rate == 0 else {"plain", "spm" if first else "psm"})
        texts = Counter(r.t for r in df.select(F.coalesce("text", F.lit("")).alias("t")).collect())
        assert Counter(r.t for r in made.select(fill_middle.restore(F.col("output"), F.col("form")).alias("t")).collect()) == texts
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0


def test_unit_index_selects_every_end():
    texts = [r[1] or "" for r in unit_rows()] + ["x" * 7, "x" * 8, "x" * 8 + " ", " " * 16, "x" * 15 + "\t", "ab " * 5000]
    index = fill_middle.UnitIndex([t.encode() for t in texts])
    for row, text in enumerate(texts):
        units = re.findall(UNIT, text)
        assert index.counts[row] == len(units)
        ks = np.arange(0, len(units) + 1, max(1, len(units) // 50))
        rows = np.full(len(ks), row)
        ends = index.select(rows, ks)
        cuts = ["".join(units[:k]) for k in ks]
        assert ends.tolist() == [len(c.encode()) for c in cuts]
        assert index.code_points(rows, ends).tolist() == [len(c) for c in cuts]
    assert fill_middle.UnitIndex([]).counts.tolist() == []


def test_new_queries_read_the_given_tables(spark):
    documents = spark.read.schema(DOCUMENTS).parquet(f"{DATA}/documents.parquet").count()
    assert queries.op12_line_dedup(spark, DATA).count() == documents == queries.op13_fill_middle(spark, DATA).count()


# --- 6. candidates of the Jaccard join


def test_marks_bound_what_sets_have_not_in_common():
    from strandloom.llm import jaccard_join

    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(jaccard_join.mark(v), np.uint64) for v in (a, b))
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(np.setxor1d(a, b)) and len(x) * 64 == jaccard_join.MARK_BITS


@pytest.mark.parametrize("rows", [250, 500, 1000])
def test_shared_paragraphs_give_few_candidates(spark, rows, monkeypatch):
    """Documents of six of thirty paragraphs have next to no links; pairs that leave the tiles are few, not their square."""
    from strandloom.llm import jaccard_join
    from tests.llm.test_operators import brute_components

    rng = random.Random(1)
    paragraphs = [" ".join("w%d" % rng.randrange(5000) for _ in range(40)) for _ in range(30)]
    texts = [(k, "\n".join(rng.sample(paragraphs, 6)), "en", "s", 0) for k in range(rows)]
    counted, plain = {}, jaccard_join.Workspace.stash

    def stash(self, df, name):
        out = plain(self, df, name)
        counted[name] = out.count() if name == "second" else None
        return out

    monkeypatch.setattr(jaccard_join.Workspace, "stash", stash)
    found = jaccard_join.jaccard_components(hard(spark, texts)).collect()
    assert counted["second"] <= rows // 10
    if rows == 250:
        assert sorted(map(tuple, found)) == sorted(brute_components(texts))
