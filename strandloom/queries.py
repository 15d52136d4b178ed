"""The registered sequence-mapping queries over the given tables, and their SQL.

Documents are the references and benchmark texts the reads, in the text alphabet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom import sql_parts as q
from strandloom.functions import cigar as cigars
from strandloom.functions.arrays import running
from strandloom.functions.sequence import code_array, complement
from strandloom.jobs import mapping
from strandloom.jobs.options import Options
from strandloom.operators import chains, exact, hits, index, intervals, scoring, seeds, sketch
from strandloom.operators.composition import composition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet")


def _sides(spark: SparkSession, d: str) -> mapping.Sketches:
    return mapping.sketch_both(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")


@_register(f"WITH {q.kmers('d', 'documents', 'doc_id')} SELECT CAST(p AS INTEGER) AS first, CAST(b AS INTEGER) AS second, count(*) AS n FROM (SELECT lag(b) OVER (PARTITION BY rid ORDER BY i) AS p, b FROM d_b) WHERE p IS NOT NULL GROUP BY 1, 2")
def base_composition(spark: SparkSession, d: str) -> DataFrame:
    """Counts of neighbouring bases over all documents."""
    return composition(_documents(spark, d))


@_register("WITH c AS (SELECT item_id, string_split(text, '') AS cs FROM benchmark) SELECT item_id, md5(array_to_string(list_transform(list_reverse(cs), lambda x: CAST(3 - ascii(x) % 4 AS VARCHAR)), '')) AS digest, CAST(len(cs) AS INTEGER) AS len FROM c")
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    codes = complement(code_array(F.col("text")))
    return _benchmark(spark, d).select(
        "item_id", F.md5(F.array_join(F.transform(codes, lambda c: c.cast("string")), "")).alias("digest"), F.size(codes).alias("len")
    )


@_register(f"WITH {q.kmers('b', 'benchmark', 'item_id')} SELECT least(f, r) AS canonical, count(*) AS n, count(DISTINCT rid) AS reads FROM b_k GROUP BY 1")
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    found = sketch.kmers(_benchmark(spark, d), "item_id")
    return found.groupBy("canonical").agg(F.count("*").alias("n"), F.countDistinct("rid").alias("reads"))


@_register(f"WITH {q.sketch('b', 'benchmark', 'item_id')} SELECT rid, pos, CAST(strand AS INTEGER) AS strand, hash, CAST(span AS INTEGER) AS span FROM b")
def minimizer_sketch(spark: SparkSession, d: str) -> DataFrame:
    return sketch.minimizers(_benchmark(spark, d), "item_id")


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id')} SELECT rid, count(*) AS n, CAST(sum(hash) AS BIGINT) AS hashes, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(strand) AS BIGINT) AS reversed FROM d GROUP BY 1")
def document_sketches(spark: SparkSession, d: str) -> DataFrame:
    found = sketch.minimizers(_documents(spark, d), "doc_id")
    return found.groupBy("rid").agg(
        F.count("*").alias("n"), F.sum("hash").alias("hashes"), F.sum("pos").alias("places"), F.sum("strand").alias("reversed")
    )


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id')}, o AS (SELECT hash, count(*) AS occ FROM d GROUP BY 1) SELECT count(*) AS n_distinct, CAST(sum(CASE WHEN occ = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_single, CAST(sum(occ) AS BIGINT) AS n_minimizers, CAST(sum(occ) AS DOUBLE) / count(*) AS mean_occ, 15 AS k FROM o")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.statistics(sketch.minimizers(_documents(spark, d), "doc_id"), sketch.K)


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id')},{q.threshold('d')} SELECT mid_occ FROM d_mid")
def mid_occ_threshold(spark: SparkSession, d: str) -> DataFrame:
    return index.frequency_threshold(index.occurrences(sketch.minimizers(_documents(spark, d), "doc_id")))


@_register(f"WITH {q.sketch('b', 'benchmark', 'item_id')} SELECT hash, count(*) AS occ, string_agg(rid || ':' || pos || ':' || strand, ',' ORDER BY rid, pos, strand) AS places FROM b GROUP BY 1")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    found = index.postings(sketch.minimizers(_benchmark(spark, d), "item_id"))
    text = F.transform("postings", lambda p: F.concat_ws(":", p["rid"].cast("string"), p["pos"].cast("string"), p["strand"].cast("string")))
    return found.select("hash", "occ", F.array_join(text, ",").alias("places"))


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id')} SELECT rid, count(*) AS n, sum(CASE WHEN t THEN 1 ELSE 0 END)::BIGINT AS n_tandem FROM (SELECT rid, coalesce(lag(hash) OVER o = hash, false) OR coalesce(lead(hash) OVER o = hash, false) AS t FROM d WINDOW o AS (PARTITION BY rid ORDER BY pos)) GROUP BY 1")
def tandem_flags(spark: SparkSession, d: str) -> DataFrame:
    found = seeds.tandem_flags(sketch.minimizers(_documents(spark, d), "doc_id"))
    return found.groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.col("is_tandem").cast("long")).alias("n_tandem"))


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id')} SELECT rid, count(*) AS kept FROM (SELECT rid, count(*) OVER (PARTITION BY rid, hash) AS n, count(*) OVER (PARTITION BY rid) AS n_all FROM d) WHERE NOT (n > 10 AND n > n_all * 0.01) GROUP BY 1")
def query_minimizer_filter(spark: SparkSession, d: str) -> DataFrame:
    """Minimizers left to each document as a query, without those it has very often."""
    found = seeds.drop_frequent_in_query(sketch.minimizers(_documents(spark, d), "doc_id"), index.MIN_MID_OCC)
    return found.groupBy("rid").agg(F.count("*").alias("kept"))


_SEEN = f"WITH {q.both()}, s AS (SELECT b.rid, b.pos, b.hash, o.occ FROM b JOIN d_occ o ON o.hash = b.hash)"


@_register(f"{_SEEN} SELECT rid, pos, hash, occ FROM s, d_mid WHERE occ <= mid_occ")
def occurrence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the benchmark texts that are not frequent in the documents."""
    s = _sides(spark, d)
    met = s.references.join(s.queries.select("hash").distinct(), "hash", "left_semi")
    seen = seeds.with_occurrences(s.queries, index.occurrences(met))
    return seen.join(F.broadcast(s.mid_occ)).where("occ <= mid_occ").select("rid", "pos", "hash", "occ")


@_register(f"""{_SEEN}, l AS (SELECT item_id AS rid, length(text) AS len FROM benchmark),
r AS (SELECT s.*, len, occ > 3 AS high, count(*) OVER (PARTITION BY s.rid) AS n, sum(CASE WHEN occ > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS UNBOUNDED PRECEDING) AS run,
  coalesce(max(CASE WHEN occ <= 3 THEN pos END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS UNBOUNDED PRECEDING), 0) AS ps,
  coalesce(min(CASE WHEN occ <= 3 THEN pos END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), len) AS pe FROM s JOIN l ON l.rid = s.rid)
SELECT rid, pos, occ, n >= 2 AND high AND (row_number() OVER (PARTITION BY rid, run, high ORDER BY occ, pos, hash) > least(floor(CAST(pe - ps AS DOUBLE) / 500 + 0.499), 128) OR occ > 4095) AS flt FROM r""")
def high_occurrence_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Which seeds above three occurrences are dropped, and which of a run of them stay."""
    s = _sides(spark, d)
    met = s.references.join(s.queries.select("hash").distinct(), "hash", "left_semi")
    seen = seeds.with_occurrences(s.queries, index.occurrences(met)).select("rid", "pos", "hash", "occ")
    return seeds.rescue_frequent(seen, s.lengths, 3).select("rid", "pos", "occ", "flt")


@_register(f"""{_SEEN}, i AS (SELECT rid, pos - 14 AS st, pos + 1 AS en FROM s WHERE occ > 3),
n AS (SELECT rid, greatest(0, en - greatest(st, coalesce(max(en) OVER (PARTITION BY rid ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st))) AS n FROM i)
SELECT rid, CAST(sum(n) AS BIGINT) AS covered FROM n GROUP BY 1""")
def repeat_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of each benchmark text that seeds above three occurrences cover."""
    s = _sides(spark, d)
    met = s.references.join(s.queries.select("hash").distinct(), "hash", "left_semi")
    seen = seeds.with_occurrences(s.queries, index.occurrences(met)).where("occ > 3")
    return seeds.covered_length(seen.select("rid", (F.col("pos") - 14).alias("st"), (F.col("pos") + 1).alias("en")), "st", "en")


@_register(f"WITH {q.anchors()} SELECT read_id, rid, rev, rpos, qpos, CAST(span AS INTEGER) AS span FROM a")
def seed_anchors(spark: SparkSession, d: str) -> DataFrame:
    return mapping.seed_anchors(_sides(spark, d))


@_register(f"""WITH {q.anchors()}, n AS (SELECT *, row_number() OVER (PARTITION BY read_id, qpos ORDER BY rid, rpos, rev) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY read_id, qpos) / 2.0), 1) AS step FROM a)
SELECT read_id, rid, rev, rpos, qpos FROM n WHERE i % step = 0 AND floor(i / step) < 2""")
def occurrence_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most two places of each seed, in equal steps over its places (sampling is the operator)."""
    found = seeds.sample_occurrences(mapping.seed_anchors(_sides(spark, d)), 2)
    return found.select("read_id", "rid", "rev", "rpos", "qpos")


@_register(f"WITH {q.anchors()},{q.chain('a', 'c')} SELECT read_id, rid, rev, diag, cnt, score, blen, first_r, last_r, first_q, last_q FROM c")
def chain_islands(spark: SparkSession, d: str) -> DataFrame:
    found = chains.islands(mapping.seed_anchors(_sides(spark, d)))
    return found.select("read_id", "rid", "rev", "diag", "cnt", "score", "blen", "first_r", "last_r", "first_q", "last_q")


@_register(f"""WITH {q.anchors()}, s AS (SELECT *, rpos - lag(rpos) OVER (PARTITION BY read_id, rid, rev ORDER BY rpos, qpos) AS step FROM a),
o AS (SELECT *, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, rid, rev ORDER BY rpos, qpos ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT read_id, rid, rev, count(*) AS n, min(rpos) AS first_r, max(rpos) AS last_r FROM o GROUP BY read_id, rid, rev, part""")
def chain_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = chains.ranges(mapping.seed_anchors(_sides(spark, d)), max_gap=100)
    return found.select("read_id", "rid", "rev", "n", "first_r", "last_r")


_REGION = "read_id, rid, rev, qs, qe, rs, re, score, cnt, mlen, blen"


@_register(f"WITH {q.best()} SELECT {_REGION}, place FROM best")
def map_passages(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: where each benchmark text, or a large part of it, occurs in the documents, by infrequent minimizers."""
    found = hits.best_hits(map_regions(spark, d))
    return found.select(*_REGION.split(", "), "place")


@_register(f"WITH {q.mapped()} SELECT {_REGION} FROM m")
def map_regions(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_rare(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")


@_register()
def whole_regions(spark: SparkSession, d: str) -> DataFrame:
    """``map_regions`` by all minimizers, also those that very many documents share, chained across gaps."""
    return mapping.map_reads(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")


@_register()
def whole_passages(spark: SparkSession, d: str) -> DataFrame:
    """``map_passages`` by all minimizers."""
    found = mapping.map_best(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")
    return found.select(*_REGION.split(", "), "place")


@_register(f"""WITH {q.mapped()}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, cnt DESC, rid, rev, rs, qs) AS p FROM m)
SELECT x.read_id, CAST(x.p AS INTEGER) AS a, CAST(y.p AS INTEGER) AS b, least(x.qe, y.qe) - greatest(x.qs, y.qs) AS shared,
  CAST(least(x.qe, y.qe) - greatest(x.qs, y.qs) AS DOUBLE) / least(x.qe - x.qs, y.qe - y.qs) AS part
FROM r x JOIN r y ON x.read_id = y.read_id AND x.p < y.p AND x.qs < y.qe AND y.qs < x.qe""")
def hit_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return hits.overlaps(map_regions(spark, d))


@_register(f"""WITH {q.mapped()} SELECT read_id, rid, rev, qs, qe, rs, greatest(0, qe - greatest(qs, coalesce(max(qe) OVER (PARTITION BY read_id ORDER BY qs, qe, rid, rs, rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), qs))) AS fresh FROM m""")
def uncovered_length(spark: SparkSession, d: str) -> DataFrame:
    return hits.uncovered(map_regions(spark, d))


@_register(f"""WITH {q.mapped()}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, cnt DESC, rid, rev, rs, qs) AS p FROM m WHERE score >= 30)
SELECT {_REGION} FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.read_id = r.read_id AND o.rid = r.rid AND o.p < r.p
  AND least(r.re, o.re) - greatest(r.rs, o.rs) > least(r.re - r.rs, o.re - o.rs) * 0.95 AND least(r.qe, o.qe) - greatest(r.qs, o.qs) > least(r.qe - r.qs, o.qe - o.qs) * 0.95)""")
def redundancy_filter(spark: SparkSession, d: str) -> DataFrame:
    return hits.drop_redundant(map_regions(spark, d)).select(*_REGION.split(", "))


@_register(f"WITH {q.mapped()} SELECT DISTINCT read_id, rid, rev, score, rs, qs FROM m")
def distinct_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits.distinct_hits(map_regions(spark, d)).select("read_id", "rid", "rev", "score", "rs", "qs")


@_register(f"""WITH {q.sketch('d', 'documents', 'doc_id')},{q.threshold('d')},
dl AS (SELECT doc_id AS rid, CAST(coalesce(length(text), 0) AS INTEGER) AS len FROM documents),
r AS (SELECT d.* FROM d JOIN d_occ o ON o.hash = d.hash, d_mid WHERE occ <= mid_occ AND occ > 1),
a AS (SELECT x.rid AS read_id, y.rid AS rid, x.strand <> y.strand AS rev, y.pos AS rpos, CAST(CASE WHEN x.strand <> y.strand THEN dl.len - (x.pos - 14) - 1 ELSE x.pos END AS INTEGER) AS qpos, 15 AS span
  FROM r x JOIN r y ON x.hash = y.hash AND x.rid < y.rid JOIN dl ON dl.rid = x.rid),{q.chain('a', 'c')},{q.regions('c', 'dl', 'm', 100)}
SELECT read_id AS a, rid AS b, rev, max(score) AS score, CAST(sum(mlen) AS BIGINT) AS shared, count(*) AS chains FROM m GROUP BY 1, 2, 3""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share long chains of infrequent minimizers."""
    return mapping.overlap_all(_documents(spark, d), "doc_id", Options(min_score=100))


@_register()
def overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    """``overlap_pairs`` of the different texts, and each copy with the first of its text."""
    return mapping.overlap_classes(_documents(spark, d), "doc_id", Options(min_score=100))


_EXACT = f"WITH {q.exact()}"


def _exact(spark: SparkSession, d: str) -> DataFrame:
    reads, documents = _benchmark(spark, d), _documents(spark, d)
    k = exact.all_kmers(reads, "item_id", k=sketch.K)
    few = mapping.few(k)
    r = exact.all_kmers(documents, "doc_id", k=sketch.K, only=mapping.known_hashes(k) if few else None)
    met = r if few else r.join(k.select("hash").distinct(), "hash", "left_semi")
    return exact.maximal_matches(seeds.anchors(k, met, mapping.lengths(reads, "item_id"), broadcast=few))


@_register(f"{_EXACT} SELECT read_id, rid, rev, qbeg, qend, rbeg FROM x")
def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    """All maximal exact matches of at least a k-mer, on either strand."""
    return _exact(spark, d)


@_register(f"""{_EXACT}, g AS (SELECT read_id, rev, qbeg, qend, count(*) AS own FROM x GROUP BY 1, 2, 3, 4)
SELECT read_id, rev, qbeg, qend, CAST((SELECT sum(i.own) FROM g i WHERE i.read_id = g.read_id AND i.rev = g.rev AND i.qbeg <= g.qbeg AND i.qend >= g.qend) AS BIGINT) AS occ
FROM g WHERE NOT EXISTS (SELECT 1 FROM g i WHERE i.read_id = g.read_id AND i.rev = g.rev AND i.qbeg <= g.qbeg AND i.qend >= g.qend AND (i.qbeg, i.qend) <> (g.qbeg, g.qend))""")
def super_maximal_matches(spark: SparkSession, d: str) -> DataFrame:
    return exact.super_maximal(_exact(spark, d))


@_register("""WITH c AS (SELECT doc_id AS rid, length(text) AS len, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents),
p AS (SELECT o_orderkey, (o_orderkey * 104729) % (SELECT sum(len) FROM c) AS spot FROM orders)
SELECT o_orderkey, rid, CAST(spot - start AS BIGINT) AS place FROM p JOIN c ON spot >= start AND spot < start + len""")
def locate_positions(spark: SparkSession, d: str) -> DataFrame:
    """The document, and the place in it, of positions in the concatenation of all documents."""
    contigs = intervals.contig_offsets(mapping.lengths(_documents(spark, d), "doc_id"))
    total = contigs.agg(F.sum("len").cast("long").alias("total"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    points = orders.join(F.broadcast(total)).select("o_orderkey", ((F.col("o_orderkey") * 104729) % F.col("total")).alias("at"))
    return intervals.locate(points, contigs).select("o_orderkey", "rid", F.col("place").cast("long").alias("place"))


@_register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)
SELECT doc_id, count(*) AS introns, CAST(sum(following - en) AS BIGINT) AS bases FROM (SELECT doc_id, st + n AS en, lead(st) OVER (PARTITION BY doc_id ORDER BY st, st + n) AS following FROM p) WHERE following > en GROUP BY 1""")
def block_introns(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the blocks of BED12 rows whose blocks are the lines of a document."""
    lines = F.split("text", "\n")
    sized = _documents(spark, d).where(F.col("text").isNotNull()).select("doc_id", "text", F.transform(lines, lambda x: F.length(x)).alias("n"))
    starts = F.transform(running(F.transform("n", lambda n: n + 1)), lambda x: x.cast("string"))
    rows = sized.select(
        F.col("doc_id").cast("string").alias("name"), F.lit("text").alias("chrom"), F.lit(0).alias("st"), F.length("text").alias("en"), F.lit("+").alias("strand"),
        F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("block_sizes"), F.array_join(starts, ",").alias("block_starts"),
    )
    gaps = intervals.introns(intervals.bed_blocks(rows))
    return gaps.groupBy(F.col("name").cast("long").alias("doc_id")).agg(F.count("*").alias("introns"), F.sum(F.col("en") - F.col("st")).cast("long").alias("bases"))


@_register(f"""WITH {q.sketch('d', 'documents', 'doc_id')},
p AS (SELECT CAST(strand * 2 + lead(strand, 20) OVER o AS INTEGER) AS dir, lead(pos, 20) OVER o - pos AS size FROM d WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT dir, size, row_number() OVER (PARTITION BY dir ORDER BY size) AS i, count(*) OVER (PARTITION BY dir) AS n FROM p WHERE size > 0 AND size <= 10000),
t AS (SELECT dir, min(CASE WHEN i > floor(0.25 * n + 0.499) THEN size END) AS p25, min(CASE WHEN i > floor(0.5 * n + 0.499) THEN size END) AS p50, min(CASE WHEN i > floor(0.75 * n + 0.499) THEN size END) AS p75, max(n) AS n FROM g GROUP BY 1),
i AS (SELECT g.dir, CAST(sum(size) AS DOUBLE) / count(*) AS avg, sqrt(CAST(sum(size * size) AS DOUBLE) / count(*) - pow(CAST(sum(size) AS DOUBLE) / count(*), 2)) AS std FROM g JOIN t ON t.dir = g.dir
  WHERE size >= greatest(1, p25 - 2 * (p75 - p25)) AND size <= p75 + 2 * (p75 - p25) GROUP BY g.dir)
SELECT t.dir, n, p25, p50, p75, round(avg, 6) AS avg, round(std, 6) AS std,
  CAST(greatest(1, least(floor(p25 - 3.0 * (p75 - p25) + 0.499), floor(avg - 4.0 * std + 0.499))) AS BIGINT) AS low,
  CAST(greatest(floor(p75 + 3.0 * (p75 - p25) + 0.499), floor(avg + 4.0 * std + 0.499)) AS BIGINT) AS high,
  n < 10 OR n < max(n) OVER () * 0.05 AS failed FROM t JOIN i ON i.dir = t.dir""")
def insert_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Distance statistics, by orientation, of minimizers twenty apart in their document."""
    order = Window.partitionBy("rid").orderBy("pos")
    found = sketch.minimizers(_documents(spark, d), "doc_id")
    pairs = found.select(
        (F.col("strand") * 2 + F.lead("strand", 20).over(order)).alias("dir"), (F.lead("pos", 20).over(order) - F.col("pos")).alias("size")
    ).where("size IS NOT NULL")
    return hits.pair_statistics(pairs).withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)})


@_register(f"WITH {q.sketch('d', 'documents', 'doc_id', compressed=True)} SELECT rid, count(*) AS n, CAST(sum(span) AS BIGINT) AS spans, CAST(sum(hash) AS BIGINT) AS hashes FROM d GROUP BY 1")
def compressed_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Minimizers over homopolymer-compressed documents, a row for each document."""
    found = sketch.minimizers(_documents(spark, d), "doc_id", compressed=True)
    return found.groupBy("rid").agg(F.count("*").alias("n"), F.sum("span").alias("spans"), F.sum("hash").alias("hashes"))


@_register()
def low_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Repetitive stretches of the benchmark texts."""
    return intervals.mask_low_complexity(_benchmark(spark, d), "item_id")


@_register()
def masked_minimizers(spark: SparkSession, d: str) -> DataFrame:
    """Minimizers of the benchmark texts outside repetitive stretches."""
    reads = _benchmark(spark, d)
    return intervals.drop_masked(sketch.minimizers(reads, "item_id"), intervals.mask_low_complexity(reads, "item_id"))


@_register()
def chain_dp(spark: SparkSession, d: str) -> DataFrame:
    return chains.chain_dp(mapping.all_anchors(_sides(spark, d))).drop("mlen", "blen")


@_register(f"WITH {q.anchors(rare=False)},{q.chain('a', 'c')} SELECT read_id, rid, rev, score, cnt, CAST(first_r AS INTEGER) AS first_r, CAST(last_r AS INTEGER) AS last_r, CAST(first_q AS INTEGER) AS first_q, CAST(last_q AS INTEGER) AS last_q FROM c WHERE cnt >= 3 AND score >= 40")
def chain_diagonals(spark: SparkSession, d: str) -> DataFrame:
    """Chains by dynamic programming within a band of nothing."""
    found = chains.chain_dp(mapping.all_anchors(_sides(spark, d)), band=0)
    return found.select("read_id", "rid", "rev", "score", "cnt", "first_r", "last_r", "first_q", "last_q")


@_register()
def chain_rmq(spark: SparkSession, d: str) -> DataFrame:
    return chains.chain_rmq(mapping.all_anchors(_sides(spark, d))).drop("mlen", "blen")


@_register(f"""WITH {q.anchors(rare=False)},{q.chain('a', 'c')}, f AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS n, row_number() OVER (PARTITION BY read_id ORDER BY rev, rid, first_r, last_r, first_q, last_q) AS i FROM c)
SELECT read_id, n > 1 AND (len - (last_q - first_q) > 1000 OR last_q - first_q > len * CAST(0.1 AS DOUBLE)) AS again FROM f JOIN len ON len.rid = f.read_id WHERE i = 1""")
def rechain_flags(spark: SparkSession, d: str) -> DataFrame:
    s = _sides(spark, d)
    return chains.needs_rechaining(chains.islands(mapping.all_anchors(s)), s.lengths)


@_register()
def chain_greedy(spark: SparkSession, d: str) -> DataFrame:
    found = _exact(spark, d)
    return chains.chain_greedy(found.select("read_id", "rid", "rev", "rbeg", "qbeg", (F.col("qend") - F.col("qbeg")).alias("mlen")))


@_register()
def primary_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their parents, secondaries near them, and mapping quality."""
    return mapping.map_primary(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")


@_register()
def align_passages(spark: SparkSession, d: str) -> DataFrame:
    """Base alignments of the best hits, on their strand, with CIGAR, edits and identity."""
    best = whole_passages(spark, d).where("place = 1")
    found = mapping.align_hits(best, _benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")
    return found.withColumns(
        {
            "identity": F.when(F.col("columns") > 0, cigars.event_identity(F.col("matches"), F.col("columns"), F.col("cigar"))),
            "q_bases": cigars.query_length(F.col("cigar")),
            "t_bases": cigars.reference_length(F.col("cigar")),
        }
    )


@_register(f"""WITH {q.mapped()}, n AS (SELECT m.read_id, m.rid, m.rev, m.qs, m.qe, m.rs, count(*) AS n_tot FROM m JOIN b ON b.rid = m.read_id AND b.pos - 14 >= m.qs AND b.pos + 1 <= m.qe GROUP BY ALL)
SELECT m.read_id, m.rid, m.rev, m.qs, m.rs, cnt, n_tot, round(CASE WHEN cnt >= n_tot THEN 0.0 ELSE 1 - pow(CAST(cnt AS DOUBLE) / n_tot, 1.0 / 15) END, 6) AS div
FROM m JOIN n ON n.read_id = m.read_id AND n.rid = m.rid AND n.rev = m.rev AND n.qs = m.qs AND n.qe = m.qe AND n.rs = m.rs""")
def hit_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Estimated divergence of every region from the minimizers that it matches."""
    found = scoring.divergence(map_regions(spark, d), sketch.minimizers(_benchmark(spark, d), "item_id"), sketch.K)
    return found.select("read_id", "rid", "rev", "qs", "rs", "cnt", "n_tot", F.round("div", 6).alias("div"))


@_register(f"WITH {q.mapped()},{q.rivals()} SELECT read_id, rid, rev, qs, rs, score, sub, sub_n FROM v")
def hit_rivals(spark: SparkSession, d: str) -> DataFrame:
    """The best competing score of every region, and how many compete."""
    return scoring.rivals(map_regions(spark, d)).select("read_id", "rid", "rev", "qs", "rs", "score", "sub", "sub_n")


@_register(f"WITH {q.mapped()},{q.rivals()} SELECT {_REGION}, sub, sub_n, CAST(0 AS DOUBLE) AS frac_rep, {q.mapq_short()} AS mapq FROM v")
def mapq_short(spark: SparkSession, d: str) -> DataFrame:
    """Short-read mapping quality of every region."""
    return scoring.mapq_short(scoring.rivals(map_regions(spark, d)).withColumn("frac_rep", F.lit(0.0)))


@_register(f"""WITH {q.mapped()}, l AS (SELECT doc_id AS rid, length(text) AS len FROM documents)
SELECT m.read_id, concat_ws(chr(9), m.read_id, len.len, qs, qe, CASE WHEN rev THEN '-' ELSE '+' END, m.rid, l.len, rs, re, mlen, blen, 255) AS line
FROM m JOIN len ON len.rid = m.read_id JOIN l ON l.rid = m.rid""")
def paf_records(spark: SparkSession, d: str) -> DataFrame:
    return scoring.paf_lines(map_regions(spark, d), mapping.lengths(_benchmark(spark, d), "item_id"), mapping.lengths(_documents(spark, d), "doc_id"))


@_register(f"""WITH {q.best()} SELECT read_id, string_agg(rid || ',' || CASE WHEN rev THEN '-' ELSE '+' END || (rs + 1) || ',' || (qe - qs) || 'M;', '' ORDER BY place) AS xa FROM best WHERE place > 1 GROUP BY 1""")
def other_places(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text's hits after the first, as one string."""
    return scoring.other_places(map_passages(spark, d))


@_register(f"{_EXACT} SELECT read_id, rid, rev, count(*) AS matches, CAST(sum(qend - qbeg) AS BIGINT) AS bases, max(qend - qbeg) AS longest FROM x GROUP BY 1, 2, 3")
def match_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches of each benchmark text and document: their number, bases and longest."""
    n = F.col("qend") - F.col("qbeg")
    return _exact(spark, d).groupBy("read_id", "rid", "rev").agg(F.count("*").alias("matches"), F.sum(n).cast("long").alias("bases"), F.max(n).alias("longest"))


@_register(f"""WITH {q.mapped()},{q.exact('e')}, p AS (SELECT x.read_id, x.rid, x.rev, CASE WHEN x.rev THEN l.len - qend ELSE qbeg END AS mq, rbeg AS mr, qend - qbeg AS n FROM ex x JOIN el l ON l.rid = x.read_id),
t AS (SELECT m.read_id, m.rid, m.rev, qs, qe, rs, re, sum(n) AS n FROM m JOIN p ON p.read_id = m.read_id AND p.rid = m.rid AND p.rev = m.rev WHERE mq >= qs AND mq + n <= qe AND mr >= rs AND mr + n <= re GROUP BY ALL)
SELECT m.read_id, m.rid, m.rev, m.qs, m.qe, m.rs, m.re, score, cnt, mlen, blen, CAST(coalesce(t.n, 0) AS BIGINT) AS seedcov FROM m LEFT JOIN t ON t.read_id = m.read_id AND t.rid = m.rid AND t.rev = m.rev AND t.qs = m.qs AND t.qe = m.qe AND t.rs = m.rs AND t.re = m.re""")
def seed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Exactly matched bases of every region."""
    return scoring.seed_coverage(map_regions(spark, d), _exact(spark, d), mapping.lengths(_benchmark(spark, d), "item_id")).select(*_REGION.split(", "), "seedcov")


@_register()
def chain_filter(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chains without those that much heavier ones overlap."""
    return chains.filter_chains(chain_greedy(spark, d))


@_register(f"""WITH {q.anchors()}, s AS (SELECT *, rpos - qpos AS diag, rpos - lag(rpos) OVER (PARTITION BY read_id, rid, rev, rpos - qpos ORDER BY rpos) AS step FROM a),
o AS (SELECT *, sum(CASE WHEN step <= 15 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, rid, rev, diag ORDER BY rpos) AS part FROM s),
g AS (SELECT read_id, rid, rev, diag, min(rpos) AS first_r, max(rpos) AS last_r, CAST(count(*) AS INTEGER) AS cnt, max(rpos) - min(rpos) + 15 AS bases FROM o GROUP BY read_id, rid, rev, diag, part)
SELECT read_id, rid, rev, first_r, last_r, cnt, bases FROM (SELECT *, row_number() OVER (PARTITION BY read_id, rid, rev ORDER BY bases DESC, first_r, diag) AS n FROM g) WHERE n = 1""")
def longest_stretch(spark: SparkSession, d: str) -> DataFrame:
    return chains.longest_stretch(mapping.seed_anchors(_sides(spark, d)))


@_register("WITH n AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT name, n FROM n WHERE name IS NOT NULL")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that several contigs bear, a document's source standing for its name."""
    return index.duplicate_names(_documents(spark, d).where("source IS NOT NULL").select(F.col("source").alias("name")))


@_register("SELECT l.lang AS name, count(*) AS n, bool_or(o.lang IS NOT NULL) AS is_alt FROM documents l LEFT JOIN (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM documents) / 8.0) o ON o.lang = l.lang WHERE l.lang IS NOT NULL GROUP BY 1")
def alternative_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that a list names: here the list is the languages of fewer than an eighth of the documents."""
    named = _documents(spark, d).select(F.col("lang").alias("name"))
    sizes = named.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    total = named.agg(F.count("*").alias("total"))
    listed = sizes.join(F.broadcast(total)).where("n < total / 8.0")
    return index.mark_alternative(sizes, listed).select("name", "n", "is_alt")


@_register()
def reseed_matches(spark: SparkSession, d: str) -> DataFrame:
    """Second- and third-round seeds of the benchmark texts."""
    return exact.reseed(_exact(spark, d))


@_register()
def align_chains(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark texts aligned through the chains of their best hits."""
    s = _sides(spark, d)
    anchors = mapping.all_anchors(s)
    best = hits.best_hits(chains.regions(chains.islands(anchors), s.lengths)).where("place = 1")
    return mapping.align_chains(best, anchors, _benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")
