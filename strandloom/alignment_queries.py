"""Registered queries on DNA, repaired chains, split alignments, two gap prices, introns and mates.

Texts stand for DNA by their characters' codes (``sketch.nucleotides``); reads are made from benchmark texts, so that it
is known what they differ by from the documents that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import sql_parts as q
from strandloom.functions.sequence import reverse_complement
from strandloom.jobs import alignment, mapping, pairs, parts, seed_quality, seeding
from strandloom.jobs.options import Options
from strandloom.operators import chains, gaps, hits, repair, scoring, seeds, sketch
from strandloom.queries import _REGION, _benchmark, _documents, _exact, _register, map_regions

DNA = Options(alphabet="dna")
#: Limits for reads of about 200 bases: shorter stretches count as inversions and exons.
SHORT = Options(alphabet="dna", min_score=25, zdrop=100, zdrop_inv=30, min_dp_score=60)
PAIRED = Options(alphabet="dna", w=5, min_cnt=2, min_score=25, match=1, mismatch=4, gap_open=6, gap_extend=1)


def _genome(spark: SparkSession, d: str) -> DataFrame:
    return sketch.nucleotides(_documents(spark, d), "doc_id")


def _reads(spark: SparkSession, d: str, change: Column | None = None) -> DataFrame:
    found = sketch.nucleotides(_benchmark(spark, d), "item_id")
    return found if change is None else found.select("item_id", change.alias("text"))


def _third() -> tuple[Column, Column, Column]:
    """A text's thirds, the last with what is left."""
    n = F.floor(F.length("text") / 3).cast("int")
    return F.substring("text", F.lit(1), n), F.substring("text", n + 1, n), F.substring("text", 2 * n + 1, F.length("text"))


@_register(f"WITH {q.best()} SELECT {_REGION}, place FROM best")
def map_nucleotides(spark: SparkSession, d: str) -> DataFrame:
    """``map_passages`` of texts written as DNA: the same places, found by the DNA alphabet."""
    found = hits.best_hits(mapping.map_rare(_reads(spark, d), "item_id", _genome(spark, d), "doc_id", DNA))
    return found.select(*_REGION.split(", "), "place")


@_register()
def repaired_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of benchmark texts without a middle third, repaired: anchors trimmed, skipped and joined."""
    first, _, last = _third()
    s = mapping.sketch_both(_reads(spark, d, F.concat(first, last)), "item_id", _genome(spark, d), "doc_id", SHORT)
    found = chains.chain_again(mapping.all_anchors(s), s.lengths, 500, 20_000, points=True)
    key = ("read_id", "rid", "rev", "chain", "cnt")
    fixed = repair.repaired(found, key)
    ends = F.element_at("points", 1), F.element_at("points", -1)
    return fixed.select(*key, "trimmed", "skipped", "joins", *[e[k].alias(f"{side}_{k}") for side, e in zip(("first", "last"), ends, strict=True) for k in ("q", "t")])


@_register()
def inverted_passages(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of benchmark texts whose middle third is turned: two parts and the inversion between them."""
    first, middle, last = _third()
    return alignment.align_reads(_reads(spark, d, F.concat(first, reverse_complement(middle), last)), "item_id", _genome(spark, d), "doc_id", SHORT)


@_register()
def aligned_nucleotides(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of benchmark texts as DNA, through repaired chains, with gaps as far left as they go."""
    return alignment.align_reads(_reads(spark, d), "item_id", _genome(spark, d), "doc_id", DNA)


def _fragments(spark: SparkSession, d: str, reads: DataFrame) -> DataFrame:
    """Each read's best hit with the read's part and the reference's under it, as q and t."""
    genome = _genome(spark, d)
    best = mapping.map_best(reads, "item_id", genome, "doc_id", SHORT).where("place = 1")
    placed = best.select("read_id", "rid", "rev", "qs", "qe", "rs", "re", F.col("rs").alias("w_from"), (F.col("re") - F.col("rs")).alias("w_len"))
    cut = mapping.windows(placed, genome, "doc_id", mapping.few(reads))
    own = reads.select(F.col("item_id").alias("read_id"), "text")
    return cut.join(own, "read_id").withColumn("q", F.expr("substring(text, qs + 1, qe - qs)"))


@_register()
def long_gap_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts without their middle third under their best hits, with two gap prices."""
    first, _, last = _third()
    found = _fragments(spark, d, _reads(spark, d, F.concat(first, last)))
    return gaps.align_fragments_by(found, ("read_id", "rid", "rev", "rs", "re"), "global", gaps.TwoGaps(), turned="rev", band=500)


def _without_intron() -> Column:
    """A text without the stretch from its first GT after 60 bases to the first AG 40 bases on; whole where there is none."""
    begin = F.locate("GT", F.col("text"), 61)
    end = F.expr("locate('AG', text, locate('GT', text, 61) + 40)")
    cut = F.concat(F.substring("text", F.lit(1), begin - 1), F.substring(F.col("text"), end + 2, F.length("text")))
    return F.when((begin > 0) & (end > 0), cut).otherwise(F.col("text"))


@_register()
def spliced_passages(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts without a stretch between splice sites under their best hits, spliced."""
    found = _fragments(spark, d, _reads(spark, d, _without_intron()))
    return gaps.align_fragments_by(found, ("read_id", "rid", "rev", "rs", "re"), "spliced", gaps.Splice(), turned="rev")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 bases of each benchmark text, and the last 60 turned; of every fifth text these have no seed left."""
    found = _reads(spark, d)
    tail = reverse_complement(F.expr("right(text, 60)"))
    letters = F.filter(F.split(tail, ""), lambda c: c != "")
    broken = F.array_join(F.transform(letters, lambda c, i: F.when(i % 12 == 6, F.translate(c, "ACGT", "CGTA")).otherwise(c)), "")
    return found.select("item_id", F.expr("left(text, 60)").alias("text"), F.when(F.col("item_id") % 5 == 0, broken).otherwise(tail).alias("mate_text"))


def _mapped_pairs(spark: SparkSession, d: str) -> pairs.Pairs:
    return pairs.map_pairs(_pairs(spark, d), "item_id", _genome(spark, d), "doc_id", PAIRED, min_count=3)


@_register()
def rescued_mates(spark: SparkSession, d: str) -> DataFrame:
    """Hits of both ends of the pairs, seeded and rescued where the insert-size model expects a mate."""
    return _mapped_pairs(spark, d).hits


@_register()
def modelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's best two hits by scores and insert size."""
    best = _mapped_pairs(spark, d).best
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("rev", "qs", "qe", "rs", "re", "score", "rescued")]
    return best.select("read_id", "rid", "dir", "size", "total", "sub", "pairs", *sides)


@_register()
def chain_rmq_inner(spark: SparkSession, d: str) -> DataFrame:
    """Chains of benchmark texts by the best predecessor in range, near ones all tried."""
    s = mapping.sketch_both(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id")
    return chains.chain_rmq(mapping.all_anchors(s), inner=1000).drop("mlen", "blen")


#: Three places make a minimizer frequent; of a run of frequent ones as many stay as it has stretches of 60 characters.
BOUNDED = Options(min_mid_occ=3, max_mid_occ=3, occ_dist=60)

_SELECTED = f"""{q.both()}, len AS (SELECT item_id AS rid, CAST(coalesce(length(text), 0) AS INTEGER) AS len FROM benchmark),
o AS (SELECT *, count(*) OVER (PARTITION BY rid, hash) AS q_n, count(*) OVER (PARTITION BY rid) AS q_all FROM b),
s AS (SELECT o.rid, o.pos, o.strand, o.hash, o.span, occ FROM o JOIN d_occ ON d_occ.hash = o.hash WHERE NOT (q_n > 3 AND q_n > q_all * CAST(0.01 AS DOUBLE))),
r AS (SELECT s.*, len, occ > 3 AS high, count(*) OVER (PARTITION BY s.rid) AS n, sum(CASE WHEN occ > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS UNBOUNDED PRECEDING) AS run,
  coalesce(max(CASE WHEN occ <= 3 THEN pos END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS UNBOUNDED PRECEDING), 0) AS ps,
  coalesce(min(CASE WHEN occ <= 3 THEN pos END) OVER (PARTITION BY s.rid ORDER BY pos, hash ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), len) AS pe FROM s JOIN len l ON l.rid = s.rid),
f AS (SELECT *, n >= 2 AND high AND (row_number() OVER (PARTITION BY rid, run, high ORDER BY occ, pos, hash) > least(floor(CAST(pe - ps AS DOUBLE) / 60 + CAST(0.499 AS DOUBLE)), 128) OR occ > 4095) AS flt FROM r)"""


@_register(f"""WITH {_SELECTED},
a AS (SELECT k.rid AS read_id, y.rid AS rid, k.strand <> y.strand AS rev, y.pos AS rpos,
  CAST(CASE WHEN k.strand <> y.strand THEN k.len - (k.pos - 14) - 1 ELSE k.pos END AS INTEGER) AS qpos, 15 AS span FROM f k JOIN d y ON y.hash = k.hash WHERE NOT k.flt),
{q.chain('a', 'c')},{q.regions('c', 'len', 'm')} SELECT {_REGION} FROM m""")
def bounded_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of benchmark texts by bounded seeds, chained on one diagonal."""
    s = mapping.sketch_both(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id", BOUNDED)
    kept = seeding.select_seeds(s, BOUNDED).where(~F.col("flt")).select("rid", "pos", "strand", "hash", "span")
    found = chains.islands(seeds.anchors(kept, s.references, s.lengths))
    return chains.regions(found, s.lengths).select(*_REGION.split(", "))


@_register()
def bounded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Regions of benchmark texts by bounded seeds in two rounds, chained across gaps."""
    options = Options(min_mid_occ=3, max_mid_occ=3, occ_dist=60, max_occ=20)
    return seeding.map_seeded(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id", options)


@_register()
def scored_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches of benchmark texts with the score of what surrounds them, short texts too."""
    return seed_quality.score_seeds(_exact(spark, d), _benchmark(spark, d), "item_id", _documents(spark, d), "doc_id", short_part=1.0)


@_register()
def primary_hits_by_parts(spark: SparkSession, d: str) -> DataFrame:
    """``primary_hits`` with the documents dealt to three indexes, hits ranked together."""
    return parts.map_by_parts(_benchmark(spark, d), "item_id", _documents(spark, d), "doc_id", 3)


@_register()
def hits_marked_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Regions of benchmark texts marked in two rounds; documents that repeat an earlier one's text are the alternatives."""
    _, members = mapping.classes(_documents(spark, d), "doc_id")
    copies = members.where("rid <> member").select(F.col("member").alias("rid"), F.lit(True).alias("is_alt"))
    found = map_regions(spark, d).join(copies, "rid", "left").withColumn("is_alt", F.coalesce("is_alt", F.lit(False)))
    return hits.mark_primaries(found)


@_register()
def paf_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Records of the alignments of ``inverted_passages``, with their differences base by base."""
    reads, genome = _benchmark(spark, d), _documents(spark, d)
    lens = mapping.lengths(reads, "item_id"), mapping.lengths(genome, "doc_id")
    return scoring.paf_alignments(inverted_passages(spark, d), *lens)


@_register()
def sam_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SAM records of the pairs of ``rescued_mates``, with their mates' fields."""
    return pairs.sam_pairs(_pairs(spark, d), "item_id", _genome(spark, d), "doc_id", PAIRED, min_count=3, prefix="doc")
