"""Paired reads: both ends mapped, the insert size modelled, missing mates rescued and the best pair chosen by the model."""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandloom.functions import cigar as cigars
from strandloom.jobs import mapping
from strandloom.jobs.options import Options
from strandloom.operators import align, hits, mates, records, scoring
from strandloom.shared import Workspace


class Pairs(NamedTuple):
    """Hits of both ends (with ``seg`` and whether rescued), the insert-size bounds and each fragment's best pair."""

    hits: DataFrame
    bounds: DataFrame
    best: DataFrame


def ungapped_score(options: Options) -> align.Scoring:
    return align.Scoring(options.match, options.mismatch, options.gap_open, options.gap_extend, zdrop=options.zdrop)


def _end(pairs: DataFrame, key: str, text: str) -> DataFrame:
    return pairs.select(F.col(key).alias("read_id"), F.col(text).alias("text"))


def rescued_mates(
    anchors: DataFrame, mate_hits: DataFrame, mate_reads: DataFrame, references: DataFrame, r_key: str, bounds: DataFrame, options: Options = Options(), min_seed: int = mates.MIN_SEED  # noqa: B008
) -> DataFrame:
    """Hits of mates (``mate_reads`` read_id, text) found where their reads' hits ask for them; see ``mates.rescue``.

    Windows, as long as the bounds are apart and a mate, are cut where the references are read.
    """
    spans = mates.rescue_windows(anchors, mate_hits, mapping.lengths(mate_reads, "read_id"), bounds)
    cut = mapping.windows(spans, references, r_key, mapping.few(spans, mapping.BROADCAST_ROWS))
    rows = cut.join(mate_reads.select("read_id", F.col("text").alias("q")), "read_id")
    return mates.rescue(rows, ungapped_score(options), min_seed, options.alphabet)


@F.pandas_udf(DoubleType())
def _tail(z: pd.Series) -> pd.Series:
    """Share of a normal distribution that lies further than z deviations from its mean."""
    return z.map(lambda x: math.erfc(abs(x) * math.sqrt(0.5)))


def size_score(size: Column, avg: Column, std: Column, match: int) -> Column:
    """What a size takes off a pair's score: the logarithm of how likely one so far from the mean is, in matches."""
    return F.lit(0.721 * match) * F.log(2.0 * _tail((size - avg) / std))


def pair_by_model(left: DataFrame, right: DataFrame, bounds: DataFrame, match: int = 1) -> DataFrame:
    """Each fragment's best pair of hits within the bounds: scores of both and of the size, ``sub`` the second best pair's.

    (read_id, rid, dir, size, total, sub, pairs, a, b); a and b are the two hits.  Equal pairs go by place.
    """
    names = ("rev", "qs", "qe", "rs", "re", "score", "rescued")

    def side(found: DataFrame, name: str) -> DataFrame:
        return found.select("read_id", "rid", F.struct(*names).alias(name), first(F.col("rev"), F.col("rs"), F.col("re")).alias(f"{name}_at"))

    first = mates.first_base
    met = side(left, "a").join(side(right, "b"), ["read_id", "rid"])
    direction, size = mates.pair_geometry(F.col("a.rev"), F.col("a_at"), F.col("b.rev"), F.col("b_at"))
    usable = F.broadcast(bounds.where(~F.col("failed")).select("dir", "low", "high", "avg", "std"))  # four rows at most
    near = met.withColumns({"dir": direction, "size": size}).join(usable, "dir").where(F.col("size").between(F.col("low"), F.col("high")))
    gained = (F.col("a.score") + F.col("b.score") + size_score(F.col("size"), F.col("avg"), F.greatest("std", F.lit(1.0)), match) + 0.499).cast("int")
    scored = near.withColumn("total", F.greatest(gained, F.lit(0)))
    order = Window.partitionBy("read_id").orderBy(F.desc("total"), "rid", "a.rs", "b.rs", "a.rev", "a.qs", "b.qs")
    ranked = scored.withColumns(
        {"p_place": F.row_number().over(order), "sub": F.lead("total", 1, 0).over(order), "pairs": F.count("*").over(Window.partitionBy("read_id"))}
    )
    return ranked.where("p_place = 1").select("read_id", "rid", "dir", "size", "total", "sub", "pairs", "a", "b")


def map_pairs(
    pairs: DataFrame, key: str, references: DataFrame, r_key: str, options: Options = Options(), left: str = "text", right: str = "mate_text",  # noqa: B008
    min_seed: int = mates.MIN_SEED, min_count: int = 10,
) -> Pairs:
    """Map both reads of every fragment (key, left, right), each as it was read.

    Best hits of both ends give the insert-size model (``pair_statistics``), and this the windows where ends without a
    fitting mate are looked for; what is found there joins the hits.  Null and short reads have no hit and can still be
    rescued, if they match ``min_seed`` bases.  Hits of both ends are stored once.
    """
    work = Workspace(references.sparkSession)
    reads = {"a": _end(pairs, key, left), "b": _end(pairs, key, right)}
    stored = mapping.index_for(list(reads.values()), "read_id", references, r_key, options)
    columns = ["read_id", "rid", "rev", "qs", "qe", "rs", "re", "score"]
    seeded = {s: work.stash(mapping.map_best(r, "read_id", references, r_key, options, stored).select(*columns), f"seeded-{s}") for s, r in reads.items()}
    bounds = work.stash(hits.pair_statistics(mates.unique_pairs(seeded["a"], seeded["b"]), min_count), "bounds")
    every = {}
    for own, other in (("a", "b"), ("b", "a")):
        found = rescued_mates(seeded[other], seeded[own], reads[own], references, r_key, bounds, options, min_seed)
        both = seeded[own].withColumn("rescued", F.lit(False)).unionByName(found.select(*columns).withColumn("rescued", F.lit(True)))
        # A place that was found both ways is one hit.
        best = F.max_by(F.struct("score", "rescued"), F.struct("score", ~F.col("rescued"))).alias("b")
        every[own] = both.groupBy("read_id", "rid", "rev", "qs", "qe", "rs", "re").agg(best).select(*columns[:-1], "b.score", "b.rescued")
    hit_rows = work.stash(every["a"].withColumn("seg", F.lit(0)).unionByName(every["b"].withColumn("seg", F.lit(1))), "hits")
    ends = (hit_rows.where(F.col("seg") == k).drop("seg") for k in (0, 1))
    return Pairs(hit_rows, bounds, pair_by_model(*ends, bounds, options.match))


#: Bases beyond a hit in which the rest of its read is aligned.
PAD = 20


def aligned_ends(chosen: DataFrame, reads: DataFrame, references: DataFrame, r_key: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Hits (read_id, seg, place, rid, rev, qs, qe, rs, re, ...) with the local alignment of their whole end around them.

    ``reads`` has (read_id, seg, text).  Windows are as long as an end and PAD on both sides, cut where references are read.
    """
    met = chosen.join(reads.select("read_id", "seg", F.coalesce(F.length("text"), F.lit(0)).alias("len")), ["read_id", "seg"])
    lead = F.when(F.col("rev"), F.col("len") - F.col("qe")).otherwise(F.col("qs"))
    begin = F.greatest(F.lit(0), F.col("rs") - lead - PAD)
    key = ("read_id", "seg", "place", "rid", "rev", "w_from", "len")
    spans = met.select(*key[:-2], begin.alias("w_from"), "len", (F.col("re") + F.col("len") - lead - (F.col("qe") - F.col("qs")) + PAD - begin).alias("w_len"))
    cut = mapping.windows(spans, references, r_key, mapping.few(spans))
    rows = cut.join(reads.select("read_id", "seg", F.col("text").alias("q")), ["read_id", "seg"])
    return align.align_parts(rows, key, ungapped_score(options), options.alphabet)


def sam_pairs(
    pairs: DataFrame, key: str, references: DataFrame, r_key: str, options: Options = Options(), left: str = "text", right: str = "mate_text",  # noqa: B008
    min_seed: int = mates.MIN_SEED, min_count: int = 10, prefix: str = "ref",
) -> DataFrame:
    """(read_id, seg, place, line): SAM records of both reads of every fragment, as ``map_pairs`` places them.

    The best pair's hits are proper; an end that is in no pair has its best hit, if any.  mapq is that of short reads, by
    the end's other hits; XS is the best other one's score.  Names are the fragment's key and ``prefix`` with the reference's.
    """
    work = Workspace(references.sparkSession)
    found = map_pairs(pairs, key, references, r_key, options, left, right, min_seed, min_count)
    names = ("read_id", "rid", "rev", "qs", "qe", "rs", "re", "score")
    best = work.stash(found.best, "best")
    proper = [best.select("read_id", F.lit(seg).alias("seg"), "rid", *[F.col(f"{s}.{c}").alias(c) for c in names[2:]], F.lit(True).alias("proper")) for seg, s in ((0, "a"), (1, "b"))]
    paired = proper[0].unionByName(proper[1])
    order = Window.partitionBy("read_id", "seg").orderBy(F.desc("score"), "rid", "rev", "rs", "qs")
    single = found.hits.join(paired.select("read_id", "seg"), ["read_id", "seg"], "left_anti").withColumn("s_place", F.row_number().over(order))
    firsts = paired.unionByName(single.where("s_place = 1").select("read_id", "seg", *names[1:], F.lit(False).alias("proper")))
    ranked = scoring.rivals(found.hits.withColumn("read_id", F.struct("read_id", "seg"))).withColumn("frac_rep", F.lit(0.0))
    quality = scoring.mapq_short(ranked, options.match, options.mismatch, min_seed).select("read_id.read_id", "read_id.seg", *names[1:-1], "sub", "mapq")
    chosen = work.stash(firsts.join(quality, ["read_id", "seg", *names[1:-1]]).withColumn("place", F.lit(1)), "chosen")
    reads = _end(pairs, key, left).withColumn("seg", F.lit(0)).unionByName(_end(pairs, key, right).withColumn("seg", F.lit(1)))
    told = aligned_ends(chosen, reads, references, r_key, options).join(chosen.select("read_id", "seg", "sub", "mapq", "proper"), ["read_id", "seg"])
    lines = told.select(
        "read_id", "seg", "place", F.concat(F.lit(prefix), F.col("rid").cast("string")).alias("rname"), (F.col("t_start") + F.col("w_from")).alias("pos"), "rev",
        cigars.clipped(F.col("cigar"), F.col("q_start"), F.col("len") - F.col("q_end")).alias("cigar"), "mapq",
        records.tags(F.col("nm"), F.col("md"), F.col("score"), F.col("sub")).alias("tags"), "proper", F.lit("").alias("sa"),
    )
    named = reads.select("read_id", "seg", F.col("read_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("seq"), F.lit(None).cast("string").alias("qual"))
    return records.pair_records(named, lines)
