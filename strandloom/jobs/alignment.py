"""The whole mapping job: seeds, chains, primaries, repaired and split alignments with inversions, and qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.jobs.mapping import BROADCAST_ROWS, all_anchors, few, lengths, repeat_lengths, sketch_both, windows
from strandloom.jobs.options import Options
from strandloom.operators import align, chains, hits, regions, scoring, seeds
from strandloom.shared import Workspace


def chained_hits(queries: DataFrame, q_key: str, references: DataFrame, r_key: str, options: Options = Options(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Each query's primaries and the secondaries near them, with mapq and their chains' anchors as ``points``."""
    s = sketch_both(queries, q_key, references, r_key, options, stored)
    anchors = seeds.skip_pairs(all_anchors(s), options.no_diagonal, options.no_dual)
    found = chains.chain_again(anchors, s.lengths, options.band, options.band_long, options.max_gap, options.min_cnt, options.min_score, points=True)
    placed = chains.regions(found, s.lengths, options.min_cnt, options.min_score, keep=("points",))
    parented = hits.set_parents(placed, options.mask_level)
    chosen = hits.select_secondary(parented, options.best_n, options.pri_ratio, 2 * options.k)
    return hits.mapq_long(chosen, repeat_lengths(s), options.min_score).drop("rep_len")


def align_reads(queries: DataFrame, q_key: str, references: DataFrame, r_key: str, options: Options = Options(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Aligned regions of every query, a row for each part of a hit and each inversion between two parts.

    (read_id, place, parent, piece, rid, rev, inv, split, qs, qe, rs, re, score, cigar, nm, md, matches, columns, n_ambi,
    dp_max, anchors, cs, mapq).  Places on the query count on its own strand, the CIGAR runs along the reference.  Gaps are as far left as
    they go.  An inversion's strand is the other one, its quality the lesser of its neighbours'.  Queries without chains,
    null and short ones have no rows.  Chosen hits are stored once; windows of the references, each about as long as its
    query allows, are cut where these are read, and then dealt with their query.
    """
    spark = references.sparkSession
    chosen = Workspace(spark).stash(chained_hits(queries, q_key, references, r_key, options, stored), "chosen")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    sized = chosen.join(lengths(queries, q_key).withColumnRenamed("rid", "read_id"), "read_id")

    def reach(rest):
        """Bases of the reference that so many of the query may extend over."""
        held = F.least(rest, F.lit(options.max_gap))
        return held + F.least(F.greatest(((held * options.match - options.gap_open) / options.gap_extend).cast("int"), F.lit(0)), F.lit(options.max_gap))

    begin = F.greatest(F.lit(0), first["t"] - options.k - reach(first["q"]))
    spans = sized.select("read_id", "place", "rid", begin.alias("w_from"), (last["t"] + 1 + reach(F.col("len") - last["q"]) - begin).alias("w_len"))
    cut = windows(spans, references, r_key, few(queries, BROADCAST_ROWS // (options.best_n + 1)))
    q = queries.select(F.col(q_key).alias("read_id"), F.col("text").alias("q"))
    points = F.transform("points", lambda p: F.struct(p["q"].alias("q"), (p["t"] - F.col("w_from")).alias("t"), p["span"].alias("span")))
    own = ("read_id", "place", "parent", "rid", "strand", "w_from", "len", "mapq")
    rows = cut.drop("rid", "w_len").join(sized, ["read_id", "place"]).join(q, "read_id").withColumns({"points": points, "strand": F.col("rev")})
    scored = align.Scoring(options.match, options.mismatch, options.gap_open, options.gap_extend, zdrop=options.zdrop)
    limits = regions.Limits(options.band, options.max_gap, options.min_cnt, options.min_score, options.min_dp_score, options.zdrop_inv)
    found = regions.aligned_regions(rows, own, options.k, scored, limits, options.alphabet)
    turned = F.col("strand") != F.col("inv")
    placed = found.select(
        "read_id", "place", "parent", "piece", "rid", turned.alias("rev"), "inv", "split",
        F.when(turned, F.col("len") - F.col("q_end")).otherwise(F.col("q_start")).alias("qs"),
        F.when(turned, F.col("len") - F.col("q_start")).otherwise(F.col("q_end")).alias("qe"),
        (F.col("t_start") + F.col("w_from")).alias("rs"), (F.col("t_end") + F.col("w_from")).alias("re"),
        "score", "cigar", "nm", "md", "matches", "columns", "n_ambi", "dp_max", "anchors", "cs", "mapq",
    )
    return scoring.inversion_quality(placed)
