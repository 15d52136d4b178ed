"""Mapping with bounded seeds: frequent ones of the query and of the index are dropped, some of a run of them kept, and
reads that are left without a chain are seeded once more with a higher bound."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.jobs.mapping import Sketches, sketch_both
from strandloom.jobs.options import Options
from strandloom.operators import chains, index, seeds
from strandloom.shared import Workspace


def select_seeds(s: Sketches, options: Options = Options(), most: int | None = None) -> DataFrame:  # noqa: B008
    """The queries' minimizers that the index has, with occ and flt: whether one is left out.

    Left out without a row are those that a query itself has very often.  Beyond ``most`` occurrences (the index's
    threshold, if None) a seed is left out but for the rarest few of each run, none above options.max_max_occ.  So a
    seed meets at most the larger of both bounds of the references' places.
    """
    limit: Column = F.col("s_limit")
    bound = s.mid_occ.select(F.col("mid_occ").alias("s_limit")) if most is None else s.mid_occ.select(F.lit(most).cast("long").alias("s_limit"))
    limited = s.queries.join(F.broadcast(bound))  # one row
    own = seeds.drop_frequent_in_query(limited, limit, options.query_fraction)
    met = s.references.join(own.select("hash").distinct(), "hash", "left_semi")
    seen = seeds.with_occurrences(own, index.occurrences(met))
    return seeds.rescue_frequent(seen, s.lengths, limit, options.max_max_occ, options.occ_dist).drop("s_limit")


def _chains(selected: DataFrame, s: Sketches, options: Options, again: bool) -> DataFrame:
    kept = selected.where(~F.col("flt")).select("rid", "pos", "strand", "hash", "span")
    anchors = seeds.skip_pairs(seeds.anchors(kept, s.references, s.lengths, broadcast=s.few), options.no_diagonal, options.no_dual)
    if again:
        return chains.chain_again(anchors, s.lengths, options.band, options.band_long, options.max_gap, options.min_cnt, options.min_score)
    return chains.chain_dp(anchors, options.band, options.min_cnt, options.min_score)


def map_seeded(queries: DataFrame, q_key: str, references: DataFrame, r_key: str, options: Options = Options(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``mapping.map_reads`` by selected seeds, in two rounds, with ``rep_len``: how much the left-out seeds cover.

    Where options.max_occ is above the index's threshold, reads that have left-out seeds and no chain are seeded and
    chained again with that bound.  Selected seeds and the first round's chains are stored; a read's hot k-mer, or a
    k-mer that very many references share, has no more places than the bounds let it.
    """
    work = Workspace(references.sparkSession)
    s = sketch_both(queries, q_key, references, r_key, options, stored)
    selected = work.stash(select_seeds(s, options), "seeds")
    found = work.stash(_chains(selected, s, options, True), "chains")
    out, second = selected.where("flt"), None
    if options.max_occ:
        without = out.select("rid").distinct().join(found.select(F.col("read_id").alias("rid")), "rid", "left_anti")
        above = F.broadcast(s.mid_occ.where(F.col("mid_occ") < options.max_occ).select(F.lit(True).alias("s_above")))
        without = work.stash(without.join(above).drop("s_above"), "without")
        later = replace(s, queries=s.queries.join(without, "rid", "left_semi"))
        second = work.stash(select_seeds(later, options, options.max_occ), "seeds-again")
        found = found.unionByName(_chains(second, s, options, False))
        out = out.join(without, "rid", "left_anti").unionByName(second.where("flt"))
    spans = out.select("rid", (F.col("pos") + 1 - F.col("span")).alias("st"), (F.col("pos") + 1).alias("en"))
    repeats = seeds.covered_length(spans, "st", "en").select(F.col("rid").alias("read_id"), F.col("covered").alias("rep_len"))
    regions = chains.regions(found, s.lengths, options.min_cnt, options.min_score)
    return regions.join(repeats, "read_id", "left").fillna(0, ["rep_len"])
