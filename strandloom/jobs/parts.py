"""Mapping on an index of several parts: every part by itself, then all its hits ranked together."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.jobs.mapping import map_sketches, repeat_lengths, sketch_both
from strandloom.jobs.options import Options
from strandloom.operators import hits
from strandloom.shared import Workspace


def map_part(queries: DataFrame, q_key: str, part: DataFrame, r_key: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(hits, repeats) of one part of the references: ``map_reads`` and the lengths that its frequent seeds cover."""
    s = sketch_both(queries, q_key, part, r_key, options)
    return map_sketches(s, options), repeat_lengths(s)


def merge_hits(parts: Iterable[DataFrame], repeats: Iterable[DataFrame], options: Options = Options()) -> DataFrame:  # noqa: B008
    """All parts' hits with their places, parents, secondaries and mapq as if they were of one part.

    A read's hits of all parts are ranked together; its frequent seeds cover as much as in the part where most is.
    References keep their ids, which no two parts share.
    """
    every = _together(parts)
    covered = _together(repeats).groupBy("read_id").agg(F.max("rep_len").alias("rep_len"))
    chosen = hits.select_secondary(hits.set_parents(every, options.mask_level), options.best_n, options.pri_ratio, 2 * options.k)
    return hits.mapq_long(chosen, covered, options.min_score).drop("rep_len")


def _together(tables: Iterable[DataFrame]) -> DataFrame:
    first, *others = tables
    for other in others:
        first = first.unionByName(other)
    return first


def map_by_parts(
    queries: DataFrame, q_key: str, references: DataFrame, r_key: str, parts: int, options: Options = Options()  # noqa: B008
) -> DataFrame:
    """``mapping.map_primary`` with the references dealt to ``parts`` parts by their key, one index in use at a time.

    Each part's hits are stored before the next part's index is made.  The hits are those of one part: all minimizers
    are looked up, so a hit depends on its read and its reference alone; null keys are in no part.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    work, found, covered = Workspace(references.sparkSession), [], []
    for k in range(parts):
        part = references.where(F.pmod(F.xxhash64(F.col(r_key)), F.lit(parts)) == k)
        here, repeats = map_part(queries, q_key, part, r_key, options)
        found.append(work.stash(here, f"hits-{k}"))
        covered.append(work.stash(repeats, f"repeats-{k}"))
    return merge_hits(found, covered, options)
