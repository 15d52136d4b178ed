"""Seeds: minimizers looked up in the index, filtered by frequency, turned into anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the frequency filters.
QUERY_FRACTION, RESCUE_DISTANCE, RESCUE_MOST, MAX_MAX_OCC = 0.01, 500, 128, 4095


def tandem_flags(minimizers: DataFrame) -> DataFrame:
    """Add is_tandem: the minimizer before or after it in its sequence has the same hash."""
    near = Window.partitionBy("rid").orderBy("pos")
    same = lambda c: F.coalesce(c == F.col("hash"), F.lit(False))
    return minimizers.withColumn("is_tandem", same(F.lag("hash").over(near)) | same(F.lead("hash").over(near)))


def drop_frequent_in_query(queries: DataFrame, mid_occ: int, fraction: float = QUERY_FRACTION) -> DataFrame:
    """Without minimizers that a query has more than ``mid_occ`` times and in more than ``fraction`` of its own."""
    own, whole = Window.partitionBy("rid", "hash"), Window.partitionBy("rid")
    counted = queries.withColumn("q_n", F.count("*").over(own)).withColumn("q_all", F.count("*").over(whole))
    often = (F.col("q_n") > mid_occ) & (F.col("q_n") > F.col("q_all") * fraction)
    return counted.where(~often).drop("q_n", "q_all")


def with_occurrences(queries: DataFrame, occ: DataFrame) -> DataFrame:
    """Query minimizers that the index has, with their occurrence."""
    return queries.join(occ, "hash")


def rescue_frequent(
    seeds: DataFrame, lengths: DataFrame, max_occ: int, max_max_occ: int = MAX_MAX_OCC, distance: int = RESCUE_DISTANCE
) -> DataFrame:
    """Add flt: whether a seed is dropped for being frequent.

    In each run of frequent seeds, between the seeds before and after it, the rarest few stay: as many as the
    gap has ``distance``s, at most RESCUE_MOST; none above ``max_max_occ``.  A query with one seed keeps it.
    ``seeds`` has (rid, pos, occ), ``lengths`` (rid, len).
    """
    order = Window.partitionBy("rid").orderBy("pos", "hash")
    high = F.col("occ") > max_occ
    ran = (
        seeds.join(lengths, "rid")
        .withColumn("n_seeds", F.count("*").over(Window.partitionBy("rid")))
        .withColumn("run", F.sum(F.when(high, 0).otherwise(1)).over(order))
    )
    streak = Window.partitionBy("rid", "run", "high")
    marked = ran.withColumn("high", high)
    # A run's rows lie between the last seed that is not frequent (ps) and the next one (pe).
    before = F.max(F.when(~F.col("high"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(~F.col("high"), F.col("pos"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    spanned = marked.withColumn("ps", F.coalesce(before, F.lit(0))).withColumn("pe", F.coalesce(after, F.col("len")))
    room = F.least(F.floor((F.col("pe") - F.col("ps")) / F.lit(distance) + F.lit(0.499)), F.lit(RESCUE_MOST))
    rank = F.row_number().over(streak.orderBy("occ", "pos", "hash"))
    drop = F.col("high") & ((rank > room) | (F.col("occ") > max_max_occ))
    return spanned.withColumn("flt", (F.col("n_seeds") >= 2) & drop).drop("n_seeds", "run", "high", "ps", "pe", "len")


def covered_length(spans: DataFrame, start: str, end: str, key: str = "rid") -> DataFrame:
    """(key, covered): length of the union of each key's half-open intervals."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return spans.withColumn("i_new", fresh).groupBy(key).agg(F.sum("i_new").cast("long").alias("covered"))


def anchors(queries: DataFrame, index: DataFrame, lengths: DataFrame, broadcast: bool = False) -> DataFrame:
    """(read_id, rid, rev, rpos, qpos, span): every place in the index of every query minimizer.

    An equi-join on the hash; on the reverse strand the query position is counted from the query's end.
    ``lengths`` (rid, len) holds the queries.  Hashes frequent on both sides are expected to be filtered before;
    ``broadcast`` sends the queries' to the index.
    """
    q = queries.join(lengths, "rid").select(
        F.col("rid").alias("read_id"), F.col("pos").alias("q_pos"), F.col("strand").alias("q_strand"), "span", "hash", "len"
    )
    hits = (F.broadcast(q) if broadcast else q).join(index.select("rid", F.col("pos").alias("rpos"), F.col("strand").alias("r_strand"), "hash"), "hash")
    rev = F.col("q_strand") != F.col("r_strand")
    turned = F.col("len") - (F.col("q_pos") + 1 - F.col("span")) - 1
    return hits.select("read_id", "rid", rev.alias("rev"), "rpos", F.when(rev, turned).otherwise(F.col("q_pos")).cast("int").alias("qpos"), "span")


def skip_pairs(found: DataFrame, no_diagonal: bool = False, no_dual: bool = False, forward: bool = True, reverse: bool = True) -> DataFrame:
    """Anchors without those of a sequence with itself at one place, of the second order of a pair, or of a strand."""
    keep: Column = F.lit(True)
    if no_diagonal:
        keep = keep & ~((F.col("read_id") == F.col("rid")) & ~F.col("rev") & (F.col("rpos") == F.col("qpos")))
    if no_dual:
        keep = keep & (F.col("read_id") <= F.col("rid"))
    if not forward:
        keep = keep & F.col("rev")
    if not reverse:
        keep = keep & ~F.col("rev")
    return found.where(keep)


def sample_occurrences(found: DataFrame, max_occ: int, key: tuple[str, ...] = ("read_id", "qpos")) -> DataFrame:
    """At most ``max_occ`` places of each query seed, in equal steps over its places in order."""
    order = Window.partitionBy(*key).orderBy("rid", "rpos", "rev")
    total = F.count("*").over(Window.partitionBy(*key))
    placed = found.withColumn("o_i", F.row_number().over(order) - 1).withColumn("o_step", F.floor(total / F.lit(max_occ)))
    step = F.greatest(F.col("o_step"), F.lit(1))
    return placed.where((F.col("o_i") % step == 0) & (F.floor(F.col("o_i") / step) < max_occ)).drop("o_i", "o_step")
