"""Minimizer index: postings by hash, its statistics and the threshold for frequent minimizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The defaults that decide which minimizers are frequent.
MID_OCC_FRACTION, MIN_MID_OCC, MAX_MID_OCC = 2e-4, 10, 1_000_000


def occurrences(minimizers: DataFrame) -> DataFrame:
    """(hash, occ): partial counts are summed before the shuffle."""
    return minimizers.groupBy("hash").agg(F.count("*").cast("long").alias("occ"))


def postings(minimizers: DataFrame) -> DataFrame:
    """(hash, occ, postings): places of each hash in order.  A hash's places meet in one row, so use it where
    frequent hashes have been left out; ``occurrences`` and the seed join need no such row."""
    place = F.struct("rid", "pos", "strand")
    return minimizers.groupBy("hash").agg(
        F.count("*").cast("long").alias("occ"), F.sort_array(F.collect_list(place)).alias("postings")
    )


def statistics(minimizers: DataFrame, k: int) -> DataFrame:
    """One row: distinct hashes, those met once, minimizers, mean occurrence and longest span."""
    return occurrences(minimizers).agg(
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum((F.col("occ") == 1).cast("long")), F.lit(0)).alias("n_single"),
        F.coalesce(F.sum("occ"), F.lit(0)).alias("n_minimizers"),
        (F.sum("occ") / F.count("*")).alias("mean_occ"),
        F.lit(k).alias("k"),
    )


def frequency_threshold(
    occ: DataFrame, fraction: float = MID_OCC_FRACTION, low: int = MIN_MID_OCC, high: int = MAX_MID_OCC
) -> DataFrame:
    """One row (mid_occ): the count at rank (1 - fraction) * n of the distinct hashes, plus one, within bounds.

    Ranks come from the histogram of counts, which has a row for each different count and not for each hash.
    An empty index has the lower bound.
    """
    return threshold_of(occ.groupBy("occ").agg(F.count("*").alias("n")), fraction, low, high)


def threshold_of(histogram: DataFrame, fraction: float = MID_OCC_FRACTION, low: int = MIN_MID_OCC, high: int = MAX_MID_OCC) -> DataFrame:
    """``frequency_threshold`` from the histogram (occ, n) of the counts."""
    upto = Window.orderBy("occ").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.select(
        "occ", F.sum("n").over(upto).alias("upto"), F.floor((1 - F.lit(fraction)) * F.sum("n").over(everything)).alias("rank")
    )
    found = ranked.where(F.col("upto") > F.col("rank")).agg(F.min("occ").alias("at"))
    return found.select(
        F.least(F.greatest(F.coalesce(F.col("at") + 1, F.lit(low)), F.lit(low)), F.lit(high)).cast("long").alias("mid_occ")
    )


def write_index(minimizers: DataFrame, table: str, buckets: int) -> None:
    """Save the index bucketed and sorted by hash, so that later seed joins need not shuffle it."""
    minimizers.write.mode("overwrite").format("parquet").bucketBy(buckets, "hash").sortBy("hash").saveAsTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def mark_alternative(contigs: DataFrame, names: DataFrame) -> DataFrame:
    """Contigs (name, ...) with is_alt: whether the list (name) has them."""
    listed = names.select("name").distinct().withColumn("a_listed", F.lit(True))
    return contigs.join(listed, "name", "left").withColumn("is_alt", F.coalesce("a_listed", F.lit(False))).drop("a_listed")


def duplicate_names(contigs: DataFrame) -> DataFrame:
    """(name, n) of names that more than one contig has; a name must lead to one contig."""
    return contigs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
