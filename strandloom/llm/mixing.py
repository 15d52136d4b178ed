"""Mixing sources to target weights.

Words are summed for each source; the total is shared by weight, a source's target stopping at MAX_REPEATS
times its size and the excess going to the others by weight.  A source's repetition rate is target / size;
each document is taken floor(rate) times, and once more where a uniform number hashed from the seed and its
key is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Fixed weights, repeating over the sources in code-point order, null last.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """Repeatable number in [0, 1) from the seed and the key as text (null: empty)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row for each source.

    The windows run over the sources' sums alone, a row for each source, in one task: sources are names of collections,
    not of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    weighted = sizes.select(
        "source",
        "source_size",
        F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"),
    ).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = weighted.select(
        "source",
        "source_size",
        "w",
        "cap",
        F.row_number().over(by_ratio).alias("place"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_size"),
        F.sum("w").over(on).alias("left_weight"),
    )
    # The first place whose share fits under its cap, and all after it, share what is left by weight.
    fits = F.col("w") * F.col("left_size") <= F.col("cap") * F.col("left_weight")
    opened = placed.withColumn("free", F.min(F.when(fits, F.col("place"))).over(everything))
    at_free = F.col("place") == F.col("free")
    shared = opened.withColumn("size_f", F.max(F.when(at_free, F.col("left_size"))).over(everything)).withColumn(
        "weight_f", F.max(F.when(at_free, F.col("left_weight"))).over(everything)
    )
    share = (F.col("w") * F.col("size_f")).cast("double") / F.col("weight_f").cast("double")
    return shared.select(
        "source",
        "source_size",
        F.when(F.col("place") >= F.col("free"), share).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def _plan(df: DataFrame, keep: list[str], key: str, text: str, source: str, weights: tuple[int, ...], max_repeats: int, seed: str) -> DataFrame:
    """``own``, a struct of ``keep``, and size, source_size, target and copies of every row."""
    size, own = word_count(F.col(f"`{text}`")), F.struct(*[F.col(f"`{c}`") for c in keep])
    sized = df.select(own.alias("own"), F.col(f"`{source}`").alias("of"), uniform(F.col(f"`{key}`"), seed).alias("u"), size.alias("size"))
    sizes = (
        df.select(F.col(f"`{source}`").alias("source"), size.alias("size"))
        .groupBy("source")
        .agg(F.sum("size").alias("source_size"))
    )
    joined = sized.join(source_targets(sizes, weights, max_repeats), F.col("of").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (F.col("u") < rate - whole).cast("long")).cast("long")
    return joined.select("own", "size", "source_size", "target", copies.alias("copies"))


def plan_mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Per row: the key, size, source_size, target and copies.

    Null text has size 0; null is a source of its own; a source without words has target 0 and no copies.
    Equal keys make equal choices.  Sizes are summed before any shuffle; the targets, one row for each
    source, are joined back without a size promise, so Spark broadcasts them only under its own threshold.
    """
    planned = _plan(df, [key], key, text, source, weights, max_repeats, seed)
    return planned.select(F.col(f"own.`{key}`").alias(key), "size", "source_size", "target", "copies")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``df``, each repeated as ``plan_mix`` says, with its own columns only."""
    planned = _plan(df, df.columns, key, text, source, weights, max_repeats, seed)
    repeated = planned.where("copies > 0").select("own", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("own.*")
