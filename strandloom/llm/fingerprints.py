"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every shingle is hashed once; the hash's high bits name a bin, and a bin keeps its least hash.  An empty
bin copies the bin that a universal hash of (bin, attempt) names, the attempt rising until that bin was
filled (optimal densification).  Of each bin only the low BITS bits are stored; ``likeness`` subtracts the
rate at which equal low bits occur by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import mix64, shingle_sets

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4


def _fill_empty(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification of one row; at least one bin is filled."""
    open_bins, attempt = np.flatnonzero(~filled), 0
    while len(open_bins):
        attempt += 1
        probe = mix64(open_bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))
        source = (probe >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        hit = filled[source]
        values[open_bins[hit]] = values[source[hit]]
        open_bins = open_bins[~hit]
    return values


def sketch(shingles: np.ndarray) -> np.ndarray | None:
    """Low bits of the densified bins of ascending distinct shingle hashes; None for an empty set."""
    if not len(shingles):
        return None
    bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    least = np.ones(len(bins), bool)
    least[1:] = bins[1:] != bins[:-1]
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[least]] = shingles[least]
    filled[bins[least]] = True
    return (_fill_empty(values, filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(bits: np.ndarray | None) -> str:
    """Hex of the packed low bits, two bins a byte; the empty set is the empty string."""
    return "" if bits is None else (bits[0::2] << BITS | bits[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, corrected for equal low bits by chance and held within 0 and 1.

    Two empty sets are alike (1.0); an empty and a non-empty one are not (0.0).
    """
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))))


def fingerprints(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """Add the packed fingerprint of each whole text (null text: the empty set's, "")."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(sketch(s)) for s in shingle_sets(pa.array(texts, pa.string(), from_pandas=True))])

    return df.withColumn(output, of(F.col(text)))


def _id_ranges(df: DataFrame, key: str, count: int) -> list[int]:
    """Ascending approximate quantiles of the key: bounds of at most ``count`` ranges."""
    if count < 2:
        return []
    at = [k / count for k in range(1, count)]
    found = df.select(F.percentile_approx(key, at).alias("q")).first()
    return sorted(set(found.q or []))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the key's range, the largest keys in range 0 and null keys in the last."""

    @F.pandas_udf("int")
    def at(keys: pd.Series) -> pd.Series:
        empty = keys.isna().to_numpy()
        found = len(bounds) - np.searchsorted(bounds, keys.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(empty, len(bounds) + 1, found).astype(np.int32))

    return at(key)


def with_next_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, made with the text of the next row by descending key.

    Rows go to contiguous key ranges in one shuffle, each range sorted and streamed; the first row of every
    range is also sent to the range before it (that of range 0 to the last), so no range needs another.
    Ties of the key go by text; null keys come last; null texts are empty; with one row it is its own next.
    The columns are those of ``op1``'s contract; other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _id_ranges(docs, "doc_id", 4 * partitions)
    ranged = docs.withColumn("part", _range_of(F.col("doc_id"), bounds))
    # One row for each range, at most 4 for each shuffle partition: their heads, in order.
    heads = [
        (r.part, r.head)
        for r in ranged.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    ]
    goes_to = {part: heads[k - 1][0] for k, (part, _) in enumerate(heads)}
    table = spark.createDataFrame(
        [(part, head, goes_to[part]) for part, head in heads], "h_part int, head long, before int"
    )
    ghosts = F.broadcast(table)  # as many rows as ranges
    both = ranged.join(
        ghosts, (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("head")), "left"
    ).select(
        "doc_id",
        "text",
        F.explode(
            F.when(
                F.col("before").isNotNull(),
                F.array(
                    F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")),
                    F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost")),
                ),
            ).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))))
        ).alias("at"),
    )
    dealt = (
        both.select("doc_id", "text", "at.part", "at.ghost")
        .repartitionById(partitions, F.col("part") % partitions)  # as many ranges to each task
        .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    )
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(_stream_pairs, schema)


#: Rows fingerprinted together by the streaming pass.
_STREAM_ROWS = 256


def _stream_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row, whose successor is not yet known
    for batch in batches:
        for at in range(0, batch.num_rows, _STREAM_ROWS):
            part = batch.slice(at, _STREAM_ROWS)
            column = part.column(part.schema.get_field_index("text"))
            rows = list(
                zip(
                    part.column("doc_id").to_pylist(),
                    column.to_pylist(),
                    part.column("ghost").to_pylist(),
                    map(sketch, shingle_sets(column)),
                    strict=True,
                )
            )
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
            if not pairs:
                continue
            edited = []
            for (_, own, _, _), (_, following, _, _) in pairs:
                cut = len(own) // 2
                edited.append(own[: len(own) - cut] + following[:cut])
            marks = list(map(sketch, shingle_sets(pa.array(edited, pa.string()))))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": [pack(a[3]) for a, _ in pairs],
                    "edited_fingerprint": list(map(pack, marks)),
                    "near_edited": pa.array([likeness(a[3], m) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                }
            )
