"""Base composition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMBIGUOUS, base_codes


def composition(df: DataFrame, text: str = "text", alphabet: str = "text") -> DataFrame:
    """(first, second, n): how often each unambiguous base follows each other, over all whole texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(16, np.int64)
        for batch in batches:
            for value in batch.column(0):
                codes = base_codes(value.as_py() or "", alphabet).astype(np.int64)
                a, b = codes[:-1], codes[1:]
                good = (a < AMBIGUOUS) & (b < AMBIGUOUS)
                total += np.bincount(4 * a[good] + b[good], minlength=16)
        place = np.arange(16, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place // 4), pa.array(place % 4), pa.array(total)], ["first", "second", "n"])

    counted = df.select(text).mapInArrow(emit, "first int, second int, n long")
    return counted.groupBy("first", "second").agg(F.sum("n").alias("n")).where("n > 0")
