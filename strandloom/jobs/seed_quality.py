"""Quality of exact matches by a short local alignment of what surrounds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import base_codes
from strandloom.jobs.mapping import BROADCAST_ROWS, few, lengths, windows
from strandloom.operators.align import Scoring, _turned, local_scores
from strandloom.shared import Workspace

#: Bases looked at on either side, length from which a match needs no look, and the coefficients of the
#: least score: of a chain's weight, of the logarithm of the read's length, and of the length up to which reads are short.
FLANK, LONG, WEIGHT_PART, LOG_PART, SHORT_PART = 50, 200, 1.1, 5.5, 0.05


def score_seeds(
    matches: DataFrame, queries: DataFrame, q_key: str, references: DataFrame, r_key: str, scoring: Scoring = Scoring(1, 4, 6, 1),  # noqa: B008
    min_weight: int = 0, alphabet: str = "text", short_part: float = SHORT_PART,
) -> DataFrame:
    """Add seed_score and good to exact matches (read_id, rid, rev, qbeg, qend, rbeg), counted on the match's strand.

    A match shorter than LONG, with flanks of FLANK bases or up to an end, scores as the best local alignment of the two
    windows; others score as their own bases.  It is good if that reaches the least score of its read, which grows with
    ``min_weight`` or the logarithm of the read's length.  Reads too short for that (it would exceed ``short_part`` of
    them) have good matches only.  Windows of the references are cut where these are read.
    """
    size = F.col("qend") - F.col("qbeg")
    least = F.lit(WEIGHT_PART * min_weight) if min_weight else F.lit(LOG_PART) * F.log(F.col("len").cast("double"))
    sized = matches.join(lengths(queries, q_key).withColumnRenamed("rid", "read_id"), "read_id").withColumns(
        {
            "s_from": F.greatest(F.col("qbeg") - FLANK, F.lit(0)),
            "s_to": F.least(F.col("qend") + FLANK, F.col("len")),
            "w_from": F.greatest(F.col("rbeg") - FLANK, F.lit(0)),
            "s_least": F.floor(least * scoring.match + 0.499).cast("int"),
            "s_short": least > F.col("len") * short_part,
        }
    ).withColumn("w_len", F.col("rbeg") + size + FLANK - F.col("w_from"))
    sized = Workspace(references.sparkSession).stash(sized, "matches")  # read twice
    cut = windows(sized, references, r_key, few(sized, BROADCAST_ROWS))
    rows = cut.join(queries.select(F.col(q_key).alias("read_id"), F.col("text").alias("q_text")), "read_id")
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}
    key = ("read_id", "rid", "rev", "qbeg", "qend", "rbeg")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, good = [], []
            asked: dict[tuple[bytes, bytes], list[int]] = {}  # rows by their two windows, which copies of a reference share
            codes: dict[str, np.ndarray] = {}
            columns = [c.to_pylist() for c in batch.columns[2:]]
            for row, (rev, begin, stop, _, low, high, least, short, q, t) in enumerate(zip(*columns, strict=True)):
                scores.append((stop - begin) * scoring.match)
                good.append(True)
                if stop - begin < LONG and high - low < LONG and len(t) < LONG:
                    if q not in codes:
                        codes[q] = base_codes(q, alphabet)
                    x = codes[q]
                    asked.setdefault(((_turned(x) if rev else x)[low:high].tobytes(), base_codes(t, alphabet).tobytes()), []).append(row)
            found = local_scores([tuple(np.frombuffer(x, np.uint8) for x in pair) for pair in asked], scoring)
            for own, rows_of in zip(found.tolist(), asked.values(), strict=True):
                for row in rows_of:
                    scores[row], good[row] = own, columns[7][row] or own >= columns[6][row]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(scores, pa.int32()), pa.array(good, pa.bool_())], [*key, "seed_score", "good"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", seed_score int, good boolean"
    return rows.select(*key, "s_from", "s_to", "s_least", "s_short", "q_text", "t").mapInArrow(emit, schema)
