"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed with numpy on the text buffer.  The trees are grown on histograms of
at most BINS bins a feature, on a bounded sample of the labelled rows, and flattened into arrays in heap order,
so that a batch of documents walks all trees in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import text_chunks, word_hashes, word_spans

#: Most labelled rows that a fit reads: those of least hashed key.
MAX_TRAIN_ROWS = 20_000
BINS = 64
DEPTH = 4
ROUNDS = 80
RATE = 0.15
L2 = 1.0
KEEP_SCORE = 0.3

_BYTE_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "line": (10,),
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*@~^<>{}[]\\/=_+`",
    "foreign": range(128, 256),
}
FEATURES = (
    "log_bytes", "log_words", *[f"share_{k}" for k in _BYTE_CLASSES], "word_mean", "word_max", "short_words",
    "long_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_lines", "words_a_line", "stops_a_word",
)


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have all zeros."""
    parts = [_chunk_statistics(data, offsets) for _, data, offsets in text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _chunk_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets).astype(np.float64)
    out = {"log_bytes": np.log1p(n)}
    counts = {}
    for name, members in _BYTE_CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        counts[name] = np.diff(total[offsets]).astype(np.float64)
        out[f"share_{name}"] = counts[name] / np.maximum(n, 1)
    starts, ends, first = word_spans(data, offsets)
    hashes, lengths = word_hashes(data, starts, ends), ends - starts
    words = np.diff(first).astype(np.float64)
    some = np.maximum(words, 1)
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[first]) / some
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][words > 0]] = False
    out |= {
        "log_words": np.log1p(words),
        "word_mean": per(lengths),
        "short_words": per(lengths <= 3),
        "long_words": per(lengths >= 14),
        "same_as_last": per(same),
        "stops_a_word": counts["stop"] / some,
        "words_a_line": words / (counts["line"] + 1),
    }
    rows = {k: np.zeros(len(n)) for k in ("word_max", "distinct_words", "top_word", "distinct_pairs", "distinct_lines")}
    raw = data.tobytes()
    for k in np.flatnonzero(words):
        own = hashes[first[k] : first[k + 1]]
        _, times = np.unique(own, return_counts=True)
        rows["word_max"][k] = lengths[first[k] : first[k + 1]].max()
        rows["distinct_words"][k] = len(times) / len(own)
        rows["top_word"][k] = times.max() / len(own)
        pairs = own[1:] * np.uint64(3) + own[:-1]
        rows["distinct_pairs"][k] = len(np.unique(pairs)) / max(1, len(pairs))
        lines = raw[offsets[k] : offsets[k + 1]].split(b"\n")
        rows["distinct_lines"][k] = len(set(lines)) / len(lines)
    out |= rows
    return np.stack([out[k] for k in FEATURES], axis=1).astype(np.float32)


@dataclass
class Forest:
    """Flattened trees: node k of a tree has the children 2k + 1 and 2k + 2; leaves are the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # trees x inner nodes; a row goes right if its value is above
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, bound, value in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Forest:
    """Logistic boosting on feature histograms; without both labels the score is constant (0.5 without rows)."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(mean, 0.01, 0.99) / (1 - np.clip(mean, 0.01, 0.99))))
    if len(np.unique(y)) < 2:
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    forest = ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(binned, edges, p - y, p * (1 - p), depth)
        raw += tree[3]
        for whole, part in zip(forest, tree, strict=False):
            whole.append(part)
    return Forest(base, *map(np.array, forest))


def _grow(binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray, depth: int):
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(binned), np.int64)
    for level in range(depth):
        width, low = 1 << level, (1 << level) - 1
        best = np.full(width, 1e-6)
        cut = np.zeros(width, np.int64)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            place = (node - low) * BINS + binned[:, f]
            g = np.bincount(place, grad, width * BINS).reshape(width, BINS).cumsum(1)
            h = np.bincount(place, hess, width * BINS).reshape(width, BINS).cumsum(1)
            all_g, all_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain[(h < 1) | (all_h - h < 1)] = 0
            at = gain[:, : len(e)].argmax(1)
            found = gain[np.arange(width), at]
            better = found > best
            best[better], cut[better] = found[better], at[better]
            feature[low : low + width][better] = f
            bound[low : low + width][better] = e[at[better]]
        here = node - low
        split = np.isfinite(bound[node])
        node = 2 * node + 1 + (split & (binned[np.arange(len(node)), feature[node]] > cut[here]))
    leaf = node - inner
    g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
    value = -RATE * g / (h + L2)
    return feature, bound, value, value[leaf]


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds`` (null keys: 0)."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0)).cast("int")


def train(documents: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_TRAIN_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled keys that are not held out; unlabelled rows teach nothing.

    Of several labels of one key the least counts.  The sampled keys, bounded by ``max_rows``, are broadcast.
    """
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "quality", "doc_id")
    # One row for each key, of several the least, so that repeated keys bring no more than ``max_rows`` to the driver.
    table = rows.mapInArrow(_train_rows, "x binary, y int, k string").groupBy("k").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES))
    y = np.array(table.column("y").to_pylist(), np.float64)
    order = np.lexsort([*x.T, y])  # the rows arrive in any order; the fit does not depend on it
    return fit(x[order], y[order])


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(0))
        yield pa.RecordBatch.from_pydict({"x": [row.tobytes() for row in x], "y": batch.column(1).cast(pa.int32()), "k": batch.column(2).cast(pa.string())})


def score_quality(df: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): every whole text is scored where it is read; null text scores as empty text."""
    kind = df.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forest.score(statistics(batch.column(1))), pa.float64())], [key, "score"]
            )

    return df.select(key, text).mapInArrow(score, f"`{key}` {kind}, score double")
