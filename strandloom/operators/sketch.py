"""(w, k)-minimizers: of every w consecutive k-mers those of least hash.

A minimizer is (rid, pos, strand, hash, span): pos is the 0-based place of the k-mer's last base, strand 1 when
the reverse complement is the smaller form.  Ties within a window all count, a k-mer that equals its reverse
complement is skipped, ambiguous bases end a run, and a run of fewer than w k-mers still gives its least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMBIGUOUS, base_codes, code_array, hash_codes, hash_column, kmer_codes

K, W = 15, 10
SCHEMA = "pos int, strand int, hash long, span int"


#: Characters of the texts that are sketched together.
SLICE_CHARS = 1 << 19


def _sliding(x: np.ndarray, width: int, combine: np.ufunc) -> np.ndarray:
    """``combine`` of every ``width`` neighbours, by windows of 1, 2, 4, ... of them."""
    size = 1
    while 2 * size <= width:
        x = combine(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return combine(x[:-rest], x[rest:]) if rest else x


def sketch(codes: np.ndarray, w: int = W, k: int = K, compressed: bool = False) -> tuple[np.ndarray, ...]:
    """pos, strand, hash and span arrays of the minimizers of a sequence, or of several with ambiguous bases between.

    ``compressed`` takes k-mers over the homopolymer-compressed sequence, so that spans differ.
    """
    codes = np.concatenate([np.full(1, AMBIGUOUS, np.uint8), codes])
    place = np.arange(-1, len(codes) - 1)
    if compressed:
        last = np.concatenate([codes[1:] != codes[:-1], [True]])
        codes, place = codes[last], place[last]
    bad = np.concatenate([[0], np.cumsum(codes >= AMBIGUOUS)])
    forward, back = kmer_codes(codes, k)
    n = len(forward)
    start = np.flatnonzero((bad[k : k + n] == bad[:n]) & (forward != back))
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashed = hash_codes(np.minimum(forward, back)[start], 2 * k)
    # Runs of bases lie w - 1 places apart, so that no window has k-mers of two.
    opens = np.concatenate([[True], np.diff(bad[start]) != 0])
    run = np.cumsum(opens) - 1
    at = np.arange(len(start)) + (run + 1) * (w - 1)
    first = np.flatnonzero(opens)
    nth, length = np.arange(len(start)) - first[run], np.diff(np.concatenate([first, [len(start)]]))[run]
    padded = np.full(int(at[-1]) + w, np.iinfo(np.uint64).max)
    padded[at] = hashed
    ends = np.zeros(len(padded) + w - 1, np.uint64)  # minima of whole windows, and of runs shorter than one, at their ends
    whole = (nth >= w - 1) | ((nth == length - 1) & (length < w))
    ends[at[whole]] = _sliding(padded, w, np.minimum)[at[whole] - (w - 1)]
    # A k-mer is least in some window exactly when the greatest of its windows' minima is its own hash.
    keep = np.flatnonzero(_sliding(ends, w, np.maximum)[at] == hashed)
    begin = start[keep]
    pos = place[begin + k - 1]
    return pos, (back < forward)[begin].astype(np.int64), hashed[keep], pos - place[begin - 1]


def _joined(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with an ambiguous base after each, and where each begins."""
    points = base_codes("".join(texts), alphabet)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    codes = np.full(len(points) + len(texts), AMBIGUOUS, np.uint8)
    codes[np.arange(len(points)) + np.repeat(np.arange(len(texts)), sizes)] = points
    return codes, begins


def _slices(batch: pa.RecordBatch, w: int, k: int, alphabet: str, compressed: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, pos, strand, hash, span) arrays of the minimizers of a batch (key, text), about SLICE_CHARS characters together."""
    texts = [x or "" for x in batch.column(1).to_pylist()]
    total = np.cumsum([len(t) for t in texts])
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + SLICE_CHARS, side="right")))
        codes, begins = _joined(texts[row:stop], alphabet)
        pos, strand, hashed, span = sketch(codes, w, k, compressed)
        owner = np.searchsorted(begins, pos, side="right") - 1
        yield owner + row, pos - begins[owner], strand, hashed.astype(np.int64), span
        row = stop


class Known:
    """A set of hashes: most others are told apart by their low bits, the rest by a search."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self._sorted, self._low = np.unique(hashes.astype(np.int64)), np.zeros(1 << self.BITS, bool)
        self._low[self._sorted & (len(self._low) - 1)] = True

    def where(self, hashed: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set."""
        at = np.flatnonzero(self._low[hashed & (len(self._low) - 1)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self._sorted, hashed[at]), len(self._sorted) - 1)
        return at[self._sorted[place] == hashed[at]]


def minimizers(
    df: DataFrame, key: str, text: str = "text", w: int = W, k: int = K, alphabet: str = "text", compressed: bool = False, only: Broadcast | None = None
) -> DataFrame:
    """(rid, pos, strand, hash, span) of every whole sequence; null and short ones have none.

    Sequences are sketched where they are read, about SLICE_CHARS characters together: nothing is shuffled, and only
    key and text are read.  ``only``, a broadcast array of hashes, leaves out all others before they leave the task.
    """
    kind = df.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if only is None else Known(only.value)
        for batch in batches:
            for row, pos, strand, hashed, span in _slices(batch, w, k, alphabet, compressed):
                at = slice(None) if known is None else known.where(hashed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[at])),
                        pa.array(pos[at].astype(np.int32)),
                        pa.array(strand[at].astype(np.int32)),
                        pa.array(hashed[at]),
                        pa.array(span[at].astype(np.int32)),
                    ],
                    ["rid", "pos", "strand", "hash", "span"],
                )

    return df.select(F.col(key).alias("rid"), text).mapInArrow(emit, f"rid {kind}, {SCHEMA}")


#: Hashes that a task counts together, and the logarithm of the number of ranges into which their hashes are dealt.
COUNTED, RANGE_BITS = 1 << 20, 10


def occurrence_histogram(
    df: DataFrame, key: str, text: str = "text", w: int = W, k: int = K, alphabet: str = "text", compressed: bool = False, least: int | None = None
) -> DataFrame:
    """(occ, n): how many different minimizer hashes occur ``occ`` times.

    With ``least``, hashes that occur more often have a row each, with a column ``hash`` that is null for the others.
    The histogram of ``index.occurrences`` of ``minimizers``, without a row for each.
    """

    def told(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, None]]:
        for _, _, _, hashed, _ in _slices(batch, w, k, alphabet, compressed):
            yield hashed, None

    return histogram_of(df.select(F.col(key), text), told, k, least)


def histogram_of(rows: DataFrame, told: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]], k: int, least: int | None = None) -> DataFrame:
    """``occurrence_histogram`` of the hashes that ``told`` reads from batches, with their numbers or none for one each.

    Tasks count COUNTED hashes together, so that a frequent hash is one of them, and send them as arrays, one for each
    range of hashes.
    """
    bits = 2 * k
    shift = max(0, bits - RANGE_BITS)
    word = np.uint32 if shift <= 32 else np.uint64

    def packed(held: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        hashes = np.concatenate([x for x, _ in held])
        if held[0][1] is None:
            found, n = np.unique(hashes, return_counts=True)
        else:
            order = np.argsort(hashes, kind="stable")
            found = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            found, n = found[first], np.add.reduceat(np.concatenate([x for _, x in held])[order], first)
        part = found >> shift
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = [*cut[1:].tolist(), len(found)]
        low, n = np.diff(found & ((1 << shift) - 1), prepend=0), n.astype(np.uint32)
        low[cut] = found[cut] & ((1 << shift) - 1)  # differences within a range, which are small
        low = low.astype(word)
        told_ = [[x[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)] for x in (low, n)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *(pa.array(x, pa.binary()) for x in told_)], ["part", "low", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashed, n in told(batch):
                held.append((hashed, n))
                size += len(hashed)
                if size >= COUNTED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def count(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(np.frombuffer(x, word).astype(np.int64)) for x in table.column("low").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()])
        found, place = np.unique(low, return_inverse=True)
        total = np.bincount(place, weights=n).astype(np.int64)
        often = np.zeros(len(total), bool) if least is None else total > least
        occ, times = np.unique(total[~often], return_counts=True)
        part = table.column("part")[0].as_py()
        hashes = pa.concat_arrays([pa.nulls(len(occ), pa.int64()), pa.array((found[often] + (part << shift)).astype(np.int64))])
        values = {"occ": np.concatenate([occ, total[often]]), "n": np.concatenate([times.astype(np.int64), np.ones(int(often.sum()), np.int64)])}
        return pa.table({**values, "hash": hashes})

    parts = rows.mapInArrow(pack, "part int, low binary, n binary").groupBy("part").applyInArrow(count, "occ long, n long, hash long")
    return parts if least is not None else parts.groupBy("occ").agg(F.sum("n").alias("n"))


def nucleotides(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): A, C, G and T for the characters' codes in the text alphabet, so that texts map as DNA; null stays."""
    kind = df.schema[key].dataType.simpleString()
    letters = np.frombuffer(b"ACGT", np.uint8)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [None if x is None else letters[base_codes(x)].tobytes().decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], [key, "text"])

    return df.select(key, text).mapInArrow(emit, f"`{key}` {kind}, text string")


def kmers(df: DataFrame, key: str, text: str = "text", k: int = K) -> DataFrame:
    """(rid, pos, code, canonical, strand) of every k-mer in the text alphabet, by expressions alone."""
    codes = df.select(F.col(key).alias("rid"), code_array(F.col(text)).alias("codes"))
    at = F.sequence(F.lit(1), F.size("codes") - (k - 1))
    placed = codes.where(F.size("codes") >= k).select("rid", "codes", F.explode(at).alias("start"))

    def number(window: Column) -> Column:
        return F.aggregate(window, F.lit(0).cast("long"), lambda total, c: total * 4 + c)

    window = F.slice("codes", F.col("start"), F.lit(k))
    forward = number(window)
    back = number(F.transform(F.reverse(window), lambda c: 3 - c))
    both = placed.select("rid", (F.col("start") + k - 2).alias("pos"), forward.alias("code"), back.alias("back"))
    return both.select(
        "rid",
        "pos",
        "code",
        F.least("code", "back").alias("canonical"),
        F.when(F.col("back") < F.col("code"), 1).otherwise(0).alias("strand"),
    )


def minimizers_by_expression(df: DataFrame, key: str, text: str = "text", w: int = W, k: int = K) -> DataFrame:
    """The relation of ``minimizers`` as window functions: a readable statement for small tables."""
    near = Window.partitionBy("rid").orderBy("pos")
    hashed = kmers(df, key, text, k).withColumn("hash", hash_column(F.col("canonical"), 2 * k))
    floor = hashed.withColumn("floor", F.min("hash").over(near.rowsBetween(-(w - 1), 0))).withColumn(
        "place", F.row_number().over(near)
    )
    whole = Window.partitionBy("rid")
    full = floor.withColumn("floor", F.when((F.col("place") >= w) | (F.count("*").over(whole) == F.col("place")), F.col("floor")))
    reach = full.withColumn("reach", F.max("floor").over(near.rowsBetween(0, w - 1)))
    return reach.where(F.col("reach") == F.col("hash")).select("rid", "pos", "strand", "hash", F.lit(k).alias("span"))
