"""Words and word shingles of whole Arrow text columns, computed with numpy on the UTF-8 buffer.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z is lower-cased; a document's
shingles are its five-word windows, or the whole word sequence when there are fewer words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
#: Bytes of text handled by one round of numpy calls; a longer single document is one round by itself.
CHUNK_BYTES = 1 << 19
#: Bytes of text, and rows, of the slices in which operators that return much for each text read a batch.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each.

    Those of a usual chunk are kept; a longer text's are made for it alone and given back.
    """
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        factors = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        factors[0] = 1
        made.append(np.multiply.accumulate(factors))
    if n <= CHUNK_BYTES + 1:
        _powers[:] = made
    return made[0], made[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about SLICE_BYTES of text and at most SLICE_ROWS rows; none is copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    row, n = 0, batch.num_rows
    while row < n:
        before = int(ends[row - 1]) if row else 0
        stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
        stop = min(max(stop, row + 1), row + SLICE_ROWS, n)
        yield batch.slice(row, stop - row)
        row = stop


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) of consecutive rows of about ``size`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def row_shingles(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the ``size``-word windows of one row's word hashes, repeats included."""
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix64(out)


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row in order, its distinct shingle hashes in ascending order."""
    for _, data, offsets in text_chunks(column):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        every = row_shingles(words, size)  # those over two rows are passed over
        bounds = first.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = np.sort(every[a : b - size + 1] if b - a >= size else row_shingles(words[a:b], size))
            if len(own) > 1:
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                own = own[fresh]
            yield own
