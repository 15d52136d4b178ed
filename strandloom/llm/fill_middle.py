"""Fill-in-middle transformation: a text's middle moves behind its prefix and suffix, between marks.

A text is cut between its units: a word with the white space before it, or white space at the end.  White space is
ASCII, so units end at bytes of the UTF-8 text, and these are found eight at a time: every text is laid out as whole
64-bit words, filled up with spaces; arithmetic on a word marks its unit-ending bytes (SWAR); the marks of a word are
counted with one bitwise_count; the running count is searched for the word that holds the k-th end, and the k-th end
inside that word is resolved by counting prefix sums of its bytes.  All cuts of a slice of rows are resolved together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of the texts that are transformed, and percent of these whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE, _SEVEN, _EIGHT, _TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


def _white_bytes(x: np.ndarray) -> np.ndarray:
    """High bit of every byte that is 0x20 or 0x09 to 0x0D."""
    spaced = x ^ (_ONES * np.uint64(0x20))
    other = ((spaced & _LOW7) + _LOW7) | spaced  # high bit: the byte isn't 0x20
    low = x & _LOW7  # additions below stay within their byte
    control = (low + _ONES * np.uint64(0x80 - 0x09)) & ~(low + _ONES * np.uint64(0x80 - 0x0E)) & ~x
    return (~other | control) & _HIGH


class UnitIndex:
    """Unit ends of some UTF-8 texts, with counts that answer where the k-th unit of a text ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        words = sizes // 8 + 1  # at least one space follows every text
        self._first = np.concatenate([[0], np.cumsum(words)])
        buffer = np.full(int(self._first[-1]) * 8, 0x20, np.uint8)
        for at, text in zip((self._first[:-1] * 8).tolist(), texts, strict=True):
            buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
        x = buffer.view("<u8")
        white = _white_bytes(x)
        following = np.empty_like(white)
        following[:-1], following[-1:] = white[1:], _HIGH
        self._marks = ~white & ((white >> _EIGHT) | (following << _TOP)) & _HIGH
        # A text that ends in white space has one more unit there.
        last = self._first[:-1] * 8 + sizes - 1
        closes = last[(sizes > 0) & np.isin(buffer[last], (0x20, 9, 10, 11, 12, 13))]
        self._marks[closes >> 3] |= np.uint64(0x80) << ((closes & 7).astype(np.uint64) * _EIGHT)
        self._upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self._marks), dtype=np.int64)])
        # Continuation bytes have bit 7 set and bit 6 clear; all others begin a code point.
        self._begins = ~(x & ~(x << _ONE)) & _HIGH
        self._chars = np.concatenate([[0], np.cumsum(np.bitwise_count(self._begins), dtype=np.int64)])
        self.counts = self._upto[self._first[1:]] - self._upto[self._first[:-1]]

    def select(self, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes of each row's text up to the end of its k-th unit; k from 0 (no byte) to the row's count."""
        begin = self._first[row]
        rank = self._upto[begin] + k
        word = np.maximum(np.searchsorted(self._upto, rank, side="left") - 1, 0)
        inside = np.where(k > 0, rank - self._upto[word], 1).astype(np.uint64)  # 1 to 8: which mark of the word
        sums = (self._marks[word] >> _SEVEN) * _ONES  # byte j: marks in bytes 0 to j
        reached = ((sums | _HIGH) - inside * _ONES) & _HIGH
        ends = word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)
        return np.where(k > 0, ends - begin * 8, 0)

    def code_points(self, row: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Code points in the first ``size`` bytes of each row's text."""
        begin = self._first[row]
        whole, rest = begin + (size >> 3), (size & 7).astype(np.uint64)
        part = self._begins[whole] & ((_ONE << (rest * _EIGHT)) - _ONE)
        return self._chars[whole] + np.bitwise_count(part) - self._chars[begin]


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four repeatable 32-bit numbers of a key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED
) -> DataFrame:
    """Per row: the key, n (units), form, prefix_chars, middle_chars and the transformed text as ``output``.

    Null text is empty, a null key is drawn for as an empty one, equal keys draw equal numbers.  Form is "plain", with
    null character counts, for empty texts, for texts that hold one of the marks and for those not drawn; else "psm" or
    "spm".  Each row depends on itself alone: texts are transformed where they are read, other columns stay unread.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n long, form string, prefix_chars long, middle_chars long, output string"

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                columns = _transformed(part.column(1).to_pylist(), part.column(2), rate, suffix_first, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], [key, "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("drawn_for")
    return df.select(f"`{key}`", named, F.col(f"`{text}`")).mapInArrow(transform, schema)


def _transformed(keys: list[str], column: pa.Array, rate: int, suffix_first: int, seed: int) -> list[pa.Array]:
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    units = UnitIndex(texts)
    drawn = np.array([draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    clean = np.array([t != b"" and not any(m in t for m in marks) for t in texts], bool)
    row = np.flatnonzero(clean & (drawn[:, 2] % 100 < rate))
    cuts = np.sort(drawn[row, :2] % (units.counts[row, None] + 1), axis=1)
    one, two = units.select(row, cuts[:, 0]), units.select(row, cuts[:, 1])
    chars = units.code_points(row, one), units.code_points(row, two)
    form, output = ["plain"] * len(texts), list(texts)
    psm = drawn[row, 3] % 100 >= suffix_first
    for r, a, b, prefix_first in zip(row.tolist(), one.tolist(), two.tolist(), psm.tolist(), strict=True):
        whole, (p, s, m) = texts[r], marks
        form[r] = "psm" if prefix_first else "spm"
        outer = [p, whole[:a], s, whole[b:]] if prefix_first else [s, whole[b:], p, whole[:a]]
        output[r] = b"".join([*outer, m, whole[a:b]])
    absent = np.ones(len(texts), bool)
    absent[row] = False
    counted = []
    for values in (chars[0], chars[1] - chars[0]):
        all_rows = np.zeros(len(texts), np.int64)
        all_rows[row] = values
        counted.append(pa.array(all_rows, mask=absent))
    return [pa.array(units.counts), pa.array(form, pa.string()), *counted, pa.array(output, pa.binary()).cast(pa.string())]


def restore(output: Column, form: Column) -> Column:
    """The exact text that ``output`` was made from; no part of it holds a mark, so the first of each is the mark."""

    def cut(value: Column, mark: str) -> tuple[Column, Column]:
        """What stands before the first mark, and what after it."""
        before = F.substring_index(value, mark, 1)
        return before, F.substring(value, F.length(before) + len(mark) + 1, F.length(value))

    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    prefix, rest = cut(body, SUFFIX)
    suffix, middle = cut(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = cut(body, PREFIX)
    prefix, middle = cut(rest, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
