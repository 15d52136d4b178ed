"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves: leaves of a few words match by match, and two encoded neighbours are joined by re-encoding a
window of tokens around the seam.  The window grows until both of its edges are stable, that is

* the edge lies between a non-blank and a following white-space character, where every match of the split
  pattern ends whatever surrounds it; or
* the edge lies inside a run of one character class, hence inside one match, and the two tokens that meet
  there encode to themselves when put together.  For such a vocabulary a token sequence is the encoding of
  its bytes exactly when all its neighbouring pairs are, so tokens outside the window can't change.

Joining is associative, so any tree gives the ids of the whole text.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from strandloom.llm.tokens import text_slices

#: Code points of a leaf, which is split into matches and merged; longer texts are encoded by halves.
LEAF_CHARS = 512
#: Matches up to so many code points are remembered with their ids, this many of them.
_KEPT_CHARS, _KEPT = 48, 1 << 16
#: A code point that is no white space, letter or number to any engine.
_NEITHER = 0x0378
#: Code points before an edge that must be of its class for it to count as inside a match.
_RUN = 4


@functools.lru_cache(2)
def odd_letters() -> frozenset[int]:
    """Code points that are a letter or a number to the regex module, by its newer tables, but not to tiktoken's engine.

    All code points are put to both; the classes of white space agree.
    """
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    single = {bytes([i]): i for i in range(256)}
    kind = r"[\p{L}\p{N}]"
    theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
    known = set(bytes(theirs.encode_ordinary(every)).decode())
    return frozenset(map(ord, set(regex.findall(kind, every)) - known))


class TreeCodec:
    """Encodes and decodes by ranks (token bytes to id) and a split pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, odd: frozenset[int] | None = None):
        self._ranks, self._pattern = ranks, regex.compile(pattern)
        self._bytes = {i: b for b, i in ranks.items()}
        self._leaf = leaf_chars
        self._odd = dict.fromkeys(odd_letters() if odd is None else odd, _NEITHER)
        self._first_odd = chr(min(self._odd, default=0x10FFFF))
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pair = functools.lru_cache(1 << 14)(self._pair_stands)
        self._match = functools.lru_cache(_KEPT)(self._merged_text)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, stop: int) -> list[int]:
        if stop - start <= self._leaf:
            return self._matches(text[start:stop])
        middle = (start + stop) // 2
        return self._join(text, start, middle, stop, self._encode(text, start, middle), self._encode(text, middle, stop))

    def _matches(self, text: str) -> list[int]:
        """Ids of a text match by match."""
        out: list[int] = []
        match = self._match
        if text.isascii() or max(text) < self._first_odd:
            pieces = self._pattern.findall(text)
        else:
            # The odd ones are split as what they are to tiktoken; a match's own code points stand at its place.
            pieces = [text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self._odd))]
        for piece in pieces:
            out += match(piece) if len(piece) <= _KEPT_CHARS else self._merged(piece.encode())
        return out

    def _merged_text(self, piece: str) -> list[int]:
        return self._merged(piece.encode())

    def _merged(self, piece: bytes) -> list[int]:
        """Ids of one match, merged by the library: of those that aren't remembered there are very many in a large text."""
        return self._encoding._encode_single_piece(piece)

    def by_merges(self, piece: bytes) -> list[int]:
        """Ids of one match by the definition: neighbours whose union has the least rank are merged until none has a rank."""
        if piece in self._ranks:
            return [self._ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = self._ranks.get, len(self._ranks) + 1
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            k = pairs.index(least)
            one = parts[k] = parts[k] + parts.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + one, none)
            if k < len(pairs):
                pairs[k] = rank(one + parts[k + 1], none)
        return [self._ranks[p] for p in parts]

    def _pair_stands(self, left: int, right: int) -> bool:
        return self.by_merges(self._bytes[left] + self._bytes[right]) == [left, right]

    def _stable(self, text: str, at: int, left: int, right: int) -> bool:
        if _hard(text, at):
            return True
        after = text[at]
        kind = _kind(after)
        if kind == "space" or after == "'" or any(c == "'" or _kind(c) != kind for c in text[max(0, at - _RUN) : at]):
            return False
        return at >= _RUN and self._pair(left, right)

    def _join(self, text: str, start: int, middle: int, stop: int, a: list[int], b: list[int]) -> list[int]:
        keep, skip, width = len(a), 0, 4
        left, right = middle, middle  # code points where the window begins and ends
        fixed_left = fixed_right = False
        while not (fixed_left and fixed_right):
            if not fixed_left:
                keep, left, fixed_left = self._grow_left(text, start, a, keep, left, width)
            if not fixed_right:
                skip, right, fixed_right = self._grow_right(text, stop, b, skip, right, width)
            width *= 2
        window = self._matches(text[left:right])
        # Inside a match the pairs at the edges must stand with the window's own tokens too.
        if window and keep and left > start and not self._edge_holds(text, left, a[keep - 1], window[0]):
            return self._wider(text, start, stop, a, b, left, right)
        if window and skip < len(b) and right < stop and not self._edge_holds(text, right, window[-1], b[skip]):
            return self._wider(text, start, stop, a, b, left, right)
        return a[:keep] + window + b[skip:]

    def _edge_holds(self, text: str, at: int, left: int, right: int) -> bool:
        return _hard(text, at) or self._pair(left, right)

    def _wider(self, text, start, stop, a, b, left, right) -> list[int]:
        """Window from hard edge to hard edge, or to the ends."""
        while left > start and not _hard(text, left):
            left -= 1
        while right < stop and not _hard(text, right):
            right += 1
        keep, drop = self._cut(a, text[start:left], False), self._cut(b, text[right:stop], True)
        return a[:keep] + self._matches(text[left:right]) + b[len(b) - drop :]

    def _cut(self, ids: list[int], text: str, from_end: bool) -> int:
        """How many tokens, from one end, hold exactly the bytes of the text."""
        need, count = len(text.encode()), 0
        for i in reversed(ids) if from_end else ids:
            if need <= 0:
                break
            need -= len(self._bytes[i])
            count += 1
        return count

    def _grow_left(self, text, start, a, keep, left, width):
        """Take up to ``width`` more tokens off the left side, stopping at a stable edge."""
        for _ in range(width):
            if not keep:
                return 0, start, True
            keep -= 1
            piece = self._bytes[a[keep]]
            moved = sum((x & 0xC0) != 0x80 for x in piece)  # code points that begin in the token
            left -= moved
            whole = (piece[0] & 0xC0) != 0x80
            if keep and left > start and whole and self._stable(text, left, a[keep - 1], a[keep]):
                return keep, left, True
        return (keep, left, False) if keep else (0, start, True)

    def _grow_right(self, text, stop, b, skip, right, width):
        """Take up to ``width`` more tokens off the right side, stopping at a stable edge."""
        for _ in range(width):
            if skip >= len(b):
                return len(b), stop, True
            piece = self._bytes[b[skip]]
            skip += 1
            right += sum((x & 0xC0) != 0x80 for x in piece)
            whole = skip < len(b) and (self._bytes[b[skip]][0] & 0xC0) != 0x80
            if whole and right < stop and self._stable(text, right, b[skip - 1], b[skip]):
                return skip, right, True
        return (skip, right, False) if skip < len(b) else (len(b), stop, True)

    def decode_bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self._leaf:
            return b"".join(map(self._bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode_bytes(ids[:middle]) + self.decode_bytes(ids[middle:])


#: White space that the split pattern's \s knows; str.isspace() has four separators (1C-1F) besides.
def _white(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _hard(text: str, at: int) -> bool:
    """Whether a match of the split pattern ends before text[at] whatever surrounds it."""
    return _white(text[at]) and not text[at - 1].isspace()


def _kind(c: str) -> str:
    if c.isspace():
        return "space"
    major = unicodedata.category(c)[0]
    return {"L": "letter", "N": "number"}.get(major, "other")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tokenizer file with one "base64-bytes id" a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode_documents(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True
) -> DataFrame:
    """Per row: the key, token ids (with ``ids``), n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts give no tokens.  The ranks reach the tasks as a broadcast of the vocabulary file's
    size (under 1 MB); texts are encoded where they are read, without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern, odd_letters()))
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, " + ("ids array<int>, " if ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in text_slices(batch, 1):
                yield _encoded(codec, part, key, ids)

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(encode, schema)


def _encoded(codec: TreeCodec, batch: pa.RecordBatch, key: str, ids: bool) -> pa.RecordBatch:
    lists, hashes, decoded = [], [], []
    for value in batch.column(1):
        tokens = codec.encode(value.as_py() or "")
        decoded.append(hashlib.sha256(codec.decode_bytes(tokens)).hexdigest())
        lists.append(np.array(tokens, np.int32))  # 4 bytes a token are held, not an object for each
        hashes.append(hashlib.sha256(lists[-1].astype("<u4").tobytes()).hexdigest())
    counts = np.array([len(x) for x in lists], np.int64)
    columns, names = [batch.column(0)], [key]
    if ids:
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]))))
        names.append("ids")
    columns += [pa.array(counts), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256"])


_last: list = [None, None]


def _codec(shared) -> TreeCodec:
    """The codec of the vocabulary that this worker process used last; a worker outlives many tasks."""
    ranks, pattern, odd = shared.value
    if _last[0] is not ranks:
        _last[:] = ranks, TreeCodec(ranks, pattern, odd=odd)
    return _last[1]
