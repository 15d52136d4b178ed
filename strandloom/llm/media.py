"""Media columns: make, sniff, validate and carve binary columns.

An Aho-Corasick automaton locates all magic bytes of a value in one pass; each hit is kept only if its
format's validator can walk the structure from there, which also gives its length.  A hit at offset 0 decides
the value's type, correcting the declared one; hits further inside are carved as embedded media.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payloads are filled with zero bytes to a positive multiple of this.
UNIT = 64
SAMPLE_RATE = 8000
#: Fixed values of the formats: magic bytes and the type they announce.
MAGIC = {
    b"RIFF": "riff",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"BM": "image/bmp",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
}
_RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Found(NamedTuple):
    kind: str
    start: int
    length: int


def pad_payload(raw: bytes) -> bytes:
    """The bytes and zero bytes up to a positive multiple of UNIT."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav_bytes(payload: bytes) -> bytes:
    """Canonical mono PCM file of unsigned 8-bit samples."""
    pad = bytes(len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body += b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(raw: bytes) -> bytes | None:
    """The data chunk of a valid 8-bit mono PCM file, else None."""
    for name, at, size in _riff_chunks(raw, 0):
        if name == b"data":
            return raw[at : at + size]
    return None


def _riff_chunks(raw: bytes, start: int) -> Iterator[tuple[bytes, int, int]]:
    end = start + 8 + struct.unpack_from("<I", raw, start + 4)[0]
    at = start + 12
    while at + 8 <= end:
        size = struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def _riff(raw: bytes, start: int, find: _Finder) -> Found | None:
    if start + 20 > len(raw):
        return None
    size = struct.unpack_from("<I", raw, start + 4)[0] + 8
    kind = _RIFF_FORMS.get(raw[start + 8 : start + 12])
    if kind is None or start + size > len(raw):
        return None
    chunks = list(_riff_chunks(raw, start))
    whole = bool(chunks) and all(at + n <= start + size for _, at, n in chunks)
    if kind == "audio/wav":
        whole = whole and {b"fmt ", b"data"} <= {name for name, _, _ in chunks}
    return Found(kind, start, size) if whole else None


def _png(raw: bytes, start: int, find: _Finder) -> Found | None:
    at, first = start + 8, True
    while at + 12 <= len(raw):
        size, name = struct.unpack_from(">I", raw, at)[0], raw[at + 4 : at + 8]
        end = at + 12 + size
        if end > len(raw) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(raw[at + 4 : end - 4]) != struct.unpack_from(">I", raw, end - 4)[0]:
            return None
        if name == b"IEND":
            return Found("image/png", start, end - start)
        at, first = end, False
    return None


def _gif(raw: bytes, start: int, find: _Finder) -> Found | None:
    def sub_blocks(at: int) -> int:
        while raw[at]:
            at += raw[at] + 1
        return at + 1

    try:
        flags = raw[start + 10]
        at = start + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        while raw[at] != 0x3B:
            if raw[at] == 0x21:
                at = sub_blocks(at + 2)
            elif raw[at] == 0x2C:
                local = raw[at + 9]
                at = sub_blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            else:
                return None
        return Found("image/gif", start, at + 1 - start)
    except IndexError:
        return None


class _Finder:
    """The next place of a mark from some place on; what one search passed over is not searched again."""

    def __init__(self, raw: bytes):
        self._raw = raw
        self._known: dict[bytes, tuple[int, int]] = {}
        #: For each Ogg page that a walk met, where that walk ended.
        self.walked: dict[int, int] = {}

    def __call__(self, mark: bytes, start: int) -> int:
        begun, at = self._known.get(mark, (len(self._raw) + 1, -1))
        if begun <= start and (at < 0 or at >= start):
            return at
        at = self._raw.find(mark, start)
        self._known[mark] = (start, at)
        return at


def _jpeg(raw: bytes, start: int, find: _Finder) -> Found | None:
    at = start + 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        mark = raw[at + 1]
        if mark == 0xDA:  # entropy-coded data runs to the end mark
            end = find(b"\xff\xd9", at)
            return Found("image/jpeg", start, end + 2 - start) if end > 0 else None
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return None
        at += 2 + size
    return None


def _pdf(raw: bytes, start: int, find: _Finder) -> Found | None:
    if not raw[start + 5 : start + 6].isdigit():
        return None
    end, table = find(b"%%EOF", start), find(b"startxref", start)
    return Found("application/pdf", start, end + 5 - start) if 0 <= table < end else None


def _zip(raw: bytes, start: int, find: _Finder) -> Found | None:
    end = find(b"PK\x05\x06", start)
    if end < 0 or end + 22 > len(raw):
        return None
    size, offset = struct.unpack_from("<II", raw, end + 12)
    if start + offset + size != end:
        return None
    return Found("application/zip", start, end + 22 + struct.unpack_from("<H", raw, end + 20)[0] - start)


def _gzip(raw: bytes, start: int, find: _Finder) -> Found | None:
    unpacker, at, view = zlib.decompressobj(31), start, memoryview(raw)
    try:
        while not unpacker.eof and (unpacker.unconsumed_tail or at < len(raw)):
            piece = unpacker.unconsumed_tail
            if not piece:
                piece, at = view[at : at + 4096], at + 4096
            unpacker.decompress(piece, 1 << 16)
    except zlib.error:
        return None
    used = min(at, len(raw)) - start - len(unpacker.unused_data)
    return Found("application/gzip", start, used) if unpacker.eof else None


def _bmp(raw: bytes, start: int, find: _Finder) -> Found | None:
    if start + 54 > len(raw):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", raw, start + 2)
    fits = not zero and header in (40, 52, 56, 108, 124) and 14 + header <= offset < size <= len(raw) - start
    return Found("image/bmp", start, size) if fits else None


def _flac(raw: bytes, start: int, find: _Finder) -> Found | None:
    fits = raw[start + 4 : start + 5] in (b"\x00", b"\x80") and raw[start + 5 : start + 8] == b"\x00\x00\x22"
    return Found("audio/flac", start, len(raw) - start) if fits else None


def _ogg(raw: bytes, start: int, find: _Finder) -> Found | None:
    at, met = start, []
    while at not in find.walked and raw[at : at + 5] == b"OggS\x00" and at + 27 <= len(raw):
        met.append(at)
        count = raw[at + 26]
        at += 27 + count + sum(raw[at + 27 : at + 27 + count])
    at = find.walked.get(at, at)
    find.walked.update(dict.fromkeys(met, at))
    return Found("audio/ogg", start, at - start) if start < at <= len(raw) else None


_VALIDATORS = {
    "riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "image/bmp": _bmp, "audio/flac": _flac, "audio/ogg": _ogg,
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


#: Kinds whose values hold others; marks inside any other kind are its own data.
_HOLDERS = frozenset([*_RIFF_FORMS.values(), "application/pdf", "application/zip"])


def sniff(raw: bytes) -> list[Found]:
    """Validated media in a value, outermost first by offset; a hit inside carved media, or inside the value's own
    container where that kind holds no others, is part of it and not listed again."""
    out: list[Found] = []
    covered, find = 0, _Finder(raw)
    for last, (length, kind) in _automaton().iter(raw.decode("latin-1")):
        start = last - length + 1
        if start < covered:
            continue
        found = _VALIDATORS[kind](raw, start, find)
        if found is not None:
            out.append(found)
            if start or found.kind not in _HOLDERS:
                covered = start + found.length
    return out


def true_type(found: list[Found], declared: str | None) -> str:
    """The validated type at offset 0, else the declared one, else unknown."""
    if found and found[0].start == 0:
        return found[0].kind
    return declared or "application/octet-stream"


def text_to_media(text: Column) -> Column:
    """Binary column: the text's padded UTF-8 bytes stored as 8-bit samples (null: empty text); equal texts, equal bytes."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wav_bytes(pad_payload((t or "").encode())))

    return store(text)


_FEATURES = (
    "true_type: string, corrected: boolean, payload_bytes: long, payload_sha256: string, tail_crc32: long, "
    "media_bytes: long, media_sha256: string, carved: array<struct<kind: string, start: long, length: long>>, "
    "feature: string"
)


def describe(raw: bytes | None, declared: str | None) -> dict:
    """Features of one media value, read back from its stored bytes; a null value is empty bytes."""
    raw = raw or b""
    found = sniff(raw)
    kind = true_type(found, declared)
    payload = (wav_samples(raw) if kind == "audio/wav" else None) or b""
    carved = [x for x in found if x.start]
    samples = np.frombuffer(payload, np.uint8)
    level, power = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    return {
        "true_type": kind,
        "corrected": kind != declared,
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(raw),
        "media_sha256": hashlib.sha256(raw).hexdigest(),
        "carved": [x._asdict() for x in carved],
        "feature": f"{kind};samples={len(payload)};level={level};power={power};carved="
        + ",".join(f"{x.kind}@{x.start}+{x.length}" for x in carved),
    }


def with_features(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Add a struct column ``features``, in place of one of that name, for each value of a binary column (see ``describe``)."""

    @F.pandas_udf(f"struct<{_FEATURES}>")
    def features(values: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(v, k) for v, k in zip(values, kinds, strict=True)], columns=_NAMES)

    return df.withColumn("features", features(F.col(media), F.col(declared) if declared else F.lit(None).cast("string")))


_NAMES = [
    "true_type", "corrected", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "carved", "feature",
]
