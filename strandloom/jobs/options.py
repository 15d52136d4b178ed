"""Mapping options, presets and their validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    k: int = 15
    w: int = 10
    compressed: bool = False
    mid_occ_fraction: float = 2e-4
    min_mid_occ: int = 10
    max_mid_occ: int = 1_000_000
    max_occ: int = 0
    max_max_occ: int = 4_095
    occ_dist: int = 500
    query_fraction: float = 0.01
    min_cnt: int = 3
    min_score: int = 40
    band: int = 500
    band_long: int = 20_000
    max_gap: int = 5_000
    best_n: int = 5
    pri_ratio: float = 0.8
    mask_level: float = 0.5
    no_diagonal: bool = False
    no_dual: bool = False
    match: int = 2
    mismatch: int = 4
    gap_open: int = 4
    gap_extend: int = 2
    zdrop: int = 400
    zdrop_inv: int = 200
    min_dp_score: int = 80
    gap_open2: int = 24
    gap_extend2: int = 1
    alphabet: str = "text"


_OVERLAP = {"no_diagonal": True, "no_dual": True, "min_score": 100, "pri_ratio": 0.0, "best_n": 5, "band": 2000, "band_long": 2000}
_ASSEMBLY = {"zdrop": 200, "zdrop_inv": 200, "min_dp_score": 200}
#: Settings of the named presets.
PRESETS: dict[str, dict] = {
    "map-ont": {},
    "ava-ont": {"k": 15, "w": 5, **_OVERLAP},
    "map-pb": {"k": 19, "compressed": True},
    "ava-pb": {"k": 19, "w": 5, "compressed": True, **_OVERLAP},
    "map-hifi": {"k": 19, "w": 19, "min_mid_occ": 50, "max_mid_occ": 500, "match": 1, "mismatch": 4, "gap_open": 6, "gap_extend": 2, "gap_open2": 26, "min_dp_score": 200},
    "asm5": {"k": 19, "w": 19, "match": 1, "mismatch": 19, "gap_open": 39, "gap_extend": 3, "gap_open2": 81, **_ASSEMBLY, "best_n": 50, "band": 1000, "band_long": 100_000},
    "asm10": {"k": 19, "w": 19, "match": 1, "mismatch": 9, "gap_open": 16, "gap_extend": 2, "gap_open2": 41, **_ASSEMBLY, "best_n": 50, "band": 1000, "band_long": 100_000},
    "asm20": {"k": 19, "w": 10, "match": 1, "mismatch": 4, "gap_open": 6, "gap_extend": 2, "gap_open2": 26, **_ASSEMBLY, "best_n": 50, "band": 1000, "band_long": 100_000},
    "sr": {"k": 21, "w": 11, "match": 2, "mismatch": 8, "gap_open": 12, "gap_extend": 2, "max_gap": 100, "band": 100, "band_long": 100, "best_n": 20, "min_cnt": 2, "min_score": 25, "zdrop": 100, "zdrop_inv": 100, "min_dp_score": 40},
}


def preset(name: str) -> Options:
    """Options of a preset; unknown names are an error."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return check(replace(Options(), **PRESETS[name]))


def check(options: Options) -> Options:
    """The same options, or a ValueError that names the first setting out of its range."""
    rules = (
        (1 <= options.k <= 28, "k must be from 1 to 28"),
        (1 <= options.w < 256, "w must be from 1 to 255"),
        (0 <= options.mid_occ_fraction < 1, "mid_occ_fraction must be in [0, 1)"),
        (options.min_mid_occ <= options.max_mid_occ, "min_mid_occ must not exceed max_mid_occ"),
        (options.max_occ >= 0 and options.max_max_occ >= 0, "max_occ and max_max_occ must not be negative"),
        (options.occ_dist > 0, "occ_dist must be positive"),
        (0 <= options.query_fraction <= 1, "query_fraction must be in [0, 1]"),
        (options.band <= options.band_long, "band must not exceed band_long"),
        (options.best_n >= 0, "best_n must not be negative"),
        (0 <= options.pri_ratio <= 1, "pri_ratio must be in [0, 1]"),
        (0 <= options.mask_level <= 1, "mask_level must be in [0, 1]"),
        (options.match > 0 and options.mismatch > 0, "match and mismatch must be positive"),
        (options.gap_open >= 0 and options.gap_extend > 0, "gap_extend must be positive"),
        (options.zdrop_inv >= 0, "zdrop_inv must not be negative"),
        (options.gap_open2 >= 0 and options.gap_extend2 > 0, "gap_extend2 must be positive"),
        (options.alphabet in ("text", "dna"), "alphabet must be text or dna"),
    )
    for holds, message in rules:
        if not holds:
            raise ValueError(message)
    return options


def from_settings(*layers: str | dict) -> Options:
    """Defaults overridden by JSON texts or mappings, later ones last; unknown names are an error."""
    known, merged = {f.name for f in fields(Options)}, asdict(Options())
    for layer in layers:
        values = json.loads(layer) if isinstance(layer, str) else layer
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        merged |= values
    return check(Options(**merged))
