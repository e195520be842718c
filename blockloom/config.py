"""Tunables as frozen dataclasses, and validated settings from strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

UI, ANIME, PHOTO = 0, 1, 2

# Colour coefficients in 256ths (fixed values): luma, blue and red difference of red, green and blue; and what red, green and
# blue take of the red and blue differences.
LUMA, BLUE_DIFFERENCE, RED_DIFFERENCE = (77, 150, 29), (-43, -85, 128), (128, -107, -21)
RED_OF_RED, GREEN_OF_BLUE, GREEN_OF_RED, BLUE_OF_BLUE = 359, 88, 183, 454

# Half bits of block modes (fixed values): a palette's head, a colour of one byte or of two, a pair's indices with few changes or
# many, an index bit of all samples, what few changes save (changes up to, half bits), copies, and four quadrants.
PALETTE_HEAD, COLOR, WIDE_COLOR = 20, 16, 32
PAIR_CHANGES, PAIR_FEW, PAIR_MANY = 24, 48, 128
PAIR_SAVES, MANY_SAVE = (16, 16), ((16, 96), (24, 64), (32, 32))
INDEX_BIT = 128
COPY_SMALL, COPY_ANY, COPY_PROFILE = 12, 68, {PHOTO: 8, ANIME: 6}
QUADRANTS_COST, KEPT_MODE, RESCUE = 36, 4, 8
ANIME_SAVES, BUSY_SAVES, BUSY_CHANGES, BUSY_VARIANCE = (60, 24), 32, 32, 30000

# Limits of the profile's scores (fixed values).
LEAST_BLOCKS, LEAST_SAMPLES = 64, 32
EARLY_ANIME = (0.10, 6, 1.2)
UI_RATE, UI_BINS, UI_DIFFERENCE = 0.90, 10, 12
ANIME_RATE, ANIME_BINS, ANIME_DIFFERENCE = (0.60, 0.95), (8, 24), 28


def setting_int(text: str | None, fallback: int, low: int, high: int, clamp_high: bool = False) -> int:
    """A whole number in [low, high]; anything else gives the fallback (above the range the limit, if ``clamp_high``)."""
    try:
        value = int((text or "").strip())
    except ValueError:
        return fallback
    if clamp_high and value > high:
        return high
    return value if low <= value <= high else fallback


def setting_float(text: str | None, fallback: float, low: float, high: float) -> float:
    try:
        value = float((text or "").strip())
    except ValueError:
        return fallback
    return value if math.isfinite(value) and low <= value <= high else fallback


def setting_bool(text: str | None, fallback: bool) -> bool:
    known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
    return known.get((text or "").strip().lower(), fallback)


@dataclass(frozen=True)
class NaturalGate:
    """Thresholds, times 100 where the metric is."""

    unique_min: int = 64
    avg_run_max: int = 460
    mean_diff_min: int = 20
    entropy_min: int = 5


@dataclass(frozen=True)
class ChromaGate:
    mean_diff_max: int = 80
    avg_run_min: int = 320


@dataclass(frozen=True)
class ModeParams:
    palette_max_colors: int = 2
    palette_transition_limit: int = 63
    palette_variance_limit: int = 1 << 40


@dataclass(frozen=True)
class RowCost:
    top_k: int = 2
    lz_literal: int = 1
    lz_match: int = 4


@dataclass(frozen=True)
class TileLz:
    chain_depth: int = 0
    window: int = 32768
    nice_length: int = 32
    lazy: bool = False


@dataclass(frozen=True)
class GlobalLz:
    window: int = 65535
    chain_depth: int = 32
    short_match_max_distance: int = 128
    max_length: int = 255
    nice_length: int = 255
    bias_permille: int = 990
    optimal_matches: int = 4
    optimal_literals: int = 128


@dataclass(frozen=True)
class LoModes:
    """Gates of the low-byte chooser: permille of gain and least raw sizes."""

    delta_permille: int = 1000
    lz_rans_permille: int = 995
    lz_rans_min_raw: int = 2048
    contexts_permille: int = 990
    contexts_min_raw: int = 4096
    compact_min_bytes: int = 256


@dataclass(frozen=True)
class RouteGates:
    """When the other routes are tried, and what they must save: permille by profile of the screen route."""

    screen_min_pixels: int = 4096
    natural_min_pixels: int = 262_144
    natural_min_unique: int = 128
    screen_max_colors: int = 64
    screen_permille: tuple[int, int, int] = (995, 990, 1000)
    natural: NaturalGate = NaturalGate()
    chroma: ChromaGate = ChromaGate()
    #: Tries both routes whatever a band looks like.
    always: bool = False


@dataclass(frozen=True)
class Preset:
    """What an encoder preset turns on: the lines' cost, routes for luma and chroma planes, and how the natural route searches."""

    name: str
    row_cost: str = "sad"
    luma_routes: bool = True
    chroma_routes: bool = True
    photo_chroma_routes: bool = True
    careful_chroma: bool = False
    nice_length: int = 255
    search: str = "greedy"
    probe_low_bytes: bool = False


PRESETS = {
    "fast": Preset("fast", luma_routes=False, chroma_routes=False, careful_chroma=True, nice_length=64, probe_low_bytes=True),
    "balanced": Preset("balanced", photo_chroma_routes=False),
    "max": Preset("max", row_cost="entropy", search="lazy", probe_low_bytes=True),
    "smallest": Preset("smallest", row_cost="entropy", search="optimal"),
}
