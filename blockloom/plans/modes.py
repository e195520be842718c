"""How each 8x8 block of a band is coded: copied, by quadrants, by palette, or by its lines' predictors.

The rules and costs are those of ``operators.blocks``, on one band as an array, for the coder; a block's place is (by, bx).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from blockloom import config
from blockloom.config import ANIME, PHOTO, UI
from blockloom.functions.pixel import SMALL_VECTORS
from blockloom.operators.blocks import NEVER, QUADRANT_VECTORS, copy_cost, mode_params

FILTER, PALETTE, COPY, QUADRANTS = range(4)
MOST_COLORS = 8


def padded(samples: np.ndarray) -> np.ndarray:
    return np.pad(samples, ((0, -samples.shape[0] % 8), (0, -samples.shape[1] % 8)), mode="edge")


def cells(samples: np.ndarray, size: int) -> np.ndarray:
    """(rows, columns, size * size) of a padded band."""
    h, w = samples.shape
    return samples.reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(h // size, w // size, size * size)


def first_match(grid: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Index of the first (dx, dy), in cells, from which a cell's content can be copied; -1 for none."""
    rows, columns = grid.shape[:2]
    out = np.full((rows, columns), -1)
    for k, (dx, dy) in enumerate(offsets):
        y0, x0, x1 = max(0, -dy), max(0, -dx), columns - max(0, dx)
        if y0 >= rows or x0 >= x1:
            continue
        same = (grid[y0:, x0:x1] == grid[y0 + dy : rows + dy, x0 + dx : x1 + dx]).all(axis=2)
        part = out[y0:, x0:x1]
        part[same & (part < 0)] = k
    return out


def palette_of(block: np.ndarray) -> tuple[list[int], list[int]]:
    """Colours by frequency, then value, and the index of each sample."""
    values, index, counts = np.unique(block, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    return values[order].tolist(), np.argsort(order)[index.ravel()].tolist()


def palette_cost(colors: list[int], changes: int, profile: int) -> int:
    """Half bits of a palette block; the Column form is ``operators.blocks.palette_cost``."""
    n, wide = len(colors), sum(not -128 <= v <= 127 for v in colors)
    values = (n - wide) * config.COLOR + wide * config.WIDE_COLOR
    cost = config.PALETTE_HEAD + values
    if n <= 1:
        return cost
    if n == 2:
        few, saves = config.PAIR_SAVES
        return cost + (config.PAIR_FEW if changes <= config.PAIR_CHANGES else config.PAIR_MANY) - (saves if profile != PHOTO and changes <= few else 0)
    cost += config.INDEX_BIT * (n - 1).bit_length() if n <= 4 else config.INDEX_BIT * 3
    if profile == PHOTO:
        return cost + values
    return cost - next((saves for most, saves in config.MANY_SAVE if changes <= most), 0)


def half_bits(magnitude: np.ndarray, photo: bool) -> np.ndarray:
    size = np.minimum(8, np.ceil(np.log2(magnitude + 1.0)).astype(np.int64))
    return np.where(magnitude == 0, 1 if photo else 2, np.where(magnitude > 127, 20, 2 + 2 * size))


def profile_of(grid: np.ndarray, copies: np.ndarray) -> int:
    """UI, anime or photo, by copies, differences and range of sampled blocks."""
    n = grid.shape[0] * grid.shape[1]
    every = 1 if n < 256 else 2 if n < 1024 else 4
    some, hit = grid[::every, ::every].reshape(-1, 8, 8), copies[::every, ::every].ravel() >= 0
    if n < config.LEAST_BLOCKS or len(some) < config.LEAST_SAMPLES:
        return PHOTO
    rate, bins = float(hit.mean()), len(np.unique(np.clip(some, 0, 255) // 16))
    change = (np.abs(np.diff(some, axis=1)).sum() + np.abs(np.diff(some, axis=2)).sum()) / (len(some) * 64)
    early = config.EARLY_ANIME
    if rate >= early[0] and bins <= early[1] and change <= early[2]:
        return ANIME
    ui = 3 * (rate >= config.UI_RATE) + 2 * (bins <= config.UI_BINS) + (change <= config.UI_DIFFERENCE)
    anime = 2 * (config.ANIME_RATE[0] <= rate < config.ANIME_RATE[1]) + 2 * (config.ANIME_BINS[0] <= bins <= config.ANIME_BINS[1]) + 2 * (change <= config.ANIME_DIFFERENCE)
    return UI if ui >= anime + 2 else ANIME if anime >= 3 else PHOTO


@dataclass
class Modes:
    kinds: np.ndarray  #: (rows, columns) of the blocks
    palettes: list[tuple[list[int], list[int]]] = field(default_factory=list)  #: of palette blocks in raster order
    vectors: list[tuple[int, int]] = field(default_factory=list)  #: of copied blocks
    quadrants: list[tuple[int, ...]] = field(default_factory=list)  #: four candidates of blocks by quadrants


def decide(samples: np.ndarray, filter_bits: np.ndarray, profile: int | None = None) -> Modes:
    """The mode of each block of a padded band; ``filter_bits``: half bits under the best predictor by block."""
    grid = cells(samples, 8)
    copies = first_match(grid, [(x // 8, y // 8) for x, y in SMALL_VECTORS])
    profile = profile_of(grid, copies) if profile is None else profile
    quads = first_match(cells(samples, 4), [(x // 4, y // 4) for x, y in QUADRANT_VECTORS])
    four = quads.reshape(grid.shape[0], 2, grid.shape[1], 2).swapaxes(1, 2).reshape(*grid.shape[:2], 4)
    params = mode_params(profile)
    out, last = Modes(np.zeros(grid.shape[:2], np.int64)), FILTER
    for by, bx in np.ndindex(*grid.shape[:2]):
        block = grid[by, bx]
        if copies[by, bx] >= 0:
            kind = COPY
        else:
            costs = {QUADRANTS: config.QUADRANTS_COST if (four[by, bx] >= 0).all() else NEVER, COPY: NEVER, PALETTE: NEVER, FILTER: int(filter_bits[by, bx])}
            if len(np.unique(block)) <= MOST_COLORS:
                colors, index = palette_of(block)
                costs[PALETTE] = offered(block, colors, index, costs[FILTER], params, profile)
            if profile == PHOTO:
                costs = {k: c - config.KEPT_MODE * (k == last and c < NEVER) for k, c in costs.items()}
            kind = min(costs, key=costs.get)  # ties go to the first
        out.kinds[by, bx] = last = kind
        if kind == PALETTE:
            out.palettes.append((colors, index))
        elif kind == COPY:
            out.vectors.append(SMALL_VECTORS[copies[by, bx]])
        elif kind == QUADRANTS:
            out.quadrants.append(tuple(four[by, bx].tolist()))
    return out


def offered(block: np.ndarray, colors: list[int], index: list[int], filter_bits: int, params, profile: int) -> int:
    """Half bits of a block as a palette; NEVER if the profile's limits rule it out and it isn't much cheaper than its predictor."""
    changes, turns = int((np.diff(index) != 0).sum()), int((np.diff(block) != 0).sum())
    variance = int((block * block).sum()) - int(block.sum()) ** 2 // 64
    cost = palette_cost(colors, changes, profile)
    if profile == ANIME and len(colors) >= 2 and changes <= config.ANIME_SAVES[0]:
        cost -= config.ANIME_SAVES[1]
    fits = len(colors) <= params.palette_max_colors and (turns <= params.palette_transition_limit or len(colors) <= 1) and variance <= params.palette_variance_limit
    if not fits and (profile == PHOTO or cost + config.RESCUE >= filter_bits):
        return NEVER
    return cost - (config.BUSY_SAVES if profile != PHOTO and changes <= config.BUSY_CHANGES and variance >= config.BUSY_VARIANCE else 0)
