"""Searches that need whole neighbourhoods of samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.functions.pixel import quotient


def nearest_copy(samples: np.ndarray, by: int, bx: int, radius: int = 64, size: int = 8) -> tuple[int, int, int]:
    """(dx, dy, sad) of the earlier place, at any sample, that differs least from a block.

    Places that end above the block come first, line by line, then those that end left of it on its
    own line; the earliest wins ties.  Without any place the sum of differences is -1.
    """
    y, x = by * size, bx * size
    own = samples[y : y + size, x : x + size].astype(np.int64)
    best = (0, 0, -1)
    top, left = max(0, y - radius), max(0, x - radius)
    right = min(samples.shape[1] - size, x + radius)
    areas = [(top, y - size, left, right - 1), (y, y, left, x - size)]
    for y0, y1, x0, x1 in areas:
        if y1 < y0 or x1 < x0:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(samples[y0 : y1 + size, x0 : x1 + size].astype(np.int64), (size, size))
        sad = np.abs(windows - own).sum(axis=(2, 3))
        at = int(sad.argmin())
        if best[2] < 0 or sad.flat[at] < best[2]:
            best = (x0 + at % sad.shape[1] - x, y0 + at // sad.shape[1] - y, int(sad.flat[at]))
        if best[2] == 0:
            break
    return best


#: Lines of blocks that are searched at once; what they may copy from travels with them.
BAND = 32


def line_copies(samples: np.ndarray, y: int, top: int, radius: int, size: int) -> np.ndarray:
    """nearest_copy() of all blocks of a line of blocks at once: rows of (dx, dy, sad). Differences are added up place by place in a block."""
    width = samples.shape[1]
    n = width // size
    left = np.arange(n) * size
    small = samples.dtype == np.uint8 and size * size * 255 < 1 << 16
    whole = samples if small else samples.astype(np.int64)
    kind = np.uint16 if small else np.int64
    own = whole[y : y + size, : n * size].reshape(size, n, size)
    found = np.zeros((n, 3), np.int64)
    found[:, 2] = -1
    spots = np.arange(width - size + 1)
    near = spots >= left[:, None] - radius
    rows = max(0, y - size - top + 1)
    for first, high, allowed in ((top, rows, near & (spots < np.minimum(width - size, left + radius)[:, None])), (y, 1, near & (spots <= left[:, None] - size))):
        if not high:
            continue
        sad = np.zeros((n, high, len(spots)), kind)
        for dy in range(size):
            for dx in range(size):
                there = whole[first + dy : first + dy + high, dx : dx + len(spots)]
                mine = own[dy, :, dx][:, None, None]
                sad += np.maximum(there, mine) - np.minimum(there, mine)
        sad = np.where(allowed[:, None, :], sad, np.iinfo(kind).max).reshape(n, -1)
        at = sad.argmin(axis=1)
        least = sad[np.arange(n), at].astype(np.int64)
        better = allowed.any(axis=1) & ((found[:, 2] < 0) | (least < found[:, 2]))
        got = np.stack([at % len(spots) - left, at // len(spots) + first - y, least], axis=1)
        found[better] = got[better]
    return found


def nearest_copies(plane: DataFrame, radius: int = 64, size: int = 8) -> DataFrame:
    """(image_id, by, bx, dx, dy, sad) of every block of a padded plane.

    A band of lines of blocks travels with the lines that it may copy from, so a group is bounded by the band, the radius and
    the width of the plane.
    """
    lines = plane.select("image_id", "y", "row", quotient(F.col("y"), size).alias("own"))
    reach = -(-radius // size)
    bands = F.sequence(quotient(F.col("own"), BAND), quotient(F.col("own") + reach, BAND))
    sent = lines.select("image_id", F.explode(bands).alias("band"), "y", "row")

    def each(table: pa.Table) -> pa.Table:
        at = table.column("y").to_numpy()
        order = np.argsort(at)
        row = table.column("row").combine_chunks()
        samples = row.flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)[order]
        at, image, band = at[order], table.column("image_id")[0].as_py(), table.column("band")[0].as_py()
        if samples.size and 0 <= samples.min() and samples.max() <= 255:
            samples = samples.astype(np.uint8)
        own = at // size
        keys, parts = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
        for by in np.unique(own[own // BAND == band]).tolist():
            y = int(np.searchsorted(at, by * size))
            top = max(int(np.searchsorted(at, (by - reach) * size)), y - radius, 0)
            got = line_copies(samples, y, top, radius, size)
            parts.append(got)
            keys.append(np.stack([np.full(len(got), by), np.arange(len(got))], axis=1))
        flat = np.concatenate([np.concatenate(keys), np.concatenate(parts)], axis=1)
        return pa.table([pa.array([image] * len(flat), pa.string()), *(pa.array(flat[:, k]) for k in range(5))], names=["image_id", "by", "bx", "dx", "dy", "sad"])

    return sent.groupBy("image_id", "band").applyInArrow(each, "image_id string, by long, bx long, dx long, dy long, sad long")
