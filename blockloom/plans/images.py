"""Whole images to container bytes and back, lossless and lossy, and their comparison."""

from __future__ import annotations

import numpy as np

from blockloom.config import BLUE_DIFFERENCE, BLUE_OF_BLUE, GREEN_OF_BLUE, GREEN_OF_RED, LUMA, PRESETS, RED_DIFFERENCE, RED_OF_RED
from blockloom.functions.block import chroma_quality, quant_table
from blockloom.operators import codecs as C
from blockloom.plans.lossless import decode_band, encode_band
from blockloom.plans.lossy import Lossy, decode_plane, encode_plane, transform  # noqa: F401
from blockloom.sources import container as K

PLANES = ("PLN0", "PLN1", "PLN2")


def to_ycocg(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    co = r - b
    t = b + (co >> 1)
    cg = g - t
    return [t + (cg >> 1), co, cg]


def from_ycocg(y: np.ndarray, co: np.ndarray, cg: np.ndarray) -> np.ndarray:
    t = y - (cg >> 1)
    g, b = cg + t, t - (co >> 1)
    return np.clip(np.stack([b + co, g, b], axis=-1), 0, 255).astype(np.uint8)


def to_ycbcr(rgb: np.ndarray) -> list[np.ndarray]:
    planes = rgb.astype(np.int64) @ np.array((LUMA, BLUE_DIFFERENCE, RED_DIFFERENCE)).T >> 8
    return [np.clip(planes[..., k] + center, 0, 255) for k, center in enumerate((0, 128, 128))]


def from_ycbcr(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    u, v = cb - 128, cr - 128
    steps = (RED_OF_RED * v >> 8, -(GREEN_OF_BLUE * u + GREEN_OF_RED * v >> 8), BLUE_OF_BLUE * u >> 8)
    return np.clip(np.stack([y + s for s in steps], axis=-1), 0, 255).astype(np.uint8)


def encode_lossless(rgb: np.ndarray, preset: str = "balanced") -> bytes:
    chunks = [(name, encode_band(p, PRESETS[preset], chroma=k > 0)) for k, (name, p) in enumerate(zip(PLANES, to_ycocg(rgb), strict=True))]
    return K.pack(K.header(rgb.shape[1], rgb.shape[0]), chunks)


def halve(plane: np.ndarray) -> np.ndarray:
    p = np.pad(plane, ((0, plane.shape[0] % 2), (0, plane.shape[1] % 2)), mode="edge")
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) >> 2


def enlarge(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, ends on ends."""
    at = lambda n, m: np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
    y, x = at(plane.shape[0], h), at(plane.shape[1], w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, plane.shape[0] - 1), np.minimum(x0 + 1, plane.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = plane[y0][:, x0] * (1 - fx) + plane[y0][:, x1] * fx
    low = plane[y1][:, x0] * (1 - fx) + plane[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.int64)


def encode_lossy(rgb: np.ndarray, quality: int = 75, subsample: bool = False, options: Lossy = Lossy()) -> bytes:
    """Luma, then chroma planes, which may be told from the decoded luma."""
    luma, chroma = quant_table(quality), quant_table(chroma_quality(quality), True)
    y, cb, cr = to_ycbcr(rgb)
    coded = [encode_plane(y, luma, options)]
    reference = decode_plane(coded[0], luma)
    if subsample:
        cb, cr, reference = halve(cb), halve(cr), halve(reference)
    coded += [encode_plane(p, chroma, options, reference) for p in (cb, cr)]
    chunks = [("QMAT", K.quant_chunk(quality, [luma, chroma, chroma])), *zip(PLANES, coded, strict=True)]
    return K.pack(K.header(rgb.shape[1], rgb.shape[0], lossless=False, quality=quality, colorspace=0, subsampling=int(subsample)), chunks)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of container bytes, lossless or lossy by its flag."""
    head = K.parse_header(data)
    parts = [K.chunk(data, n) for n in PLANES]
    if any(p is None for p in parts):
        raise C.Damaged("a plane is missing")
    if head["flags"] & 1:
        return from_ycocg(*(decode_band(p) for p in parts))
    quant = K.chunk(data, "QMAT")
    if quant is None:
        raise C.Damaged("no quantiser tables")
    _, tables = K.parse_quant_chunk(quant)
    tables = tables * 3 if len(tables) == 1 else tables
    y = decode_plane(parts[0], tables[0])
    reference = halve(y) if head["subsampling"] else y
    cb, cr = (decode_plane(p, t, reference) for p, t in zip(parts[1:], tables[1:], strict=False))
    if head["subsampling"]:
        cb, cr = enlarge(cb, *y.shape), enlarge(cr, *y.shape)
    return from_ycbcr(y, cb, cr)


def info(data: bytes) -> dict[str, int]:
    return K.parse_header(data) | {f"bytes_{k}": n for k, _, n in K.directory(data)}


def psnr(a: np.ndarray, b: np.ndarray, exact: float = 99.0) -> float:
    error = float(np.mean((a.astype(float) - b.astype(float)) ** 2))
    return exact if error == 0 else 10 * np.log10(255**2 / error)


def quality_rows(rgb: np.ndarray, qualities: tuple[int, ...] = (50, 75, 90), options: Lossy = Lossy(), subsample: bool = False) -> list[tuple[int, int, float]]:
    """(quality, bytes, PSNR) of an image at each quality."""
    out = []
    for q in qualities:
        data = encode_lossy(rgb, q, subsample, options)
        out.append((q, len(data), float(psnr(rgb, decode(data)))))
    return out


def screen_comparison(rgb: np.ndarray, quality: int = 75) -> tuple[int, int, float, float]:
    """(bytes without and with palettes and copies, PSNR without and with)."""
    (_, plain, a), (_, screen, b) = (quality_rows(rgb, (quality,), Lossy(screen=on))[0] for on in (False, True))
    return plain, screen, a, b
