"""Lossy coding of a plane: blocks by transform, palette or copy, chroma from luma, adaptive quantisers, bands, restart points."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from blockloom.functions.block import LOW_END, MID_END, band_range, dct_basis, inverse_dct, zigzag_order
from blockloom.operators import codecs as C
from blockloom.operators.search import nearest_copy
from blockloom.plans.modes import MOST_COLORS, cells, padded, palette_of

ZIGZAG = np.array(zigzag_order())
BASIS = np.array(dct_basis())
TRANSFORM, PALETTE, COPY = range(3)
#: What a fit of chroma on luma must save, and the least variance (times 64) of luma that is fitted.
CFL_GAIN, CFL_VARIANCE = 1024, 1024
#: A band's stream gets restart points from so many bytes on.
RESTART_BYTES = 32 * 1024
NAMES = ("dc", "low", "mid", "high", "restarts", "deltas", "cfl", "kinds", "palettes", "vectors")


@dataclass(frozen=True)
class Lossy:
    """What the coder may use."""

    cfl: bool = True
    adaptive: bool = False
    screen: bool = False
    restarts: bool = True
    search_radius: int = 64


def tiles(plane: np.ndarray) -> np.ndarray:
    """Blocks (n, 64) of a plane padded by its edges."""
    return cells(padded(plane), 8).reshape(-1, 64)


def untiled(blocks: np.ndarray, h: int, w: int) -> np.ndarray:
    rows, cols = -(-h // 8), -(-w // 8)
    return blocks.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)[:h, :w]


def transform(blocks: np.ndarray) -> np.ndarray:
    """Two integer passes, each rounded at 13 bits."""
    x = blocks.reshape(-1, 8, 8)
    rows = (np.einsum("kn,byn->byk", BASIS, x) + 4096) >> 13
    return ((np.einsum("ky,byx->bkx", BASIS, rows) + 4096) >> 13).reshape(-1, 64)


# ---- chroma from luma


def cfl_fit(luma: np.ndarray, chroma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha in 64ths, beta, adopted) of each block: integer least squares, adopted where it saves enough."""
    n = luma.shape[1]
    sy, sc = luma.sum(axis=1), chroma.sum(axis=1)
    var, cov = (luma * luma).sum(axis=1) * n - sy * sy, (luma * chroma).sum(axis=1) * n - sy * sc
    cut = lambda a, b: (np.abs(a) // b) * np.sign(a)
    low = var < CFL_VARIANCE
    alpha = np.where(low, 0, np.clip(cut(cov * 256 + (var >> 1), np.maximum(var, 1)), -255, 255))
    beta = np.where(low, (sc + n // 2) // n, np.clip(cut(sc * 256 - alpha * (sy - n * 128) + n * 128, n * 256), 0, 255))
    sixty_fourths = (np.sign(alpha) * ((np.abs(alpha) + 2) // 4)).astype(np.int64)
    fitted = np.clip(cfl_guess(luma, sixty_fourths, beta), 0, 255)
    saved = ((chroma - 128) ** 2).sum(axis=1) - ((chroma - fitted) ** 2).sum(axis=1)
    return sixty_fourths, beta, saved > CFL_GAIN


def cfl_guess(luma: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return ((alpha[:, None] * (luma - 128) + 32) >> 6) + beta[:, None]


# ---- quantisers


def deltas_of(c: np.ndarray) -> np.ndarray:
    """Each block's quantiser step: the square root of its activity against the mean, as a signed byte in 50ths."""
    activity = np.abs(c[:, 1:]).sum(axis=1).astype(np.float32)
    mean = activity.sum() / max(1, len(c))
    scale = np.ones(len(c)) if mean < 1e-6 else np.sqrt(activity / mean)
    return np.clip((scale - 1.0) * 50.0, -127, 127).astype(np.int8)


def quantisers(table: list[int], deltas: np.ndarray | None, n: int) -> np.ndarray:
    """The quantisers of each block in zigzag order."""
    q = np.array(table)[ZIGZAG][None].repeat(n, 0)
    if deltas is None:
        return q
    return np.maximum(1, np.floor(q * (1 + deltas.astype(float) / 50.0)[:, None] + 0.5)).astype(np.int64)


# ---- tokens


def value_token(v: int) -> tuple[int, int, int]:
    size = min(11, abs(v).bit_length())
    return (64, 0, 0) if v == 0 else (64 + size, (v < 0) << size | abs(v) - (1 << size - 1), size + 1)


def token_value(token: tuple[int, int, int]) -> int:
    size = token[0] - 64
    if size <= 0:
        return 0
    magnitude = (1 << size - 1) + (token[1] & (1 << size) - 1)
    return -magnitude if token[1] >> size & 1 else magnitude


def block_tokens(q: np.ndarray) -> list[tuple[int, int, int]]:
    """Zero runs and values of some of a block's coefficients; an end mark where the rest is zero."""
    out, last = [], -1
    for k in np.flatnonzero(q).tolist():
        out += [(k - last - 1, 0, 0), value_token(int(q[k]))]
        last = k
    return out if last == len(q) - 1 else [*out, (63, 0, 0)]


def from_block_tokens(tokens: list[tuple[int, int, int]], n: int, size: int) -> np.ndarray:
    """(n, size) coefficients."""
    out = np.zeros((n, size), np.int64)
    block, place = 0, 0
    for t in tokens:
        if block >= n:
            raise C.Damaged("too many tokens")
        if t[0] < 63:
            place += t[0]
        elif t[0] > 63:
            if place >= size:
                raise C.Damaged("beyond the band")
            out[block, place] = token_value(t)
            place += 1
        if t[0] == 63 or place == size:
            block, place = block + 1, 0
    return out


def bands(low_end: int = LOW_END, mid_end: int = MID_END) -> list[slice]:
    """The places of the three bands among the 64 coefficients."""
    return [slice(1 + start, 1 + start + size) for start, size in (band_range(k, low_end, mid_end) for k in (1, 2, 3))]


def restart_blob(stream: bytes) -> bytes:
    """The restart points of a token stream: [count] and for each its byte, token and states."""
    count, payload, freq = C.token_types(stream)
    points = C.restart_points(payload, count, freq, C.restart_interval(count, len(payload)))
    return struct.pack("<I", len(points)) + b"".join(struct.pack("<II8I", p.byte, p.token, *p.states) for p in points)


def types_from_restarts(stream: bytes, blob: bytes) -> list[int]:
    """The token types of a stream, part by part; the parts need nothing of each other."""
    count, payload, freq = C.token_types(stream)
    points = [C.RestartPoint(b, t, list(states)) for b, t, *states in struct.iter_unpack("<II8I", blob[4:])]
    ends = [p.token for p in points[1:]] + [count]
    return [s for p, end in zip(points, ends, strict=True) for s in C.decode_part(payload, p, end - p.token, freq)]


# ---- planes


def block_kinds(plane: np.ndarray, blocks: np.ndarray, options: Lossy) -> tuple[np.ndarray, list, list]:
    """The kind of each block, palettes with indices, and vectors of copies."""
    kinds = np.full(len(blocks), TRANSFORM)
    palettes, vectors = [], []
    if options.screen:
        whole = padded(plane)
        for k in range(len(blocks)):
            dx, dy, sad = nearest_copy(whole, k // (whole.shape[1] // 8), k % (whole.shape[1] // 8), options.search_radius)
            if sad == 0:
                kinds[k] = COPY
                vectors.append((dx, dy))
            elif len(np.unique(blocks[k])) <= MOST_COLORS:
                kinds[k] = PALETTE
                palettes.append(palette_of(blocks[k]))
    return kinds, palettes, vectors


def encode_plane(plane: np.ndarray, table: list[int], options: Lossy = Lossy(), luma: np.ndarray | None = None) -> bytes:
    """[height][width][ten sizes] and the streams of NAMES; ``luma``: the decoded luma plane of the same size, for chroma."""
    blocks = tiles(plane.astype(np.int64))
    kinds, palettes, vectors = block_kinds(plane.astype(np.int64), blocks, options)
    own = kinds == TRANSFORM
    residual, cfl = blocks - 128, b""
    if luma is not None and options.cfl:
        reference = tiles(luma.astype(np.int64))
        alpha, beta, adopted = cfl_fit(reference, blocks)
        adopted &= own
        residual = np.where(adopted[:, None], np.clip(blocks - cfl_guess(reference, alpha, beta), -128, 127), residual)
        cfl = C.cfl_encode([(int(a), int(b), bool(x)) if x else (0, 128, False) for a, b, x in zip(alpha, beta, adopted, strict=True)])
    c = transform(residual[own])[:, ZIGZAG]
    deltas = deltas_of(c) if options.adaptive else None
    q = quantisers(table, deltas, len(c))
    k = np.sign(c) * ((np.abs(c) + q // 2) // q)
    streams = [C.tokens_encode([value_token(int(v)) for v in np.diff(k[:, 0], prepend=0)])]
    streams += [C.tokens_encode([t for row in k[:, part] for t in block_tokens(row)]) for part in bands()]
    blobs = [restart_blob(s) if options.restarts and len(s) >= RESTART_BYTES else b"" for s in streams[1:]]
    parts = [
        *streams,
        struct.pack("<3I", *map(len, blobs)) + b"".join(blobs) if any(blobs) else b"",
        deltas.tobytes() if deltas is not None else b"",
        cfl,
        C.type_runs(kinds.tolist()) if not own.all() else b"",
        C.smallest(C.palette_encode(palettes), 0xA7) if palettes else b"",
        b"".join(struct.pack("<hh", *v) for v in vectors),
    ]
    return struct.pack("<12I", *plane.shape, *map(len, parts)) + b"".join(parts)


def stream_sizes(data: bytes) -> dict[str, int]:
    """Bytes of each stream of a coded plane."""
    return dict(zip(NAMES, struct.unpack_from("<10I", data, 8), strict=True))


def decode_plane(data: bytes, table: list[int], luma: np.ndarray | None = None) -> np.ndarray:
    h, w, *sizes = struct.unpack_from("<12I", data)
    ends = 48 + np.cumsum([0, *sizes])
    if ends[-1] > len(data):
        raise C.Damaged("streams are cut off")
    part = {name: data[a:b] for name, a, b in zip(NAMES, ends[:-1], ends[1:], strict=True)}
    n = -(-h // 8) * -(-w // 8)
    kinds = np.array(C.from_type_runs(part["kinds"], n)) if part["kinds"] else np.full(n, TRANSFORM)
    own = kinds == TRANSFORM
    count = int(own.sum())
    blobs = [b"", b"", b""]
    if part["restarts"]:
        at = 12 + np.cumsum([0, *struct.unpack_from("<3I", part["restarts"])])
        blobs = [part["restarts"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    k = np.zeros((count, 64), np.int64)
    k[:, 0] = np.cumsum([token_value(t) for t in C.tokens_decode(part["dc"])])
    for name, where, blob in zip(("low", "mid", "high"), bands(), blobs, strict=True):
        types = types_from_restarts(part[name], blob) if blob else None
        k[:, where] = from_block_tokens(C.tokens_decode(part[name], types=types), count, where.stop - where.start)
    deltas = np.frombuffer(part["deltas"], np.int8) if part["deltas"] else None
    raster = np.zeros_like(k)
    raster[:, ZIGZAG] = k * quantisers(table, deltas, count)
    blocks = np.zeros((n, 64), np.int64)
    blocks[own] = inverse_dct(raster)
    center = np.full((n, 64), 128)
    if part["cfl"] and luma is not None:
        alpha, beta, adopted = (np.array(x) for x in zip(*C.cfl_decode(part["cfl"]), strict=True))
        center = np.where(adopted.astype(bool)[:, None], cfl_guess(tiles(luma.astype(np.int64)), alpha, beta), center)
    blocks[own] = np.clip(blocks[own] + center[own], 0, 255)
    if (kinds == PALETTE).any():
        found = C.palette_decode(C.unwrapped(part["palettes"], 0xA7))
        blocks[kinds == PALETTE] = [np.array(colors)[index] for colors, index in found]
    out = untiled(blocks, h + -h % 8, w + -w % 8).copy()
    columns = out.shape[1] // 8
    for spot, (dx, dy) in zip(np.flatnonzero(kinds == COPY).tolist(), struct.iter_unpack("<hh", part["vectors"]), strict=True):
        y, x = spot // columns * 8, spot % columns * 8
        out[y : y + 8, x : x + 8] = out[y + dy : y + dy + 8, x + dx : x + dx + 8]
    return out[:h, :w]
