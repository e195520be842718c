"""Lossless coding of planes: routes, the low-byte chooser, containers.

The unit of work is a band of lines of a plane (image_id, plane, band), so a group is bounded
however tall an image is.  Each band is coded by up to three routes and the smallest is kept,
subject to the gates of the configuration.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.config import PHOTO, PRESETS, GlobalLz, LoModes, NaturalGate, Preset, RouteGates
from blockloom.functions.pixel import quotient
from blockloom.operators import codecs as C
from blockloom.plans import modes as M

BAND_LINES = 512
TILE, SCREEN, NATURAL = 0x54, 0xAD, 0xAE
#: Before the bytes of a route: which one it is, and the band's lines and columns.
PREFIX = struct.Struct("<BII")
LO_MODES = ("rans", "delta", "lz", "rows", "contexts", "lz_rans", "lz_streams", "contexts_mixed", "contexts_any")


def predictions(samples: np.ndarray, kind: int) -> np.ndarray:
    a = np.pad(samples, ((0, 0), (1, 0)))[:, :-1]
    b = np.pad(samples, ((1, 0), (0, 0)))[:-1]
    c = np.pad(samples, ((1, 0), (1, 0)))[:-1, :-1]
    cut = lambda v, n: np.trunc(v / n).astype(np.int64)
    if kind == 4:
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    if kind == 5:
        low, high = np.minimum(a, b), np.maximum(a, b)
        return np.where(c >= high, low, np.where(c <= low, high, a + b - c))
    return {0: np.zeros_like(samples), 1: a, 2: b, 3: cut(a + b, 2), 6: cut(3 * a + b, 4), 7: cut(a + 3 * b, 4)}[kind]


def row_filters(samples: np.ndarray, model: str, photo: bool = False) -> np.ndarray:
    """The predictor of each line over all its samples."""
    kinds, residuals = all_residuals(samples, photo)
    return line_filters(kinds, residuals, np.ones(samples.shape, bool), model)


def fold(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def unfold(u: np.ndarray) -> np.ndarray:
    return np.where(u % 2 == 0, u // 2, -((u + 1) // 2))


def delta(data: bytes) -> bytes:
    return np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).astype(np.uint8).tobytes()


def undelta(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def row_guess(line: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    left = np.concatenate([[0], line[:-1]])
    return {0: np.zeros_like(line), 1: left, 2: above, 3: (left + above) // 2}[kind]


def above_of(line: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The last non-empty line, cut or padded with zeros."""
    return np.concatenate([last[: len(line)], np.zeros(max(0, len(line) - len(last)), np.int64)])


def rows_encode(lines: list[np.ndarray]) -> bytes:
    """Each line less the better of none, left, up and average, with circular distances; the kinds lead."""
    kinds, out, last = [], [], np.zeros(0, np.int64)
    for line in (x.astype(np.int64) for x in lines if len(x)):
        above = above_of(line, last)
        parts = [(line - row_guess(line, above, k)) % 256 for k in range(4)]
        best = int(np.argmin([np.minimum(p, 256 - p).sum() for p in parts]))
        kinds.append(best)
        out.append(parts[best])
        last = line
    body = C.adaptive_encode(np.concatenate(out).astype(np.uint8).tobytes())
    return struct.pack("<I", len(kinds)) + C.pack_bits(kinds, 2) + body


def rows_decode(data: bytes, sizes: list[int]) -> bytes:
    (n,) = struct.unpack_from("<I", data)
    size = (2 * n + 7) // 8
    kinds = C.unpack_bits(data[4 : 4 + size], 2, n)
    d = np.frombuffer(C.adaptive_decode(data[4 + size :]), np.uint8).astype(np.int64)
    out, last, at = [], np.zeros(0, np.int64), 0
    for kind, width in zip(kinds, (x for x in sizes if x), strict=True):
        line, at = d[at : at + width], at + width
        above = above_of(line, last)
        if kind in (0, 2):
            line = (line + (above if kind == 2 else 0)) % 256
        elif kind == 1:
            line = np.cumsum(line) % 256
        else:
            left, got = 0, []
            for v, b in zip(line.tolist(), above.tolist(), strict=True):
                left = (v + (left + b) // 2) % 256
                got.append(left)
            line = np.array(got, np.int64)
        out.append(line)
        last = line
    return np.concatenate(out).astype(np.uint8).tobytes() if out else b""


def by_context(lines: list[np.ndarray], filters: np.ndarray) -> list[bytes]:
    """Six streams by the line's predictor (ids over 5 count as 0)."""
    context = np.where(filters > 5, 0, filters)
    return [b"".join(x.astype(np.uint8).tobytes() for x, c in zip(lines, context, strict=True) if c == k) for k in range(6)]


def from_contexts(parts: list[bytes], sizes: list[int], filters: np.ndarray) -> bytes:
    context, at, out = np.where(filters > 5, 0, filters).tolist(), [0] * 6, []
    for c, n in zip(context, sizes, strict=True):
        out.append(parts[c][at[c] : at[c] + n])
        at[c] += n
    return b"".join(out)


def context_sizes(sizes: list[int], filters: np.ndarray) -> list[int]:
    return np.bincount(np.where(filters > 5, 0, filters), sizes, 6).astype(int).tolist()


def contexts_encode(lines: list[np.ndarray], filters: np.ndarray) -> bytes:
    """Six streams by predictor, each coded alone."""
    parts = [C.adaptive_encode(x) if x else b"" for x in by_context(lines, filters)]
    return struct.pack("<6I", *map(len, parts)) + b"".join(parts)


def contexts_decode(data: bytes, filters: np.ndarray, sizes: list[int]) -> bytes:
    parts, pos = [], 24
    for size in struct.unpack_from("<6I", data):
        parts.append(C.adaptive_decode(data[pos : pos + size]) if size else b"")
        pos += size
    return from_contexts(parts, sizes, filters)


def contexts_choice(lines: list[np.ndarray], filters: np.ndarray, ways: tuple[str, ...]) -> bytes:
    """Six streams by predictor, each in the smallest of the given ways, which leads it."""
    out = b""
    for raw in by_context(lines, filters):
        best = min(((CONTEXT_WAYS.index(w), CODERS[w](raw)) for w in ways), key=lambda o: (len(o[1]), o[0])) if raw else (255, b"")
        out += struct.pack("<BI", best[0], len(best[1])) + best[1]
    return out


def contexts_choice_decode(data: bytes, filters: np.ndarray, sizes: list[int]) -> bytes:
    parts, pos = [], 0
    for n in context_sizes(sizes, filters):
        way, size = struct.unpack_from("<BI", data, pos)
        pos += 5
        parts.append(b"" if way == 255 else DECODERS[CONTEXT_WAYS[way]](data[pos : pos + size], n))
        pos += size
    return from_contexts(parts, sizes, filters)


CONTEXT_WAYS = ("adaptive", "shared", "delta", "lz")
CODERS: dict[str, Callable[[bytes], bytes]] = {
    "adaptive": C.adaptive_encode,
    "shared": lambda x: C.shared_encode(x, C.lz_model()),
    "delta": lambda x: C.adaptive_encode(delta(x)),
    "lz": lambda x: C.lz_compress(x),
}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {
    "adaptive": lambda x, _: C.adaptive_decode(x),
    "shared": lambda x, _: C.shared_decode(x, C.lz_model()),
    "delta": lambda x, _: undelta(C.adaptive_decode(x)),
    "lz": C.lz_decompress,
}


def lo_candidates(lines: list[np.ndarray], filters: np.ndarray, gates: LoModes = LoModes(), photo: bool = True, probe: bool = True) -> list[tuple[int, bytes]]:
    """(mode, payload) of every way to code the low bytes (of lines of any length) that the gates let in; ``probe``: LZ on a sample first."""
    raw = b"".join(x.astype(np.uint8).tobytes() for x in lines)
    out = [(0, C.adaptive_encode(raw)), (1, C.adaptive_encode(delta(raw)))]
    if not raw or (probe and not C.probe(raw)):
        return out
    lz = C.lz_compress(raw)
    out.append((2, lz))
    if photo and len(raw) > gates.compact_min_bytes:
        out.append((3, rows_encode(lines)))
        if len(raw) >= gates.contexts_min_raw:
            out.append((4, contexts_encode(lines, filters)))
    if len(raw) >= gates.lz_rans_min_raw:
        out.append((5, C.shared_encode(lz, C.lz_model())))
        out.append((6, C.token_streams_encode(raw)))
        if photo:
            out += [(7, contexts_choice(lines, filters, CONTEXT_WAYS[:2])), (8, contexts_choice(lines, filters, CONTEXT_WAYS))]
    return out


def choose(candidates: list[tuple[int, bytes]], permille: dict[int, int]) -> tuple[int, bytes]:
    """The first candidate, or a smaller one that also clears its mode's margin against the first."""
    mode, best = candidates[0]
    base = len(best)
    for m, payload in candidates[1:]:
        if len(payload) < len(best) and len(payload) * 1000 <= base * permille.get(m, 1000):
            mode, best = m, payload
    return mode, best


def lo_encode(lines: list[np.ndarray], filters: np.ndarray, gates: LoModes = LoModes(), probe: bool = False) -> bytes:
    permille = {1: gates.delta_permille, 4: gates.contexts_permille, 5: gates.lz_rans_permille, 6: gates.lz_rans_permille, 7: gates.contexts_permille, 8: gates.lz_rans_permille}
    mode, payload = choose(lo_candidates(lines, filters, gates, probe=probe), permille)
    return bytes((mode,)) + payload


def lo_decode(data: bytes, filters: np.ndarray, sizes: list[int]) -> np.ndarray:
    mode, body, n = data[0], data[1:], sum(sizes)
    if mode == 4:
        raw = contexts_decode(body, filters, sizes)
    elif mode == 3:
        raw = rows_decode(body, sizes)
    elif mode == 6:
        raw = C.token_streams_decode(body, n)
    elif mode in (7, 8):
        raw = contexts_choice_decode(body, filters, sizes)
    elif mode == 2:
        raw = C.lz_decompress(body, n)
    elif mode == 5:
        raw = C.lz_decompress(C.shared_decode(body, C.lz_model()), n)
    else:
        raw = C.adaptive_decode(body)
        raw = undelta(raw) if mode == 1 else raw
    if len(raw) != n:
        raise C.Damaged("low bytes don't fit")
    return np.frombuffer(raw, np.uint8).astype(np.int64)


def all_residuals(samples: np.ndarray, photo: bool = False) -> tuple[list[int], np.ndarray]:
    kinds = [k for k in range(8) if photo or k != 5]
    return kinds, np.stack([samples - predictions(samples, k) for k in kinds])


def line_entropy(r: np.ndarray) -> int:
    _, n = np.unique(r, return_counts=True)
    return int(round((n.sum() * np.log2(n.sum()) - (n * np.log2(n)).sum()) * 64))


def line_filters(kinds: list[int], residuals: np.ndarray, used: np.ndarray, model: str, photo: bool = False) -> np.ndarray:
    """The predictor of each line over its samples in use.

    By sums of magnitudes, by half bits, or the best two by half bits judged by entropy or by LZ cost.
    """
    if model == "sad":
        cost = (np.abs(residuals) * used[None]).sum(axis=2)
    else:
        cost = (M.half_bits(np.abs(residuals), photo) * used[None]).sum(axis=2)
    if model in ("entropy", "lzcost"):
        for y in np.flatnonzero(used.any(axis=1)):
            some = np.argsort(cost[:, y], kind="stable")[:2]
            parts = [residuals[k, y][used[y]] for k in some]
            fine = [line_entropy(r) if model == "entropy" else C.lz_row_cost((r & 255).astype(np.uint8).tobytes()) for r in parts]
            cost[min(zip(fine, some.tolist(), strict=True))[1], y] = -1
    return np.array(kinds)[cost.argmin(axis=0)]


def tile_parts(samples: np.ndarray, preset: Preset) -> tuple[M.Modes, np.ndarray, list[np.ndarray]]:
    """The blocks' modes, each line's predictor, and its folded residuals in blocks that are filtered."""
    kinds, residuals = all_residuals(samples)
    bits = np.stack([M.cells(M.half_bits(np.abs(r), False), 8).sum(axis=2) for r in residuals]).min(axis=0) + 10
    decided = M.decide(samples, bits)
    used = np.repeat(np.repeat(decided.kinds == M.FILTER, 8, axis=0), 8, axis=1)
    filters = line_filters(kinds, residuals, used, preset.row_cost)
    place = {k: i for i, k in enumerate(kinds)}
    return decided, filters, [fold(residuals[place[int(f)], y][used[y]]) for y, f in enumerate(filters)]


def tile_encode(samples: np.ndarray, preset: Preset) -> bytes:
    """Eight sizes, then predictors, low bytes, high bytes, block kinds, palettes, vectors and quadrants."""
    decided, filters, lines = tile_parts(M.padded(samples), preset)
    count = sum(map(len, lines))
    high = np.concatenate(lines) >> 8 if count else np.zeros(0, np.int64)
    quadrants = bytes(b for q in decided.quadrants for b in (q[0] | q[1] << 4, q[2] | q[3] << 4))
    parts = [
        C.smallest(filters.astype(np.uint8).tobytes(), 0xA9),
        lo_encode([x & 255 for x in lines], filters, probe=preset.probe_low_bytes) if count else b"",
        C.sparse_encode(high.astype(np.uint8).tobytes()) if count else b"",
        C.smallest(C.type_runs(decided.kinds.ravel().tolist()), 0xA6),
        C.smallest(C.palette_encode(decided.palettes), 0xA7) if decided.palettes else b"",
        C.smallest(C.copy_encode(decided.vectors), 0xA8) if decided.vectors else b"",
        C.smallest(quadrants, 0xA4) if quadrants else b"",
    ]
    sizes = [len(p) for p in parts]
    return struct.pack("<8I", *sizes[:3], count, *sizes[3:]) + b"".join(parts)


def tile_sizes(data: bytes) -> tuple[int, ...]:
    return struct.unpack_from("<8I", data)


def tile_decode(data: bytes, height: int, width: int) -> np.ndarray:
    sizes = tile_sizes(data)
    at, parts = 32, []
    for size in (*sizes[:3], *sizes[4:]):
        parts.append(data[at : at + size])
        at += size
    h, w = height + -height % 8, width + -width % 8
    filters = np.frombuffer(C.unwrapped(parts[0], 0xA9), np.uint8).astype(np.int64)
    kinds = np.array(C.from_type_runs(C.unwrapped(parts[3], 0xA6), h * w // 64)).reshape(h // 8, w // 8)
    used = np.repeat(np.repeat(kinds == M.FILTER, 8, axis=0), 8, axis=1)
    counts = used.sum(axis=1).tolist()
    if sum(counts) != sizes[3] or len(filters) != h:
        raise C.Damaged("kinds don't fit")
    folded = np.zeros(sizes[3], np.int64)
    if sizes[3]:
        folded = lo_decode(parts[1], filters, counts) | np.frombuffer(C.sparse_decode(parts[2], sizes[3]), np.uint8).astype(np.int64) << 8
    residuals = np.zeros((h, w), np.int64)
    residuals[used] = unfold(folded)
    if used.all():
        return C.unfilter(residuals, filters)[:height, :width]
    return rebuilt(residuals, filters, kinds, *placed_blocks(kinds, *parts[4:]))[:height, :width]


def placed_blocks(kinds: np.ndarray, palettes: bytes, vectors: bytes, quadrants: bytes) -> tuple[dict, dict]:
    """Blocks that are known at once, and by block the vector of each of its 4x4 quadrants."""
    where = lambda k: list(zip(*np.nonzero(kinds == k), strict=True))
    known, moved = {}, {}
    if spots := where(M.PALETTE):
        for spot, (colors, index) in zip(spots, C.palette_decode(C.unwrapped(palettes, 0xA7)), strict=True):
            known[spot] = np.array(colors)[index].reshape(8, 8)
    if spots := where(M.COPY):
        for spot, vector in zip(spots, C.copy_decode(C.unwrapped(vectors, 0xA8), len(spots)), strict=True):
            moved[spot] = [vector] * 4
    if spots := where(M.QUADRANTS):
        raw = C.unwrapped(quadrants, 0xA4)
        for k, spot in enumerate(spots):
            a, b = raw[2 * k], raw[2 * k + 1]
            moved[spot] = [M.QUADRANT_VECTORS[c] for c in (a & 15, a >> 4, b & 15, b >> 4)]
    return known, moved


def rebuilt(residuals: np.ndarray, filters: np.ndarray, kinds: np.ndarray, known: dict, moved: dict) -> np.ndarray:
    """Samples line by line, each block's part of a line in its own way; all that a sample needs lies before it."""
    h, w = residuals.shape
    out = np.zeros((h + 1, w + 1), np.int64)  # a line and a column of zeros before
    for y in range(h):
        line, up, kind = out[y + 1], out[y], int(filters[y])
        for bx in range(w // 8):
            spot, x = (y // 8, bx), bx * 8
            if spot in known:
                line[x + 1 : x + 9] = known[spot][y % 8]
            elif spot in moved:
                for half in (0, 4):
                    dx, dy = moved[spot][y % 8 // 4 * 2 + half // 4]
                    from_ = x + half + dx + 1
                    line[x + half + 1 : x + half + 5] = out[y + dy + 1, from_ : from_ + 4]
            else:
                guess_line(line, up, residuals[y, x : x + 8], x, kind)
    return out[1:, 1:]


def guess_line(line: np.ndarray, up: np.ndarray, residuals: np.ndarray, x: int, kind: int) -> None:
    if kind in (0, 2):
        line[x + 1 : x + 9] = residuals + (up[x + 1 : x + 9] if kind else 0)
        return
    a, above = int(line[x]), up[x : x + 9].tolist()
    for k, r in enumerate(residuals.tolist()):
        c, b = above[k], above[k + 1]
        a = r + C.guess(kind, a, b, c)
        line[x + k + 1] = a


def screen_encode(samples: np.ndarray, most: int = 64) -> bytes | None:
    """A palette of all values (by frequency, then value) and packed indices; None for too many values."""
    values, index, counts = np.unique(samples, return_inverse=True, return_counts=True)
    if len(values) > most:
        return None
    order = np.lexsort((values, -counts))
    rank = np.argsort(order)
    packed = C.pack_bits(rank[index.ravel()].tolist(), (len(values) - 1).bit_length())
    body = C.smallest(packed, 0xAD, permille=1000) if packed else b""
    return bytes((SCREEN,)) + struct.pack("<IIHI", *samples.shape, len(values), len(packed)) + values[order].astype("<i2").tobytes() + body


def screen_decode(data: bytes) -> np.ndarray:
    h, w, n, size = struct.unpack_from("<IIHI", data, 1)
    values = np.frombuffer(data, "<i2", n, 15).astype(np.int64)
    packed = C.unwrapped(data[15 + 2 * n :], 0xAD) if size else b""
    return values[np.array(C.unpack_bits(packed, (n - 1).bit_length(), h * w))].reshape(h, w)


#: Predictors of a natural line by id: left, up, average, Paeth, median, and the two weighted ones (fixed order).
NATURAL_KINDS = (1, 2, 3, 4, 5, 6, 7)


def interleaved(u: np.ndarray) -> bytes:
    return u.astype("<u2").tobytes()


def natural_lines(samples: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each line's predictor id and residuals.  The first mode knows three, and judges them as if nothing lay to the left."""
    if few:
        up = np.pad(samples, ((1, 0), (0, 0)))[:-1]
        cost = np.stack([np.abs(samples - g).sum(axis=1) for g in (0, up, np.trunc(up / 2).astype(np.int64))])
    else:
        cost = np.stack([np.abs(samples - predictions(samples, k)).sum(axis=1) for k in NATURAL_KINDS])
    ids = cost.argmin(axis=0)
    every = np.stack([samples - predictions(samples, NATURAL_KINDS[k]) for k in range(len(cost))])
    return ids, np.take_along_axis(every, ids[None, :, None], axis=0)[0]


def natural_modes(samples: np.ndarray, preset: Preset) -> list[tuple[int, bytes]]:
    """(mode, payload) of the ways to code a band by lines: 0 three predictors and LZ, 1 all of them, 2 with a global search, 3 in two contexts."""
    padded = M.padded(samples)
    head = lambda mode, n, a, b: struct.pack("<BBIIII", NATURAL, mode, padded.size, n, a, b)
    ids, residuals = natural_lines(padded, True)
    raw = interleaved(fold(residuals))
    body = C.shared_encode(C.lz_compress(raw), C.lz_model())
    out = [(0, head(0, len(ids), len(raw), len(body)) + ids.astype(np.uint8).tobytes() + body)]

    ids, residuals = natural_lines(padded, False)
    u = fold(residuals)
    raw, plain = interleaved(u), ids.astype(np.uint8).tobytes()
    coded = C.adaptive_encode(plain)
    packed = (1, coded) if len(coded) < len(plain) else (0, plain)
    names = struct.pack("<BII", packed[0], len(ids), len(packed[1])) + packed[1]
    params = GlobalLz(nice_length=preset.nice_length)
    search = C.lz_optimal(raw, params) if preset.search == "optimal" else C.lz_global(raw, params, lazy=preset.search == "lazy")
    for mode, lz in ((1, C.lz_compress(raw)), (2, search)):
        body = C.shared_encode(lz, C.lz_model())
        out.append((mode, head(mode, len(ids), len(raw), len(body)) + names + body))
    edge = edges(padded)
    flat, rough = (C.adaptive_encode(interleaved(u[edge == k])) for k in (0, 1))
    out.append((3, head(3, len(ids), len(flat), len(rough)) + names + flat + rough))
    return out


def edges(samples: np.ndarray, limit: int = 16) -> np.ndarray:
    """1 where a gradient at the upper-left neighbour is large, 0 elsewhere."""
    a = np.pad(samples, ((0, 0), (1, 0)))[:, :-1]
    b = np.pad(samples, ((1, 0), (0, 0)))[:-1]
    c = np.pad(samples, ((1, 0), (1, 0)))[:-1, :-1]
    return (np.maximum(np.abs(a - c), np.abs(b - c)) >= limit).astype(np.int64)


def natural_encode(samples: np.ndarray, preset: Preset, bias_permille: int = 990) -> bytes:
    """The smallest mode; that of the global search must win by its margin."""
    best = b""
    for mode, payload in natural_modes(samples, preset):
        if not best or (len(payload) * 1000 <= len(best) * bias_permille if mode == 2 else len(payload) < len(best)):
            best = payload
    return best


def natural_decode(data: bytes, height: int, width: int) -> np.ndarray:
    h, w = height + -height % 8, width + -width % 8
    _, mode, pixels, lines, first, second = struct.unpack_from("<BBIIII", data)
    if mode > 3 or pixels != h * w or lines != h:
        raise C.Damaged("natural band")
    at = 18
    if mode == 0:
        ids, at = np.frombuffer(data, np.uint8, lines, at), at + lines
    else:
        packed, _, size = struct.unpack_from("<BII", data, at)
        ids = data[at + 9 : at + 9 + size]
        ids, at = np.frombuffer(C.adaptive_decode(ids) if packed else ids, np.uint8), at + 9 + size
    if len(ids) != h or ids.max(initial=0) >= len(NATURAL_KINDS):
        raise C.Damaged("predictors")
    filters = np.array(NATURAL_KINDS)[ids]
    if mode == 3:
        flat, rough = (np.frombuffer(C.adaptive_decode(x), "<u2").astype(np.int64) for x in (data[at : at + first], data[at + first : at + first + second]))
        return by_contexts(unfold(flat).tolist(), unfold(rough).tolist(), filters, h, w)[:height, :width]
    raw = C.lz_decompress(C.shared_decode(data[at : at + second], C.lz_model()), first)
    return C.unfilter(unfold(np.frombuffer(raw, "<u2").astype(np.int64)).reshape(h, w), filters)[:height, :width]


def by_contexts(flat: list[int], rough: list[int], filters: np.ndarray, h: int, w: int, limit: int = 16) -> np.ndarray:
    """Samples from residuals that are dealt over two streams by the gradient at the upper-left neighbour."""
    out, up, streams = np.zeros((h, w), np.int64), [0] * w, (iter(flat), iter(rough))
    for y, kind in enumerate(filters.tolist()):
        a = c = 0
        line = []
        for b in up:
            a = next(streams[max(abs(a - c), abs(b - c)) >= limit]) + C.guess(kind, a, b, c)
            c = b
            line.append(a)
        out[y], up = line, line
    return out


def preflight(samples: np.ndarray, cap: int = 192) -> dict[str, int]:
    """Distinct sampled values, and mean run, mean difference and run density times 100; the array form of ``operators.planes.preflight``."""
    h, w = samples.shape
    unique = min(len(np.unique(samples[:: max(1, h // 64), :: max(1, w // 64)])), cap + 1)
    lines = samples[:: max(1, h // max(1, min(h, 32)))]
    steps = np.abs(np.diff(lines, axis=1))
    runs, hundred = len(lines) + int((steps > 0).sum()), lambda a, b: min(65535, int(np.floor(100 * a / b + 0.5))) if b else 0
    return {"unique": unique, "run": hundred(lines.size, runs), "difference": hundred(int(steps.sum()), steps.size), "entropy": hundred(runs, lines.size)}


def likely_screen(m: dict[str, int]) -> bool:
    return (m["unique"] <= 48 or (m["unique"] <= 96 and m["run"] >= 280)) and not (m["difference"] >= 2200 and m["unique"] > 96)


def natural_like(m: dict[str, int], gate: NaturalGate) -> bool:
    return not likely_screen(m) and m["unique"] >= gate.unique_min and m["run"] <= gate.avg_run_max and m["difference"] >= gate.mean_diff_min and m["entropy"] >= gate.entropy_min


def tried(m: dict[str, int], pixels: int, profile: int, gates: RouteGates) -> tuple[bool, bool]:
    """Whether the screen and the natural route are tried."""
    if gates.always:
        return True, True
    natural = natural_like(m, gates.natural)
    screen = pixels >= gates.screen_min_pixels and likely_screen(m) and not (natural and profile == PHOTO)
    return screen, pixels >= gates.natural_min_pixels and natural and m["unique"] >= gates.natural_min_unique


def routes(samples: np.ndarray, preset: Preset, gates: RouteGates, chroma: bool = False) -> list[tuple[int, bytes]]:
    """(route, payload): that of tiles, and the others that the preset and a cheap look at the band let in."""
    out = [(TILE, tile_encode(samples, preset))]
    if not (preset.chroma_routes if chroma else preset.luma_routes):
        return out
    m = preflight(samples)
    grid = M.cells(M.padded(samples), 8)
    profile = M.profile_of(grid, M.first_match(grid, [(x // 8, y // 8) for x, y in M.SMALL_VECTORS]))
    if chroma and not gates.always:
        if profile == PHOTO and not preset.photo_chroma_routes:
            return out
        if preset.careful_chroma and (m["difference"] > gates.chroma.mean_diff_max or m["run"] < gates.chroma.avg_run_min):
            return out
    try_screen, try_natural = tried(m, samples.size, profile, gates)
    base = len(out[0][1])
    if try_screen and (screen := screen_encode(samples, gates.screen_max_colors)) is not None and len(screen) * 1000 <= base * gates.screen_permille[profile]:
        out.append((SCREEN, screen))
    if try_natural and len(natural := natural_encode(samples, preset)) <= base:
        out.append((NATURAL, natural))
    return out


def encode_band(samples: np.ndarray, preset: Preset = PRESETS["balanced"], gates: RouteGates = RouteGates(), chroma: bool = False) -> bytes:
    """The route's number, the band's size, and the bytes of the smallest route; the first of equal ones."""
    samples = samples.astype(np.int64)
    return with_size(samples, *min(routes(samples, preset, gates, chroma), key=lambda r: len(r[1])))


def with_size(samples: np.ndarray, route: int, payload: bytes) -> bytes:
    return PREFIX.pack(route, *samples.shape) + payload


def decode_band(data: bytes) -> np.ndarray:
    if len(data) < PREFIX.size or data[0] not in (TILE, SCREEN, NATURAL):
        raise C.Damaged("unknown route")
    route, height, width = PREFIX.unpack_from(data)
    decode = {TILE: tile_decode, SCREEN: lambda x, *_: screen_decode(x), NATURAL: natural_decode}[route]
    return decode(data[PREFIX.size :], height, width)


def decode_band_or_zeros(data: bytes, height: int, width: int) -> np.ndarray:
    """Lenient: anything that can't be decoded is a band of zeros."""
    try:
        got = decode_band(data)
    except (C.Damaged, struct.error, ValueError, IndexError):
        return np.zeros((height, width), np.int64)
    return got if got.shape == (height, width) else np.zeros((height, width), np.int64)


def encode_planes(plane: DataFrame, preset: str = "balanced", band_lines: int = BAND_LINES, gates: RouteGates = RouteGates(), code: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """(image_id, band, payload) of lines (image_id, y, row)."""
    plan = PRESETS[preset]

    def each(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("y").to_numpy(), kind="stable")
        rows = table.column("row").to_pylist()
        samples = np.array([rows[k] for k in order], np.int64)
        payload = code(samples) if code else encode_band(samples, plan, gates)
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "band": table.column("band").slice(0, 1), "payload": pa.array([payload], pa.binary())})

    bands = plane.select("image_id", quotient(F.col("y"), band_lines).alias("band"), "y", "row")
    return bands.groupBy("image_id", "band").applyInArrow(each, "image_id string, band long, payload binary")


def decode_planes(coded: DataFrame, band_lines: int = BAND_LINES) -> DataFrame:
    """(image_id, y, row) of (image_id, band, payload)."""

    def each(batches):
        for batch in batches:
            for image, band, payload in zip(*(batch.column(c).to_pylist() for c in ("image_id", "band", "payload")), strict=True):
                lines = decode_band(bytes(payload))
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(lines), pa.string()), pa.array(band * band_lines + np.arange(len(lines))), pa.array(lines.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["image_id", "y", "row"])

    return coded.select("image_id", "band", "payload").mapInArrow(each, "image_id string, y long, row array<int>")
