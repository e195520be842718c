"""Byte-stream codecs: range coding, Lempel-Ziv, bit packing, wrappers.

Plain functions on bytes; ``map_streams`` applies one to every stream of a DataFrame in Arrow
batches.  They are sequential by nature, so parallelism is by stream (or by restart point).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from blockloom.operators import lanes as many
from blockloom.operators.joined import Tokens, batches, lz_compress_many, lz_decompress_many, lz_optimal_many, rebuilt_many  # noqa: F401
from blockloom.operators.lz import Damaged, common, literals, lz_compress, lz_decompress, lz_expand, lz_global, lz_optimal, lz_tokens  # noqa: F401

# ---- range asymmetric numeral systems, 12-bit totals

TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS
LOWER = 1 << 16
LANES = 8


def model(counts: Iterable[int]) -> np.ndarray:
    """Frequencies that add up to 4096, each at least 1: scaled with rounding; what is too much is
    taken one by one in symbol order, what lacks goes to the first largest."""
    raw = np.asarray(list(counts), np.int64)
    whole = int(raw.sum())
    freq = np.maximum(1, (raw * TOTAL + whole // 2) // max(whole, 1))
    over = int(freq.sum()) - TOTAL
    while over > 0:
        can = np.flatnonzero(freq > 1)[:over]
        freq[can] -= 1
        over -= len(can)
    if over < 0:
        freq[int(freq.argmax())] -= over
    return freq


def laplace(data: bytes, symbols: int = 256) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=symbols) + 1


def rans_encode(symbols: Iterable[int], freq: np.ndarray, lanes: int = LANES) -> bytes:
    """All symbols, last first, dealt over ``lanes`` states that share one byte stream; the states lead it."""
    f, low = freq.tolist(), np.concatenate([[0], np.cumsum(freq)]).tolist()
    items = list(symbols)
    states, out = [LOWER] * lanes, bytearray()
    for k in range(len(items) - 1, -1, -1):
        s = items[k]
        x, n = states[k % lanes], f[s]
        while x >= n << 12:
            out.append(x & 255)
            x >>= 8
        states[k % lanes] = (x // n << TOTAL_BITS) + x % n + low[s]
    for x in reversed(states):
        out += struct.pack("<I", x)
    out.reverse()
    return bytes(out)


def slots(freq: np.ndarray) -> np.ndarray:
    """The symbol of each of the 4096 slots."""
    return np.repeat(np.arange(len(freq)), freq)


def rans_decode(data: bytes, count: int, freq: np.ndarray, lanes: int = LANES, start: int = 0, states: list[int] | None = None, lane: int = 0) -> list[int]:
    if states is None:
        if len(data) < 4 * lanes:
            raise Damaged("states are cut off")
        states, start = list(struct.unpack(f">{lanes}I", data[: 4 * lanes])), 4 * lanes
    table, width, offset = decode_tables(freq)
    states, out, pos, size = list(states), [], start, len(data)
    for _ in range(count):
        x = states[lane]
        slot = x & (TOTAL - 1)
        x = width[slot] * (x >> TOTAL_BITS) + offset[slot]
        while x < LOWER:
            if pos >= size:
                raise Damaged("bytes are cut off")
            x = x << 8 | data[pos]
            pos += 1
        states[lane] = x
        out.append(table[slot])
        lane = (lane + 1) % lanes
    return out


def decode_tables(freq: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """By slot: the symbol, its frequency, and the slot's place within the symbol."""
    table = slots(freq)
    return table.tolist(), freq[table].tolist(), (np.arange(len(table)) - (np.cumsum(freq) - freq)[table]).tolist()


@dataclass
class RestartPoint:
    byte: int
    token: int
    states: list[int]


def restart_interval(tokens: int, stream_bytes: int, lanes: int = LANES) -> int:
    """Tokens between restart points such that they cost one or two percent; a multiple of the lanes in 64..4096."""
    points = max(1, (stream_bytes // 64 - 12) // 40)
    return max(64, min(4096, -(-tokens // points) // lanes * lanes or lanes))


def restart_points(data: bytes, count: int, freq: np.ndarray, interval: int, lanes: int = LANES) -> list[RestartPoint]:
    """Where a decoder could start every ``interval`` tokens (a multiple of the lanes)."""
    _, width, offset = decode_tables(freq)
    states, pos, out = list(struct.unpack(f">{lanes}I", data[: 4 * lanes])), 4 * lanes, []
    for k in range(count):
        if k % interval == 0:
            out.append(RestartPoint(pos, k, list(states)))
        x = states[k % lanes]
        slot = x & (TOTAL - 1)
        x = width[slot] * (x >> TOTAL_BITS) + offset[slot]
        while x < LOWER:
            x = x << 8 | data[pos]
            pos += 1
        states[k % lanes] = x
    return out


def decode_part(data: bytes, point: RestartPoint, count: int, freq: np.ndarray, lanes: int = LANES) -> list[int]:
    return rans_decode(data, count, freq, lanes, point.byte, point.states, point.token % lanes)


def adaptive_encode(data: bytes) -> bytes:
    """[1024][256 frequencies][count][size][payload], numbers little-endian."""
    freq = model(laplace(data))
    payload = rans_encode(data, freq)
    return struct.pack("<I", 1024) + freq.astype("<u4").tobytes() + struct.pack("<II", len(data), len(payload)) + payload


def adaptive_decode(data: bytes) -> bytes:
    if len(data) < 1036 or struct.unpack_from("<I", data)[0] != 1024:
        raise Damaged("no model")
    freq = np.frombuffer(data, "<u4", 256, 4).astype(np.int64)
    count, size = struct.unpack_from("<II", data, 1028)
    if freq.sum() != TOTAL or size > len(data) - 1036:
        raise Damaged("model or payload don't fit")
    return bytes(rans_decode(data[1036 : 1036 + size], count, freq))


def adaptive_encode_many(streams: list[bytes]) -> list[bytes]:
    """adaptive_encode() of each stream, all at once."""
    out: list[bytes] = []
    for part in many.batches([len(x) for x in streams]):
        data = [np.frombuffer(streams[k], np.uint8) for k in part]
        freqs = many.models(np.stack([np.bincount(x, minlength=256) + 1 for x in data]))
        coded = many.encode_many(data, freqs)
        out += [struct.pack("<I", 1024) + f.astype("<u4").tobytes() + struct.pack("<II", len(x), len(c)) + c for x, f, c in zip(data, freqs, coded, strict=True)]
    return out


def adaptive_decode_many(streams: list[bytes]) -> list[bytes | None]:
    """adaptive_decode() of each stream, all at once; None for damaged ones."""
    out: list[bytes | None] = []
    for part in many.batches([struct.unpack_from("<I", x, 1028)[0] if len(x) >= 1036 else 0 for x in streams]):
        some = [streams[k] if len(streams[k]) >= 1036 and streams[k][:4] == b"\0\4\0\0" else b"" for k in part]
        plain = b"\x10\0\0\0" * 256
        freqs = np.stack([np.frombuffer(x[4:1028] if x else plain, "<u4") for x in some]).astype(np.int64)
        heads = [struct.unpack_from("<II", x, 1028) if x else (0, 0) for x in some]
        whole = (freqs.sum(axis=1) == TOTAL) & np.array([bool(x) and size <= len(x) - 1036 for x, (_, size) in zip(some, heads, strict=True)])
        freqs[~whole] = 16
        got = many.decode_many([x[1036 : 1036 + size] if ok else b"" for x, (_, size), ok in zip(some, heads, whole, strict=True)], np.array([n if ok else 0 for (n, _), ok in zip(heads, whole, strict=True)]), freqs)
        out += [x.astype(np.uint8).tobytes() if ok and x is not None else None for x, ok in zip(got, whole, strict=True)]
    return out


def shared_encode(data: bytes, freq: np.ndarray) -> bytes:
    payload = rans_encode(data, freq)
    return struct.pack("<II", len(data), len(payload)) + payload


def shared_decode(data: bytes, freq: np.ndarray) -> bytes:
    if len(data) < 8:
        raise Damaged("no header")
    count, size = struct.unpack_from("<II", data)
    if size > len(data) - 8:
        raise Damaged("payload is cut off")
    return bytes(rans_decode(data[8 : 8 + size], count, freq))


def shared_encode_many(streams: list[bytes], freq: np.ndarray) -> list[bytes]:
    """shared_encode() of each stream, all at once."""
    out: list[bytes] = []
    for part in many.batches([len(x) for x in streams]):
        some = [streams[k] for k in part]
        coded = many.encode_many([np.frombuffer(x, np.uint8) for x in some], freq[None])
        out += [struct.pack("<II", len(x), len(c)) + c for x, c in zip(some, coded, strict=True)]
    return out


def shared_decode_many(streams: list[bytes], freq: np.ndarray) -> list[bytes | None]:
    """shared_decode() of each stream, all at once; None for damaged ones."""
    out: list[bytes | None] = []
    heads = [struct.unpack_from("<II", x) if len(x) >= 8 else (0, 0) for x in streams]
    whole = [len(x) >= 8 and size <= len(x) - 8 for x, (_, size) in zip(streams, heads, strict=True)]
    counts = [n if ok else 0 for (n, _), ok in zip(heads, whole, strict=True)]
    for part in many.batches(counts):
        got = many.decode_many([streams[k][8 : 8 + heads[k][1]] if whole[k] else b"" for k in part], np.array([counts[k] for k in part]), freq[None])
        out += [x.tobytes() if whole[k] and x is not None else None for k, x in zip(part, got, strict=True)]
    return out


def through_restarts_many(streams: list[bytes], interval: int = 64) -> list[bytes]:
    """Codes each stream and decodes it part by part from its restart points, all parts at once."""
    out: list[bytes] = []
    for part in many.batches([len(x) for x in streams]):
        data = [np.frombuffer(streams[k], np.uint8) for k in part]
        sizes = np.array([len(x) for x in data], np.int64)
        freqs = many.models(np.stack([np.bincount(x, minlength=256) + 1 for x in data]))
        points, stream, before = many.restart_many(many.encode_many(data, freqs), sizes, freqs, interval)
        got, _ = many.decode_from(points, np.minimum(interval, sizes[stream] - before), freqs, stream)
        flat = np.concatenate([many.checked(x) for x in got] or [np.zeros(0, np.uint8)]).tobytes()
        ends = np.cumsum(sizes).tolist()
        out += [flat[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]
    return out


#: Of the fixed model for LZ bytes: what is added to 1 for the bytes from .. to (fixed values).
LZ_WEIGHTS = ((0, 0, 1024), (1, 1, 768), (2, 16, 192), (17, 63, 64), (64, 127, 24), (128, 255, 8), (0, 7, 128))


def lz_model() -> np.ndarray:
    """The fixed model for LZ bytes: tags and short numbers are frequent."""
    counts = np.ones(256, np.int64)
    for first, last, weight in LZ_WEIGHTS:
        counts[first : last + 1] += weight
    return model(counts)


def token_streams(data: bytes, compact: bool = True) -> dict[str, bytes]:
    """Types, lengths, distances and literals of an LZ stream apart; ``compact`` keeps distances of matches only."""
    out = {k: bytearray() for k in ("types", "lengths", "near", "far", "literals")}
    for tag, length, distance, plain in lz_tokens(data):
        out["types"].append(tag)
        out["lengths"].append(length)
        if tag or not compact:
            out["near"].append(distance & 255)
            out["far"].append(distance >> 8)
        out["literals"] += plain
    return {k: bytes(v) for k, v in out.items()}


def rebuilt(streams: dict[str, bytes], compact: bool = True) -> bytes:
    out, lit, dist = bytearray(), 0, 0
    for tag, length in zip(streams["types"], streams["lengths"], strict=True):
        if tag == 0:
            out += bytes((0, length)) + streams["literals"][lit : lit + length]
            lit += length
        else:
            out += bytes((1, length, streams["near"][dist], streams["far"][dist]))
        dist += bool(tag) or not compact
    return bytes(out)


# ---- bits, runs, sparse bytes


def pack_bits(values: Iterable[int], bits: int) -> bytes:
    """Least significant bits first."""
    v = values.astype(np.int64) if isinstance(values, np.ndarray) else np.asarray(list(values), np.int64)
    if bits <= 0 or not len(v):
        return b""
    return np.packbits((v[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> list[int]:
    if bits <= 0:
        return [0] * count
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return (flat.reshape(count, bits).astype(np.int64) << np.arange(bits)).sum(axis=1).tolist()


def type_runs(kinds: Iterable[int]) -> bytes:
    """Runs of up to 64 block kinds: kind in two bits, length less one above."""
    out, last, n = bytearray(), None, 0
    for kind in [*kinds, None]:
        if kind == last and n < 64:
            n += 1
            continue
        if last is not None:
            out.append(last & 3 | (n - 1) << 2)
        last, n = kind, 1
    return bytes(out)


def from_type_runs(data: bytes, count: int) -> list[int]:
    """Padded with kind 0, cut at ``count``."""
    out = [x & 3 for x in data for _ in range((x >> 2) + 1)][:count]
    return out + [0] * (count - len(out))


SPARSE = 0xAA


def sparse_encode(data: bytes) -> bytes:
    """Bytes that are mostly zero: a bit mask and the others; the plain coding where that is smaller."""
    dense = adaptive_encode(data) if data else b""
    v = np.frombuffer(data, np.uint8)
    rest = v[v != 0]
    if len(v) < 32 or 4 * (len(v) - len(rest)) < 3 * len(v):
        return dense
    mask = np.packbits((v != 0).astype(np.uint8), bitorder="little").tobytes()
    out = bytes((SPARSE,)) + len(rest).to_bytes(3, "little") + mask + (adaptive_encode(rest.tobytes()) if len(rest) else b"")
    return out if len(out) < len(dense) else dense


def sparse_decode(data: bytes, count: int) -> bytes:
    if not data:
        return b""
    if data[0] != SPARSE:
        return adaptive_decode(data)
    size = (count + 7) // 8
    mask = np.unpackbits(np.frombuffer(data[4 : 4 + size], np.uint8), count=count, bitorder="little").astype(bool)
    out = np.zeros(count, np.uint8)
    if int.from_bytes(data[1:4], "little"):
        out[mask] = np.frombuffer(adaptive_decode(data[4 + size :]), np.uint8)
    return out.tobytes()


def smallest(raw: bytes, magic: int, header: int = 6, permille: int = 980) -> bytes:
    """Raw, range-coded or LZ, whichever is smallest; a coded form must win by the margin and carries a header."""
    best = raw
    for kind, coded in ((1, adaptive_encode(raw)), (2, lz_compress(raw))):
        size = header + len(coded)
        if size < len(best) and size * 1000 <= len(raw) * permille:
            best = bytes((magic, kind)) + (struct.pack("<I", len(raw)) if header == 6 else b"") + coded
    return best


def smallest_many(streams: list[bytes], magic: int, header: int = 6, permille: int = 980) -> list[bytes]:
    """smallest() of each stream, all at once; streams that the model alone makes too long aren't range-coded."""
    best = list(streams)
    model_size = 1036 + 4 * LANES
    able = [k for k, raw in enumerate(streams) if (header + model_size) * 1000 <= len(raw) * permille]
    for kind, keys, code in ((1, able, adaptive_encode_many), (2, range(len(streams)), lz_compress_many)):
        for k, coded in zip(keys, code([streams[k] for k in keys]), strict=True):
            raw, size = streams[k], header + len(coded)
            if size < len(best[k]) and size * 1000 <= len(raw) * permille:
                best[k] = bytes((magic, kind)) + (struct.pack("<I", len(raw)) if header == 6 else b"") + coded
    return best


def unwrapped_many(streams: list[bytes], magic: int, header: int = 6) -> list[bytes | None]:
    """unwrapped() of each stream, all at once; None for damaged ones."""
    out: list[bytes | None] = list(streams)
    coded = [k for k, x in enumerate(streams) if len(x) >= header and x[0] == magic and x[1] in (1, 2)]
    first, second = ([k for k in coded if streams[k][1] == kind] for kind in (1, 2))
    sizes = [struct.unpack_from("<I", streams[k], 2)[0] for k in second] if header == 6 else None
    for keys, got in ((first, adaptive_decode_many([streams[k][header:] for k in first])), (second, lz_decompress_many([streams[k][header:] for k in second], sizes))):
        for k, x in zip(keys, got, strict=True):
            out[k] = x
    return out


def unwrapped(data: bytes, magic: int, header: int = 6) -> bytes:
    if len(data) < header or data[0] != magic or data[1] not in (1, 2):
        return data
    body = data[header:]
    return adaptive_decode(body) if data[1] == 1 else lz_decompress(body, struct.unpack_from("<I", data, 2)[0] if header == 6 else None)


# ---- copy vectors, palettes

VECTORS = {(-8, 0): 0, (0, -8): 1, (-8, -8): 2, (8, -8): 3}


def copy_encode(vectors: list[tuple[int, int]]) -> bytes:
    """Mode byte and payload: 0 raw pairs, 1 two-bit codes, 2 codes of the vectors in use, 3 runs of those."""
    if not vectors:
        return b""
    ids = [VECTORS.get(v, -1) for v in vectors]
    if -1 in ids:
        return b"\0" + b"".join(struct.pack("<hh", *v) for v in vectors)
    used = sorted(set(ids))
    mask, bits = sum(1 << k for k in used), (len(used) - 1).bit_length()
    codes = [used.index(k) for k in ids]
    runs, k = bytearray(), 0
    while k < len(codes):
        n = 1
        while n < 64 and k + n < len(codes) and codes[k + n] == codes[k]:
            n += 1
        runs.append(codes[k] << 6 | n - 1)
        k += n
    packed = bytes((2, mask)) + pack_bits(codes, bits)
    two = b"\1" + pack_bits(ids, 2)
    best = packed if len(packed) <= len(two) else two
    return bytes((3, mask)) + bytes(runs) if 2 + len(runs) < len(best) else best


def copy_decode(data: bytes, count: int) -> list[tuple[int, int]]:
    """Lenient: unknown codes are code 0, what is cut off is the first vector; 4 bytes a block are raw pairs."""
    table = list(VECTORS)
    if not data or count <= 0:
        return []
    mode, body = (0, data) if len(data) == 4 * count else (data[0], data[1:])
    if mode == 0:
        return [struct.unpack_from("<hh", body, 4 * k) for k in range(min(count, len(body) // 4))]
    if mode == 1:
        return [table[c] for c in unpack_bits(body.ljust((2 * count + 7) // 8, b"\0"), 2, count)]
    used = [k for k in range(4) if body and body[0] >> k & 1]
    if not used:
        return []
    if mode == 2:
        bits = (len(used) - 1).bit_length()
        codes = unpack_bits(body[1:].ljust((bits * count + 7) // 8, b"\0"), bits, count)
    else:
        codes = [t >> 6 for t in body[1:] for _ in range((t & 63) + 1)][:count]
    out = [table[used[c] if c < len(used) else used[0]] for c in codes]
    return out + [table[0]] * (count - len(out))


PALETTES = 0x50


def palette_encode(blocks: list[tuple[list[int], list[int]]]) -> bytes:
    """Colours and indices of palette blocks, with a dictionary of the palettes that repeat: [magic][n]
    [dictionary][per block: entry or size and colours, then packed indices]; colours are 16-bit."""
    counts: dict[tuple[int, ...], int] = {}
    for colors, _ in blocks:
        counts[tuple(colors)] = counts.get(tuple(colors), 0) + 1
    shared = sorted((p for p, n in counts.items() if n > 1), key=lambda p: (-counts[p], p))[:255]
    entry = {p: k for k, p in enumerate(shared)}
    out = bytearray(struct.pack("<BIB", PALETTES, len(blocks), len(shared)))
    for p in shared:
        out += struct.pack(f"<B{len(p)}h", len(p), *p)
    for colors, indices in blocks:
        p = tuple(colors)
        out += bytes((entry[p],)) if p in entry else struct.pack(f"<BB{len(p)}h", 255, len(p), *p)
        out += pack_bits(indices, (len(p) - 1).bit_length())
    return bytes(out)


def palette_decode(data: bytes) -> list[tuple[list[int], list[int]]]:
    if len(data) < 6 or data[0] != PALETTES:
        raise Damaged("no palette stream")
    _, n, n_shared = struct.unpack_from("<BIB", data)
    pos, shared, out = 6, [], []

    def colors() -> list[int]:
        nonlocal pos
        size = data[pos]
        got = list(struct.unpack_from(f"<{size}h", data, pos + 1))
        pos += 1 + 2 * size
        return got

    for _ in range(n_shared):
        shared.append(colors())
    for _ in range(n):
        entry = data[pos]
        pos += 1
        own = colors() if entry == 255 else shared[entry]
        bits = (len(own) - 1).bit_length()
        out.append((own, unpack_bits(data[pos : pos + 8 * bits], bits, 64)))
        pos += 8 * bits
    return out


def palette_diagnostics(data: bytes) -> dict[str, int]:
    """Counts of a palette stream; a damaged one counts as an error."""
    try:
        got = palette_decode(data)
    except (Damaged, struct.error, IndexError, ValueError):
        return {"blocks": 0, "pairs": 0, "wide": 0, "errors": 1}
    return {"blocks": len(got), "pairs": sum(len(c) == 2 for c, _ in got), "wide": sum(any(not -128 <= v <= 127 for v in c) for c, _ in got), "errors": 0}


def best_color_order(colors: list[int], indices: list[int]) -> list[int]:
    """The order of a palette that costs least: as it is, by value up or down, or any for up to four colours."""
    import itertools

    def cost(order: tuple[int, ...]) -> int:
        at = {c: k for k, c in enumerate(order)}
        mapped = [at[colors[i]] for i in indices]
        return sum(abs(a - b) for a, b in zip(order, order[1:], strict=False)) + sum(a != b for a, b in zip(mapped, mapped[1:], strict=False)) + sum(mapped)

    options = [tuple(colors), tuple(sorted(colors)), tuple(sorted(colors, reverse=True))]
    if 3 <= len(colors) <= 4:
        options += itertools.permutations(colors)
    return list(min(options, key=cost))


# ---- token streams


def tokens_encode(tokens: list[tuple[int, int, int]], symbols: int = 76) -> bytes:
    """Types range-coded, then (place, raw) of those with bits, three bytes each."""
    types = [t for t, _, _ in tokens]
    freq = model(np.bincount(types, minlength=symbols) + 1)
    payload = rans_encode(types, freq)
    raw = b"".join(struct.pack("<BH", n, r) for _, r, n in tokens if n)
    return struct.pack("<III", len(types), len(payload), len(raw)) + freq.astype("<u2").tobytes() + payload + raw


def token_types(data: bytes, symbols: int = 76) -> tuple[int, bytes, np.ndarray]:
    """The number of tokens, the coded types and their model."""
    count, size, _ = struct.unpack_from("<III", data)
    freq = np.frombuffer(data, "<u2", symbols, 12).astype(np.int64)
    return count, data[12 + 2 * symbols : 12 + 2 * symbols + size], freq


def tokens_decode(data: bytes, symbols: int = 76, types: list[int] | None = None) -> list[tuple[int, int, int]]:
    """``types``: those of the tokens, if they have been decoded from restart points."""
    count, payload, freq = token_types(data, symbols)
    types = rans_decode(payload, count, freq) if types is None else types
    out, pos = [], 12 + 2 * symbols + len(payload)
    for t in types:
        if t > 64:
            n, r = struct.unpack_from("<BH", data, pos)
            out.append((t, r, n))
            pos += 3
        else:
            out.append((t, 0, 0))
    return out


# ---- inverse prediction


def guess(kind: int, a: int, b: int, c: int) -> int:
    """What a predictor expects after its left, upper and upper-left neighbours."""
    if kind < 3:
        return (0, a, b)[kind]
    if kind == 3:
        return int((a + b) / 2)
    if kind == 4:
        near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        return (a, b, c)[near.index(min(near))]
    if kind == 5:
        return sorted((a, b, a + b - c))[1]
    return int((3 * a + b if kind == 6 else a + 3 * b) / 4)


def unfilter(residuals: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Samples of a plane from its residuals and each line's predictor, line by line."""
    h, w = residuals.shape
    out = np.zeros((h, w), np.int64)
    zero = np.zeros(w, np.int64)
    for y in range(h):
        r, up, kind = residuals[y].astype(np.int64), out[y - 1] if y else zero, int(filters[y])
        if kind in (0, 2):
            out[y] = r + (up if kind == 2 else 0)
        elif kind == 1:
            out[y] = np.cumsum(r)
        else:
            a = c = 0
            line = []
            for v, b in zip(r.tolist(), up.tolist(), strict=True):
                a, c = v + guess(kind, a, b, c), b
                line.append(a)
            out[y] = line
    return out


def lz_row_cost(values: bytes, window: int = 256, literal: int = 1, match: int = 4) -> int:
    """Greedy cost of a line: its longest earlier repeat of three or more costs ``match``, any other byte ``literal``."""
    part, cost, pos = values[:window], 0, 0
    while pos < len(part):
        best = max((common(part, ref, pos) for ref in range(pos)), default=0)
        cost += match if best >= 3 else literal
        pos += best if best >= 3 else 1
    return cost


# ---- over DataFrames


def map_streams(streams: DataFrame, function: Callable[[bytes], bytes | None], key: str = "stream_id", content: str = "content", out: str = "coded") -> DataFrame:
    """(key, out) with the function's result for every stream; null stays null, damaged streams give null."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[bytes | None] = []
            for x in batch.column(1).to_pylist():
                try:
                    got.append(None if x is None else function(bytes(x)))
                except Damaged:
                    got.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [key, out])

    return streams.select(key, F.col(content)).mapInArrow(each, f"{key} {dict(streams.dtypes)[key]}, {out} binary")


def map_batches(streams: DataFrame, function: Callable[[list[bytes]], list], key: str = "stream_id", content: str = "content", out: str = "coded", kind: str = "binary") -> DataFrame:
    """map_streams() with a function of many streams, which get those of similar size together, a few MB at once.

    ``kind``: ``binary``, or ``long`` for functions that give numbers.
    """
    arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def each(record_batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
            order = np.argsort(-sizes, kind="stable")
            for part in batches(sizes[order].tolist()):
                rows = batch.take(pa.array(order[part.start : part.stop]))
                raw = rows.column(1).to_pylist()
                got = iter(function([bytes(x) for x in raw if x is not None]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([None if x is None else next(got) for x in raw], arrow)], [key, out])

    return streams.select(key, F.col(content)).mapInArrow(each, f"{key} {dict(streams.dtypes)[key]}, {out} {kind}")


def map_numbers(streams: DataFrame, function: Callable[[bytes], int], key: str = "stream_id", content: str = "content", out: str = "n") -> DataFrame:
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else int(function(bytes(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], [key, out])

    return streams.select(key, F.col(content)).mapInArrow(each, f"{key} {dict(streams.dtypes)[key]}, {out} long")


# ---- probes and parameter streams


def probe(data: bytes, sample: int = 4096, least: int = 4096, permille: int = 1030) -> bool:
    """Whether LZ is worth a try: always for short streams, else by what it makes of the first bytes."""
    if len(data) < least:
        return True
    head = data[:sample]
    return len(lz_compress(head)) * 1000 <= len(head) * permille


def cfl_encode(params: list[tuple[int, int, bool]]) -> bytes:
    """(alpha in 64ths, beta, applied) of blocks: all pairs, or a bit mask and the pairs in use, whichever is smaller."""
    every = b"".join(struct.pack("<bB", a, b) for a, b, _ in params)
    used = [(a, b) for a, b, on in params if on]
    packed = struct.pack("<I", len(params)) + pack_bits([on for *_, on in params], 1) + b"".join(struct.pack("<bB", a, b) for a, b in used)
    return b"\1" + packed if len(packed) < len(every) else b"\0" + every


def cfl_decode(data: bytes) -> list[tuple[int, int, bool]]:
    """Blocks without a fit come back as (0, 128, False) from the masked form."""
    if not data:
        return []
    if data[0] == 0:
        return [(a, b, True) for a, b in struct.iter_unpack("<bB", data[1:])]
    (n,) = struct.unpack_from("<I", data, 1)
    size = (n + 7) // 8
    on, pairs = unpack_bits(data[5 : 5 + size], 1, n), struct.iter_unpack("<bB", data[5 + size :])
    return [(*next(pairs), True) if x else (0, 128, False) for x in on]


def streams_encode(data: bytes, lanes: int = 4) -> bytes:
    """Symbols dealt over separate streams, each coded alone under one model; lengths lead as varints."""
    freq = model(laplace(data))
    parts = [rans_encode(data[k::lanes], freq, 1) for k in range(lanes)]
    return struct.pack("<IB", len(data), lanes) + freq.astype("<u2").tobytes() + b"".join(map(varint, map(len, parts))) + b"".join(parts)


def streams_decode(data: bytes) -> bytes:
    count, lanes = struct.unpack_from("<IB", data)
    freq, pos = np.frombuffer(data, "<u2", 256, 5).astype(np.int64), 517
    sizes, out = [], bytearray(count)
    for _ in range(lanes):
        size, pos = unvarint(data, pos)
        sizes.append(size)
    for k, size in enumerate(sizes):
        out[k::lanes] = bytes(rans_decode(data[pos : pos + size], len(range(k, count, lanes)), freq, 1))
        pos += size
    return bytes(out)


def streams_encode_many(streams: list[bytes], lanes: int = 4) -> list[bytes]:
    """streams_encode() of each stream, all at once."""
    out: list[bytes] = []
    for part in many.batches([len(x) for x in streams]):
        data = [np.frombuffer(streams[k], np.uint8) for k in part]
        freqs = many.models(np.stack([np.bincount(x, minlength=256) + 1 for x in data]))
        coded = many.encode_many([x[k::lanes] for x in data for k in range(lanes)], freqs, 1)
        for x, f, first in zip(data, freqs, range(0, len(coded), lanes), strict=True):
            parts = coded[first : first + lanes]
            out.append(struct.pack("<IB", len(x), lanes) + f.astype("<u2").tobytes() + b"".join(map(varint, map(len, parts))) + b"".join(parts))
    return out


def streams_decode_many(streams: list[bytes], lanes: int = 4) -> list[bytes | None]:
    """streams_decode() of each stream, all at once, if all have as many lanes; None for those that are cut off."""
    out: list[bytes | None] = []
    counts = [struct.unpack_from("<IB", x)[0] for x in streams]
    for part in many.batches(counts):
        freqs = np.stack([np.frombuffer(streams[k], "<u2", 256, 5) for k in part]).astype(np.int64)
        parts, sizes = [], []
        for k in part:
            data, pos, lengths = streams[k], 517, []
            for _ in range(lanes):
                size, pos = unvarint(data, pos)
                lengths.append(size)
            for lane, size in enumerate(lengths):
                parts.append(data[pos : pos + size])
                sizes.append(len(range(lane, counts[k], lanes)))
                pos += size
        got = many.decode_many(parts, np.array(sizes), freqs, 1)
        for k, first in zip(part, range(0, len(got), lanes), strict=True):
            if any(x is None for x in got[first : first + lanes]):
                out.append(None)
                continue
            back = np.empty(counts[k], np.uint8)
            for lane in range(lanes):
                back[lane::lanes] = got[first + lane]
            out.append(back.tobytes())
    return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def unvarint(data: bytes, pos: int) -> tuple[int, int]:
    n, shift = 0, 0
    while True:
        if pos >= len(data):
            raise Damaged("varint")
        n |= (data[pos] & 127) << shift
        shift, pos = shift + 7, pos + 1
        if data[pos - 1] < 128:
            return n, pos


def token_streams_encode(data: bytes) -> bytes:
    """LZ, its token streams apart, each in its smallest form; types are bits."""
    parts = token_streams(lz_compress(data))
    coded = [pack_bits(parts["types"], 1), *(smallest(parts[k], 0xAB) for k in ("lengths", "near", "far", "literals"))]
    return struct.pack("<6I", len(parts["types"]), *map(len, coded)) + b"".join(coded)


def token_streams_decode(data: bytes, size: int) -> bytes:
    n, *sizes = struct.unpack_from("<6I", data)
    pos, got = 24, []
    for s in sizes:
        got.append(data[pos : pos + s])
        pos += s
    names = ("lengths", "near", "far", "literals")
    streams = {"types": bytes(unpack_bits(got[0], 1, n))} | {k: unwrapped(g, 0xAB) for k, g in zip(names, got[1:], strict=True)}
    return lz_decompress(rebuilt(streams), size)


def token_streams_encode_many(streams: list[bytes]) -> list[bytes]:
    """token_streams_encode() of each stream, all at once."""
    parts = Tokens(lz_compress_many(streams)).streams()
    types = [np.packbits(np.frombuffer(x, np.uint8), bitorder="little").tobytes() for x in parts["types"]]
    coded = smallest_many([x for k in ("lengths", "near", "far", "literals") for x in parts[k]], 0xAB)
    out = []
    for k, (kinds, bits) in enumerate(zip(parts["types"], types, strict=True)):
        mine = [bits, *coded[k :: len(streams)]]
        out.append(struct.pack("<6I", len(kinds), *map(len, mine)) + b"".join(mine))
    return out


def token_streams_decode_many(streams: list[bytes], sizes: list[int]) -> list[bytes | None]:
    """token_streams_decode() of each stream, all at once; None for damaged ones."""
    got: list[list[bytes]] = [[] for _ in range(5)]
    counts = []
    for data in streams:
        n, *lengths = struct.unpack_from("<6I", data)
        pos = 24
        for held, s in zip(got, lengths, strict=True):
            held.append(data[pos : pos + s])
            pos += s
        counts.append(n)
    types = [np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little").tobytes() for x, n in zip(got[0], counts, strict=True)]
    plain = unwrapped_many([x for part in got[1:] for x in part], 0xAB)
    n = len(streams)
    parts = {"types": types} | {k: plain[j * n : (j + 1) * n] for j, k in enumerate(("lengths", "near", "far", "literals"))}
    good = [all(x[k] is not None for x in parts.values()) for k in range(n)]
    lz = iter(lz_decompress_many(rebuilt_many({name: [x for x, ok in zip(v, good, strict=True) if ok] for name, v in parts.items()}), [s for s, ok in zip(sizes, good, strict=True) if ok]))
    return [next(lz) if ok else None for ok in good]
