"""PNG files as RGB samples, with the standard library's inflate."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.operators.lz import Damaged

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: (first column, first line, step across, step down) of the interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def parts(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    pos = len(SIGNATURE)
    while pos + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, pos)
        kind, body = data[pos + 4 : pos + 8], data[pos + 8 : pos + 8 + size]
        if len(body) < size or data[pos + 8 + size : pos + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise Damaged("chunk")
        yield kind, body
        if kind == b"IEND":
            return
        pos += 12 + size
    raise Damaged("no end")


def unfiltered(raw: bytes, lines: int, width: int, step: int) -> np.ndarray:
    """Lines of bytes from filtered ones; ``step``: bytes between a sample and the one to its left."""
    if len(raw) < lines * (width + 1):
        raise Damaged("samples are cut off")
    both = np.frombuffer(raw, np.uint8, lines * (width + 1)).reshape(lines, width + 1)
    out, zero = np.zeros((lines, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(lines):
        kind, line, up = int(both[y, 0]), both[y, 1:], out[y - 1] if y else zero
        if kind in (0, 2):
            out[y] = line + up if kind else line
        elif kind == 1:
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            out[y] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind in (3, 4):
            row, above = [0] * step + line.tolist(), [0] * step + up.tolist()
            for x in range(step, width + step):
                a, b, c = row[x - step], above[x], above[x - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = (a, b, c)[near.index(min(near))]
                row[x] = (row[x] + guess) & 255
            out[y] = row[step:]
        else:
            raise Damaged("filter")
    return out


def samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(height, width, channels) of any depth, as they are written."""
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2)[..., 0]
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
        return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
    return lines.reshape(len(lines), width, channels)


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) in 8 bits: grey is spread, palettes are looked up, 16 bits are cut to their high byte, alpha is dropped."""
    if not data.startswith(SIGNATURE):
        raise Damaged("no PNG file")
    head, palette, packed = None, None, b""
    for kind, body in parts(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[3] not in CHANNELS or not head[0] or not head[1]:
        raise Damaged("header")
    width, height, depth, color, _, _, interlaced = head
    try:
        raw = zlib.decompress(packed)
    except zlib.error as e:
        raise Damaged(str(e)) from e
    channels = CHANNELS[color]
    step = max(1, channels * depth // 8)
    got = np.zeros((height, width, channels), np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        got[y0::dy, x0::dx] = samples(unfiltered(raw[at:], h, line, step), w, depth, channels)
        at += h * (line + 1)
    if color == 3:
        if palette is None or got.max() >= len(palette):
            raise Damaged("palette")
        return palette[got[..., 0]]
    if depth < 8:
        got = got * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(got[..., :1], 3, axis=2) if channels < 3 else got[..., :3]


def write_png(rgb: np.ndarray, filters: Iterable[int] = (0,)) -> bytes:
    """RGB in 8 bits; the lines take the given filters in turn."""
    h, w = rgb.shape[:2]
    kinds, lines, body = list(filters), rgb.astype(np.int64).reshape(h, 3 * w), bytearray()
    for y, line in enumerate(lines):
        up = lines[y - 1] if y else np.zeros_like(line)
        a, c = (np.concatenate([[0, 0, 0], v[:-3]]) for v in (line, up))
        kind = kinds[y % len(kinds)]
        near = np.stack([abs(up - c), abs(a - c), abs(a + up - 2 * c)]).argmin(axis=0)
        guess = (0, a, up, (a + up) // 2, np.choose(near, [a, up, c]))[kind]
        body += bytes((kind,)) + ((line - guess) & 255).astype(np.uint8).tobytes()
    pack = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return SIGNATURE + pack(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + pack(b"IDAT", zlib.compress(bytes(body))) + pack(b"IEND", b"")


def images(files: DataFrame, lenient: bool = False) -> DataFrame:
    """(path, width, height, rgb, error) of rows (path, content), like ``container.pixmaps``."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(1).to_pylist():
                try:
                    p = read_png(bytes(data or b""))
                    out.append((p.shape[1], p.shape[0], p.tobytes(), None))
                except (Damaged, struct.error, ValueError) as e:
                    out.append((None, None, None, str(e)))
            w, h, rgb, error = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())], ["path", "width", "height", "rgb", "error"])

    got = files.select("path", "content").mapInArrow(parse, "path string, width int, height int, rgb binary, error string")
    return got if lenient else got.where("error is null")
