"""Portable pixmaps and the chunked container, as bytes and as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom.operators.codecs import Damaged

# ---- pixmaps (P6, 8 bits)


def read_ppm(data: bytes) -> np.ndarray:
    """(height, width, 3); comments are skipped, anything else than a whole 8-bit P6 file is an error."""
    if data[:2] != b"P6":
        raise Damaged("no P6 file")
    pos, fields = 2, []
    while len(fields) < 3:
        while pos < len(data) and data[pos : pos + 1].isspace():
            pos += 1
        if data[pos : pos + 1] == b"#":
            pos = data.find(b"\n", pos) + 1 or len(data)
            continue
        end = pos
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == pos:
            raise Damaged("header")
        fields.append(int(data[pos:end]))
        pos = end
    width, height, most = fields
    body = data[pos + 1 : pos + 1 + 3 * width * height]
    if width <= 0 or height <= 0 or most != 255 or len(body) < 3 * width * height:
        raise Damaged("size")
    return np.frombuffer(body, np.uint8).reshape(height, width, 3)


def write_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def is_ppm(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(b"P6")


def pixmaps(files: DataFrame, lenient: bool = False) -> DataFrame:
    """(path, width, height, rgb, error) of rows (path, content), as the binaryFile source gives them; bad files have an error."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(1).to_pylist():
                try:
                    p = read_ppm(bytes(data or b""))
                    out.append((p.shape[1], p.shape[0], p.tobytes(), None))
                except Damaged as e:
                    out.append((None, None, None, str(e)))
            w, h, rgb, error = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())], ["path", "width", "height", "rgb", "error"])

    got = files.select("path", "content").mapInArrow(parse, "path string, width int, height int, rgb binary, error string")
    return got if lenient else got.where("error is null")


def pixmap_files(spark: SparkSession, path: str) -> DataFrame:
    return pixmaps(spark.read.format("binaryFile").load(path), lenient=True)


def pixmap_lines(images: DataFrame) -> DataFrame:
    """(image_id, plane, y, row) of pixmaps, one record for each line and channel."""
    lines = images.select(F.col("path").alias("image_id"), "width", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("rgb", y * F.col("width") * 3 + 1, F.col("width") * 3))).alias("y", "line"))
    samples = F.transform(F.regexp_extract_all(F.hex("line"), F.lit("(..)")), lambda h: F.conv(h, 16, 10).cast("int"))
    by_line = lines.select("image_id", F.col("y").cast("long").alias("y"), samples.alias("s"))
    channel = lambda k: F.filter(F.col("s"), lambda _, i: i % 3 == k)
    return by_line.select("image_id", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("plane"), channel(k).alias("row")) for k, c in enumerate("rgb")])).alias("p")).select("image_id", "p.plane", "y", "p.row")


# ---- the container: header, chunk directory, chunks

# Fixed values of the header.
MAGIC = 0x484B4E00
VERSION, LEAST_VERSION = 0x0019, 0x0003
HEADER = struct.Struct("<IHHIIBBBBHHBBBBBBH16s")
FIELDS = ("magic", "version", "flags", "width", "height", "bit_depth", "channels", "colorspace", "subsampling", "tile_cols", "tile_rows", "block_size", "transform", "entropy", "interleave", "index_density", "quality")


def header(width: int, height: int, channels: int = 3, lossless: bool = True, quality: int = 0, colorspace: int = 1, subsampling: int = 0) -> bytes:
    return HEADER.pack(MAGIC, VERSION, int(lossless), width, height, 8, channels, colorspace, subsampling, 1, 1, 8, 0, 0, 8, 0, quality, 0, b"")


def parse_header(data: bytes) -> dict[str, int]:
    if len(data) < HEADER.size:
        raise Damaged("header is cut off")
    got = dict(zip(FIELDS, HEADER.unpack_from(data), strict=False))
    if got["magic"] != MAGIC or not LEAST_VERSION <= got["version"] <= VERSION or got["block_size"] != 8 or not got["width"] or not got["height"] or not 1 <= got["channels"] <= 4:
        raise Damaged("header")
    return got


def pack(head: bytes, chunks: list[tuple[str, bytes]]) -> bytes:
    """Header, directory, chunks; offsets count from the start of the file."""
    at, entries = len(head) + 4 + 20 * len(chunks), b""
    for kind, body in chunks:
        entries += struct.pack("<4sQQ", kind.encode(), at, len(body))
        at += len(body)
    return head + struct.pack("<I", len(chunks)) + entries + b"".join(b for _, b in chunks)


def directory(data: bytes) -> list[tuple[str, int, int]]:
    if len(data) < HEADER.size + 4:
        raise Damaged("no directory")
    (n,) = struct.unpack_from("<I", data, HEADER.size)
    if len(data) < HEADER.size + 4 + 20 * n:
        raise Damaged("directory is cut off")
    return [(kind.rstrip(b"\0").decode("latin-1"), at, size) for kind, at, size in struct.iter_unpack("<4sQQ", data[HEADER.size + 4 : HEADER.size + 4 + 20 * n])]


def chunk(data: bytes, kind: str) -> bytes | None:
    """The first chunk of a kind."""
    return next((data[at : at + size] for k, at, size in directory(data) if k == kind), None)


def quant_chunk(quality: int, tables: list[list[int]]) -> bytes:
    return bytes((quality, len(tables))) + b"".join(struct.pack("<64H", *t) for t in tables)


def parse_quant_chunk(data: bytes) -> tuple[int, list[list[int]]]:
    if len(data) < 2 or len(data) < 2 + 128 * data[1]:
        raise Damaged("tables are cut off")
    n = 3 if data[1] == 3 else 1
    return data[0], [list(struct.unpack_from("<64H", data, 2 + 128 * k)) for k in range(n)]


def little(content: Column, at: Column | int, size: int) -> Column:
    """An unsigned little-endian number of a binary column; ``at`` counts from 0."""
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    digits = F.concat(*[F.hex(F.substring(content, start + k, F.lit(1))) for k in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long")


def header_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """The header's fields and whether it is valid, in the JVM."""
    at, out = 0, {}
    for name, size in zip(FIELDS, (4, 2, 2, 4, 4, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1), strict=True):
        out[name] = little(F.col(content), at, size)
        at += size
    got = files.withColumns(out)
    ok = (F.col("magic") == MAGIC) & F.col("version").between(LEAST_VERSION, VERSION) & (F.col("block_size") == 8) & (F.col("width") > 0) & (F.col("height") > 0) & F.col("channels").between(1, 4)
    return got.withColumn("valid", F.coalesce(ok, F.lit(False)))


def chunk_rows(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, entry, kind, offset, size): the directory, one row for each chunk."""
    n = little(F.col(content), HEADER.size, 4)
    at = lambda k: F.lit(HEADER.size + 4) + 20 * k
    entries = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(k.alias("entry"), F.substring(F.col(content), (at(k) + 1).cast("int"), F.lit(4)).cast("string").alias("kind"), little(F.col(content), (at(k) + 4).cast("int"), 8).alias("offset"), little(F.col(content), (at(k) + 12).cast("int"), 8).alias("size")))
    return files.where(n > 0).select(key, F.explode(entries).alias("e")).select(key, "e.*")


def accounting(chunks: DataFrame, key: str, known: tuple[str, ...]) -> DataFrame:
    """Bytes of each known kind of chunk, and of the others."""
    own = [F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(k.lower()) for k in known]
    return chunks.groupBy(key).agg(*own, F.sum(F.when(~F.col("kind").isin(*known), F.col("size")).otherwise(0)).alias("unknown"))


#: The streams of a lossless tile in the order of its eight sizes (one of them counts samples, not bytes).
TILE_STREAMS = ("filter_ids", "lo", "hi", "pixels", "block_types", "palette", "copy", "tile4")


def tile_accounting(tiles: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The bytes of each stream inside a lossless tile, and of the whole."""
    return tiles.select(key, *(little(F.col(content), 4 * k, 4).alias(n) for k, n in enumerate(TILE_STREAMS)), F.octet_length(content).cast("long").alias("tile_bytes"))
