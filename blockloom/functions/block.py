"""Functions of 64-element blocks (arrays in raster order): scans, quantisation, transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from blockloom.functions.pixel import magnitude_class, quotient

#: Band ends in zigzag order (fixed values; parameters of the functions below).
LOW_END, MID_END = 15, 31


def zigzag_order(n: int = 8) -> list[int]:
    """Raster places in the order of a zigzag scan: diagonals, each walked against the last."""
    cells = [(y, x) for y in range(n) for x in range(n)]
    return [y * n + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))]


def scan(block: Column, order: list[int] | None = None) -> Column:
    places = F.array(*[F.lit(p) for p in (order or zigzag_order())])
    return F.transform(places, lambda p: F.get(block, p))


def inverse_scan(block: Column) -> Column:
    order = zigzag_order()
    return scan(block, [order.index(p) for p in range(64)])


# The two standard base matrices (Annex K of the JPEG standard), raster order.
BASE_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
BASE_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)


def quant_table(quality: int, chroma: bool = False) -> list[int]:
    """The base matrix scaled to a quality of 1 to 100, in single precision."""
    quality = min(100, max(1, quality))
    scale = np.float32(5000.0) / np.float32(quality) if quality < 50 else np.float32(200.0) - np.float32(quality) * np.float32(2.0)
    base = np.array(BASE_CHROMA if chroma else BASE_LUMA, np.float32)
    return np.clip(((base * scale + np.float32(50.0)) / np.float32(100.0)).astype(np.int32), 1, 255).tolist()


def chroma_quality(quality: int) -> int:
    return min(100, max(1, quality - 12))


def literal(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def quantise(block: Column, table: list[int]) -> Column:
    """Nearest multiple, halves away from zero."""
    return F.zip_with(block, literal(table), lambda v, q: (F.signum(v).cast("int") * quotient(F.abs(v) + quotient(q, 2), q)).cast("int"))


def dequantise(block: Column, table: list[int]) -> Column:
    return F.zip_with(block, literal(table), lambda v, q: v * q)


def activity(block: Column) -> Column:
    """Sum of the magnitudes of all but the first coefficient."""
    return F.aggregate(F.slice(block, 2, 63), F.lit(0).cast("long"), lambda s, v: s + F.abs(v).cast("long"))


def adaptive_scale(own: Column, mean: Column) -> Column:
    return F.when(mean < 1e-6, F.lit(1.0)).otherwise(F.sqrt(own / mean))


def adaptive_delta(scale: Column) -> Column:
    return F.greatest(F.lit(-127), F.least(F.lit(127), ((scale - 1.0) * 50.0).cast("int")))


#: cos(m pi / 16) for m from 1 to 7 in 12-bit fixed point (fixed values; the third is rounded down).
COSINES = (4017, 3784, 3405, 2896, 2276, 1567, 799)


def dct_basis() -> list[list[int]]:
    """Row k holds cos(k (2n + 1) pi / 16); the first row is divided by the square root of 2."""

    def cosine(m: int) -> int:
        m = min(m % 32, 32 - m % 32)
        return COSINES[m - 1] if m < 8 else 0 if m == 8 else -COSINES[15 - m]

    return [[cosine(k * (2 * n + 1)) if k else COSINES[3] for n in range(8)] for k in range(8)]


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def forward_dct(block: Column) -> Column:
    """Integer transform of rows, then columns; each pass rounds at 13 bits."""
    eight = F.sequence(F.lit(0), F.lit(7))

    def line(values: Column, basis: Column) -> Column:
        def dot(row: Column) -> Column:
            total = F.aggregate(F.zip_with(values, row, lambda v, w: v.cast("long") * w), F.lit(0).cast("long"), lambda s, p: s + p)
            return F.shiftright(total + 4096, 13).cast("int")

        return F.transform(basis, dot)

    def transposed(rows: Column) -> Column:
        return F.transform(eight, lambda k: F.transform(rows, lambda r: F.get(r, k)))

    def both(basis: Column) -> Column:
        rows = F.transform(eight, lambda y: bound(F.slice(block, y * 8 + 1, F.lit(8)), lambda values: line(values, basis)))
        columns = bound(rows, transposed)
        return F.flatten(bound(F.transform(columns, lambda c: line(c, basis)), transposed))

    return bound(F.array(*[literal(r) for r in dct_basis()]), both)


# Fixed values of the inverse transform, in 13-bit fixed point: the rotation of coefficients 2 and 6, and the odd part's
# factors of each of 7, 5, 3 and 1 and of the pairs and the sum of all that its factorisation multiplies.
ROTATION = (4433, 6270, -15137)
ODD_SINGLE = (2446, 16819, 25172, 12299)
ODD_PAIRS = (((0, 3), -7373), ((1, 2), -20995), ((0, 2), -16069), ((1, 3), -3196))
ODD_ALL = 9633
FIXED_BITS, KEPT_BITS = 13, 2


def inverse_basis() -> np.ndarray:
    """Row k: what a coefficient of 1 at k adds to each of the eight outputs, times 2**13.

    The butterflies are linear and exact, so the whole factorisation is one integer matrix.
    """
    odd = np.diag(ODD_SINGLE) + ODD_ALL
    for pair, factor in ODD_PAIRS:
        odd[np.ix_(pair, pair)] += factor
    both, second, sixth = ROTATION
    out = np.zeros((8, 8), np.int64)
    one = 1 << FIXED_BITS
    for k, even in ((0, (one, one, one, one)), (4, (one, -one, -one, one)), (2, (both + second, both, -both, -both - second)), (6, (both, both + sixth, -both - sixth, -both))):
        out[k] = even + even[::-1]
    for column, k in enumerate((7, 5, 3, 1)):
        half = odd[::-1, column]
        out[k] = np.concatenate([half, -half[::-1]])
    return out


def inverse_dct(blocks: np.ndarray) -> np.ndarray:
    """Blocks of coefficients (n, 64) back to samples: lines, then columns, each pass rounded once."""
    basis, half = inverse_basis(), lambda bits: 1 << bits - 1
    first = FIXED_BITS - KEPT_BITS
    last = FIXED_BITS + KEPT_BITS + 3
    lines = (np.einsum("nyk,kx->nyx", blocks.reshape(-1, 8, 8).astype(np.int64), basis) + half(first)) >> first
    return ((np.einsum("nkx,ky->nyx", lines, basis) + half(last)) >> last).astype(np.int32).reshape(-1, 64)


def band(place: Column, low_end: int = LOW_END, mid_end: int = MID_END) -> Column:
    """0 for the first coefficient, then low, middle and high."""
    return F.when(place <= 0, 0).when(place <= low_end, 1).when(place <= mid_end, 2).when(place.isNotNull(), 3)


def band_range(kind: int, low_end: int = LOW_END, mid_end: int = MID_END) -> tuple[int, int]:
    """(start, length) among the 63 later coefficients."""
    return {1: (0, low_end), 2: (low_end, mid_end - low_end), 3: (mid_end, 63 - mid_end)}.get(kind, (0, 0))


def band_slice(block: Column, kind: int, low_end: int = LOW_END, mid_end: int = MID_END) -> Column:
    start, size = band_range(kind, low_end, mid_end)
    return F.slice(block, 2 + start, size) if size else F.array().cast("array<int>")


def dc_token(v: Column) -> Column:
    """(type, raw, nbits) of a difference: magnitude class, then sign and remainder."""
    size = magnitude_class(v)
    rest = F.abs(v) - F.call_function("shiftleft", F.lit(1), size - 1)
    raw = F.when(v == 0, 0).otherwise(F.when(v > 0, 0).otherwise(F.call_function("shiftleft", F.lit(1), size)) + rest)
    return F.struct((64 + size).alias("type"), raw.cast("int").alias("raw"), F.when(v == 0, 0).otherwise(1 + size).alias("nbits"))


def ac_tokens(values: Column) -> Column:
    """Tokens of a run of coefficients: a zero run (0 to 62) and a magnitude each; 63 ends a block whose tail is zero."""
    kind = "struct<run:int,out:array<struct<type:int,raw:int,nbits:int>>>"
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<type:int,raw:int,nbits:int>>").alias("out")).cast(kind)

    def step(s: Column, v: Column) -> Column:
        zero = F.struct(s["run"].alias("type"), F.lit(0).alias("raw"), F.lit(0).alias("nbits"))
        more = F.concat(s["out"], F.array(zero, dc_token(v)).cast("array<struct<type:int,raw:int,nbits:int>>"))
        return F.when(v == 0, F.struct((s["run"] + 1).alias("run"), s["out"].alias("out"))).otherwise(F.struct(F.lit(0).alias("run"), more.alias("out"))).cast(kind)

    end = F.array(F.struct(F.lit(63).alias("type"), F.lit(0).alias("raw"), F.lit(0).alias("nbits"))).cast("array<struct<type:int,raw:int,nbits:int>>")
    return F.concat(F.aggregate(values, start, step)["out"], end)


def untoken_value(token: Column) -> Column:
    size = token["type"] - 64
    one = F.call_function("shiftleft", F.lit(1), size)
    rest = token["raw"].bitwiseAND(one - 1)
    magnitude = F.when(size > 0, F.call_function("shiftleft", F.lit(1), size - 1) + rest).otherwise(0)
    return F.when(token["raw"].bitwiseAND(one) == 0, magnitude).otherwise(-magnitude)


def untoken_ac(tokens: Column, n: int = 63) -> Column:
    """The coefficients of ac_tokens(), padded with zeros to ``n``."""
    empty = F.array().cast("array<int>")

    def step(s: Column, t: Column) -> Column:
        zeros = F.array_repeat(F.lit(0), F.when(t["type"] < 63, t["type"]).otherwise(0))
        return F.when(t["type"] == 63, s).when(t["type"] < 63, F.concat(s, zeros)).otherwise(F.concat(s, F.array(untoken_value(t).cast("int"))))

    got = F.aggregate(tokens, empty, step)
    return F.concat(got, F.array_repeat(F.lit(0), F.lit(n) - F.size(got)))
