"""Colour transforms, predictors and small integer maps.

Integers are BIGINT or INT columns; shifts are arithmetic and divisions truncate, as in the
definitions.  Every function gives null for null input.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blockloom import config


def clamp(v: Column, low: int, high: int) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def quotient(a: Column, b: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer luma and chroma, held in 0 to 255."""
    part = lambda w: F.shiftright(w[0] * r + w[1] * g + w[2] * b, 8)
    return clamp(part(config.LUMA), 0, 255), clamp(part(config.BLUE_DIFFERENCE) + 128, 0, 255), clamp(part(config.RED_DIFFERENCE) + 128, 0, 255)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    u, v = cb - 128, cr - 128
    green = F.shiftright(config.GREEN_OF_BLUE * u + config.GREEN_OF_RED * v, 8)
    return clamp(y + F.shiftright(config.RED_OF_RED * v, 8), 0, 255), clamp(y - green, 0, 255), clamp(y + F.shiftright(config.BLUE_OF_BLUE * u, 8), 0, 255)


def rgb_to_ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The reversible transform."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def ycocg_to_rgb(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    g = cg + t
    b = t - F.shiftright(co, 1)
    r = b + co
    return clamp(r, 0, 255), clamp(g, 0, 255), clamp(b, 0, 255)


def fold_sign(v: Column) -> Column:
    """0, -1, 1, -2, 2 become 0, 1, 2, 3, 4."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unfold_sign(u: Column) -> Column:
    return F.when(u % 2 == 0, quotient(u, 2)).otherwise(-quotient(u + 1, 2))


def low_byte(u: Column) -> Column:
    return u.bitwiseAND(255)


def high_byte(u: Column) -> Column:
    return F.shiftright(u, 8)


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, up and up-left the one nearest to a + b - c; ties in that order."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def med(a: Column, b: Column, c: Column) -> Column:
    """Median edge detector; the plane a + b - c wraps to 16 bits."""
    wrapped = F.pmod(a + b - c + 32768, F.lit(65536)) - 32768
    return F.when(c >= F.greatest(a, b), F.least(a, b)).when(c <= F.least(a, b), F.greatest(a, b)).otherwise(wrapped)


#: Names of the predictors, by id.
PREDICTORS = ("none", "left", "up", "average", "paeth", "med", "three_left", "three_up")


def prediction(kind: int, a: Column, b: Column, c: Column) -> Column:
    if kind == 0:
        return F.lit(0)
    if kind in (1, 2):
        return a if kind == 1 else b
    if kind == 3:
        return quotient(a + b, 2).cast("int")
    if kind == 4:
        return paeth(a, b, c)
    if kind == 5:
        return med(a, b, c)
    return quotient(3 * a + b if kind == 6 else a + 3 * b, 4).cast("int")


def residual_cost(magnitude: Column, photo: bool = False) -> Column:
    """Half bits of a residual: a step with each doubling of its magnitude."""
    out = F.when(magnitude == 0, 1 if photo else 2)
    for step, limit in enumerate((1, 3, 7, 15, 31, 63, 127)):
        out = out.when(magnitude <= limit, 4 + 2 * step)
    return out.when(magnitude.isNotNull(), 20)


def bits_for_count(n: Column) -> Column:
    """Bits of an index into n symbols."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))


def palette_bits(n: Column) -> Column:
    return F.when(n <= 1, 0).when(n <= 2, 1).when(n <= 4, 2).when(n.isNotNull(), 3)


def magnitude_class(v: Column) -> Column:
    """Bit length of the absolute value, at most 11."""
    size = F.abs(v).cast("long")
    return F.when(v == 0, 0).when(v.isNotNull(), F.least(F.lit(11), F.length(F.bin(size))))


#: The small copy vectors, by index (fixed values).
SMALL_VECTORS = ((-8, 0), (0, -8), (-8, -8), (8, -8))


def small_vector_index(dx: Column, dy: Column) -> Column:
    out = F.when(dx.isNull() | dy.isNull(), F.lit(None).cast("int"))
    for k, (x, y) in enumerate(SMALL_VECTORS):
        out = out.when((dx == x) & (dy == y), k)
    return out.otherwise(-1)


def small_vector(index: Column) -> Column:
    out = F.when(index.isNull(), F.lit(None))
    for k, (x, y) in enumerate(SMALL_VECTORS):
        out = out.when(index == k, F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")))
    return out.otherwise(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")))


def cfl_prediction(alpha_q6: Column, beta: Column, y: Column) -> Column:
    return F.shiftright(alpha_q6 * (y - 128) + 32, 6) + beta


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def within_permille(candidate: Column, base: Column, permille: int) -> Column:
    """Integer acceptance with a margin; equality accepts."""
    return candidate.cast("long") * 1000 <= base.cast("long") * permille


def within_percent(candidate: Column, base: Column, percent: int = 98) -> Column:
    return candidate.cast("long") * 100 <= base.cast("long") * percent
