"""Names, numbers and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def choice(text: Column, names: tuple[str, ...], numbers: bool = False) -> Column:
    """Index of a name in any case (or of its number); -1 for anything else."""
    low = F.lower(F.trim(text))
    out = F.when(text.isNull(), F.lit(None).cast("int"))
    for k, name in enumerate(names):
        out = out.when((low == name) | (F.lit(numbers) & (low == str(k))), k)
    return out.otherwise(-1)


def strict_choice(text: Column, names: tuple[str, ...]) -> Column:
    """As choice(), for names in all lower or all upper case only."""
    out = F.when(text.isNull(), F.lit(None).cast("int"))
    for k, name in enumerate(names):
        out = out.when(text.isin(name, name.upper()), k)
    return out.otherwise(-1)


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def latex_escape(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def split_plain(line: Column) -> Column:
    """Fields of a comma-separated line without quoting; empty fields stay."""
    return F.split(line, ",", -1)


def bits_per_pixel(n_bytes: Column, pixels: Column) -> Column:
    return F.coalesce(F.try_divide(8.0 * n_bytes, pixels), F.lit(0.0))


def per_second(ms: Column) -> Column:
    return F.when(ms > 0, 1000.0 / ms).otherwise(0.0)


def psnr(mse: Column, exact: float = 99.0, epsilon: float = 0.0) -> Column:
    """10 log10(255² / MSE); ``exact`` where the error is at most ``epsilon``."""
    return F.when(mse <= epsilon, F.lit(exact)).otherwise(10.0 * F.log10(255.0 * 255.0 / mse))
