"""Made-up images as pixel rows (y, x, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def places(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))


def pattern(spark: SparkSession, width: int, height: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return places(spark, width, height).select("x", "y", x.bitwiseAND(255).alias("r"), y.bitwiseAND(255).alias("g"), (x + y).bitwiseAND(255).alias("b"))


def waves(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Sine, cosine and a modulo gradient."""
    x, y = F.col("x"), F.col("y")
    level = lambda v: F.floor(127.5 * (1 + v)).cast("int")
    return places(spark, width, height).select("x", "y", level(F.sin(x / 50.0)).alias("r"), level(F.cos(y / 50.0)).alias("g"), ((x + y) % 256).cast("int").alias("b"))


def noise(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    level = lambda k: F.floor(F.rand(seed + k) * 256).cast("int")
    return places(spark, width, height).select("x", "y", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


def solid(spark: SparkSession, width: int, height: int, color: tuple[int, int, int] = (128, 128, 128)) -> DataFrame:
    return places(spark, width, height).select("x", "y", *(F.lit(v).alias(c) for c, v in zip("rgb", color, strict=True)))


def mockup(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A window with a title bar, a side bar and lines of text."""
    x, y = F.col("x"), F.col("y")
    level = F.when(y < height // 10, 60).when(x < width // 5, 200).when((y % 12 < 2) & (x % 7 < 5), 20).otherwise(245)
    return places(spark, width, height).select("x", "y", *(level.alias(c) for c in "rgb"))


def natural(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    """Slow waves with normal noise."""
    x, y = F.col("x"), F.col("y")
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 60 * F.sin(x / (20.0 + k)) + 40 * F.sin(y / (31.0 + k)) + 8 * F.randn(seed + k)))).cast("int")
    return places(spark, width, height).select("x", "y", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))
