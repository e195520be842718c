"""Views of ordinary tables as planes, blocks, byte streams and run logs.

A *plane* is a table of rows (image_id, y, row array<int>): one record holds a whole line, so
operators along a line are array functions and only the line above needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LONGS = ("tinyint", "smallint", "int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(x: Column) -> Column:
    """A small float as a sample of 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 240).cast("int") + 128))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one plane 64 samples wide: (image_id, y, row)."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.lit("e").alias("image_id"), F.col("vec_id").alias("y"), F.transform("embedding", sample).alias("row"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one 8x8 block in raster order: (bi, b)."""
    return plane(spark, sf_dir).select(F.col("y").alias("bi"), F.col("row").alias("b"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embeddings as a line of colour pixels: (y, x, r, g, b)."""
    lines = plane(spark, sf_dir).select((F.col("y") / 3).cast("long").alias("line"), (F.col("y") % 3).alias("channel"), "row")
    channels = lines.groupBy("line").agg(*(F.max(F.when(F.col("channel") == k, F.col("row"))).alias(c) for k, c in enumerate("rgb")))
    whole = channels.where("r is not null and g is not null and b is not null")
    return whole.select(F.col("line").alias("y"), F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("y", F.col("x").cast("long").alias("x"), "p.r", "p.g", "p.b")


def byte_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' UTF-8 bytes: (stream_id, content)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.col("text").cast("binary").alias("content"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as benchmark results: (image_id, category, codec, size, ms)."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("image_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("codec"),
        F.floor("l_extendedprice").alias("size"),
        F.col("l_quantity").cast("double").alias("ms"),
    )


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, floats as DOUBLE."""
    cast = {c: F.col(c).cast("long") for c, t in df.dtypes if t in LONGS} | {c: F.col(c).cast("double") for c, t in df.dtypes if t == "float" or t.startswith("decimal")}
    return df.withColumns(cast) if cast else df
