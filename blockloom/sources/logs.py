"""Benchmark logs and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed pattern of a result line: with decode times, or in the older form with speed-ups.
NUMBER = r"[0-9.]+"
TIMES_OR_FACTORS = rf"(?:{NUMBER}ms\s+{NUMBER}ms|{NUMBER}x\s+{NUMBER}x)"
RESULT = rf"^\s*\S+\s+{NUMBER}\s+{NUMBER}\s+[+\-][0-9]+%\s+{TIMES_OR_FACTORS}[A-Za-z]+\s*$"


def benchmark_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row for each line of either form; other lines are dropped, missing figures are 0.

    One pattern decides, then a line is cut at its blanks and the units off its fields.
    """
    fields = lines.where(F.col(column).rlike(RESULT)).select(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ").alias("f"))
    field = lambda k: F.get("f", F.lit(k))
    parts = fields.select("f", F.endswith(field(4), F.lit("ms")).alias("timed"), F.regexp_extract(field(5), r"^[0-9.]+", 0).alias("second"))
    unit = F.when(F.col("timed"), 2).otherwise(1)
    num = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    raw = parts.select(field(0).alias("image"), F.substring(field(5), F.length("second") + unit + 1, F.lit(1 << 30)).alias("category"), num(field(1)).alias("png_kb"), num(field(2)).alias("own_kb"), F.rtrim(field(3), F.lit("%")).cast("long").alias("size_change_percent"), "timed", num(F.substring(field(4), F.lit(1), F.length(field(4)) - unit)).alias("first"), num(F.col("second")).alias("second"))
    timed = F.col("timed")
    png, own = F.when(timed, F.col("first")).otherwise(0.0), F.when(timed, F.col("second")).otherwise(0.0)
    speed = F.when((png > 0) & (own > 0), png / own).otherwise(F.when(timed, 0.0).otherwise(F.col("second")))
    ratio = F.when(F.col("png_kb") > 0, F.round(F.col("own_kb") / F.col("png_kb"), 4)).otherwise(0.0)
    return raw.select("image", "category", "png_kb", "own_kb", F.round(png, 4).alias("png_dec_ms"), F.round(own, 4).alias("own_dec_ms"), ratio.alias("size_ratio"), "size_change_percent", F.when(timed, 0.0).otherwise(F.col("first")).alias("enc_speedup"), F.round(speed, 4).alias("dec_speedup"))


def category_summary(rows: DataFrame) -> DataFrame:
    """Means of the rounded figures by category, rounded to four places."""
    names = ("size_ratio", "enc_speedup", "dec_speedup", "png_dec_ms", "own_dec_ms")
    return rows.groupBy("category").agg(F.count("*").alias("count"), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in names)).orderBy("category")


def scraped(lines: DataFrame, pattern: str, name: str, column: str = "value") -> DataFrame:
    """The first group of a pattern in the lines that have it."""
    return lines.where(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).cast("double").alias(name))


def total_bytes(lines: DataFrame) -> DataFrame:
    return scraped(lines, r"TOTAL\s+([0-9]+)", "bytes").agg(F.sum("bytes").cast("long").alias("total_bytes"))


def decode_times(lines: DataFrame) -> DataFrame:
    return scraped(lines, r"Average Decode Time:\s*([0-9.]+)\s*ms", "ms")


def kept(lines: DataFrame, words: list[str], column: str = "value") -> DataFrame:
    """Lines with any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col(column).contains(w)
    return lines.where(hit)


def curve_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(codec, quality, n_bytes, psnr, ms, bpp) of blank-separated lines with six fields or more and no N/A; sizes other than Full HD count as 768x512."""
    f = F.split(F.trim(F.col(column)), r"\s+")
    num = lambda k: F.get(f, F.lit(k)).try_cast("double")
    pixels: Column = F.when(F.col(column).contains("1920x1080"), 1920 * 1080).otherwise(768 * 512)
    some = lines.where((F.size(f) >= 6) & ~F.col(column).contains("N/A") & num(2).isNotNull())
    return some.select(F.get(f, F.lit(0)).alias("codec"), num(1).alias("quality"), num(2).alias("n_bytes"), num(3).alias("psnr"), num(4).alias("ms"), (8.0 * num(2) / pixels).alias("bpp")).orderBy("bpp", "psnr")


def baseline(spark: SparkSession, path: str, columns: list[str], least: int = 13) -> DataFrame:
    """A results file, or a folder of them in order of names, read by position: the header, blank and short lines are left out,
    the last row of a key wins.

    Files are read in any order and large ones in parts, so a line's place is its file, its part and its number there.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("at"))
    fields = F.split("value", ",", -1)
    rows = lines.where((F.trim("value") != "") & (F.size(fields) >= least) & (F.get(fields, F.lit(0)) != columns[0]))
    named = rows.select("at", *(F.get(fields, F.lit(k)).alias(c) for k, c in enumerate(columns)))
    return named.groupBy(columns[0]).agg(F.max_by(F.struct(*columns[1:]), "at").alias("r")).select(columns[0], "r.*")


def results(spark: SparkSession, path: str, text_columns: tuple[str, ...] = ("image_id", "image_name")) -> DataFrame:
    """A results file by column names, all but the named text columns as numbers."""
    df = spark.read.csv(path, header=True)
    return df.select(*(F.col(c) if c in text_columns else F.col(c).try_cast("double").alias(c) for c in df.columns))


def write_results(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a header and fixed decimals."""
    fixed = {c: F.format_string(f"%.{digits}f", F.col(c)) for c, t in df.dtypes if t == "double"}
    df.withColumns(fixed).write.mode("overwrite").csv(path, header=True)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def checkpoint_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved results, or none if nothing has been saved."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)
