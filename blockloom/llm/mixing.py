"""Mixing sources to target weights with a time-varying curriculum.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ...; a source's target is its share of
all words, at most ``max_epochs`` times its own words, and what that cuts off is shared anew by
weight.  Each source also has a weight *schedule* over training time t in [0, 1] (piecewise
linear, scaled to its target).  Integrating the schedule gives the source's cumulative token
demand; inverting that demand at the place a document has in its source's (hashed) reading
order gives the document's training positions, and documents are range-sorted by position.

Documents are read whole, ``floor(target / words)`` times each; the rest of the target is read
from the front of the hashed order, so at most one document of a source is read in part
(``whole_documents=True`` rounds that one to all or nothing).

The sums inside a source come from two levels (hash buckets, then rows within a bucket), so a
source with a third of all rows never meets in one task.

Defined results: null text has size 0 and takes nothing; null ids and repeated rows are rows of
their own; equal rows are interchangeable; no words at all gives targets of 0; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.llm.shared import cut, partitions, text_crc32

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Knots (time, relative weight) of each source's schedule, dealt round robin: early, steady, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.5)))
#: Up to so many sources, one row for each is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
ROWS_PER_BUCKET = 20_000
#: A row's place in its source's reading order: so many bits of an MD5 of its id, source and text, which SQL engines share.
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def position(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule has used up the fraction ``demand`` of its integral."""
    parts, total = [], sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    area = demand * total
    before = 0.0
    out: Column | None = None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, have = (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0)
        rest = F.greatest(area - before, F.lit(0.0))
        at = t0 + (rest / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))) - w0) / slope)
        parts.append((area <= before + have, F.least(at, F.lit(t1))))
        before += have
    for holds, at in parts[:-1]:
        out = F.when(holds, at) if out is None else out.when(holds, at)
    return parts[-1][1] if out is None else out.otherwise(parts[-1][1])


def positions(readings: Column, knots: Sequence[tuple[float, float]]) -> Column:
    return F.transform(readings, lambda u: position(u, knots))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds sid, the rank of the source in code-point order, null last: ranks inside ranges, and the ranges' counts before them."""
    by_source = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(partitions(sources.sparkSession), by_source).withColumn("range", F.spark_partition_id()))
    before, total = [], 0
    for r in ranges.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        before += [F.lit(r["range"]), F.lit(total - 1)]
        total += r["n"]
    if not before:
        return ranges.select(*sources.columns, F.lit(0).alias("sid"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(by_source))
    return ranges.withColumn("sid", inside + F.element_at(F.create_map(*before), F.col("range"))).drop("range")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, int]:
    """Per source (source_key, sid, source_size, target), and the number of sources.

    Rounds of capping: each caps the sources above their limit and shares the rest by weight
    among the others; a round is one small aggregate, no row reaches the driver but its sums.
    """
    per_source = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    table = cut(numbered(per_source).withColumn("weight", weight))
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level, cap = 0.0, F.col("source_size") * max_epochs
    while total:
        above = F.col("weight") * level > cap
        kept, capped, free, fixed = table.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(above.cast("int")), F.sum(F.when(~above, F.col("source_size"))), F.coalesce(F.sum(F.when(above, cap)), F.lit(0))).first()
        if not kept:
            break
        new = (total - fixed) / kept
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * level, cap.cast("double"))
    return table.select("source_key", "sid", "source_size", target.alias("target")), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, whole_documents: bool = False) -> DataFrame:
    """Per row: doc_id, text_crc32, source_key, size, source_size, target, taken, positions (one for each reading, ascending)."""
    spark = docs.sparkSession
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        text_crc32(F.col(text_col)).alias("text_crc32"),
        F.col(source_col).alias("source"),
        source_key(F.col(source_col)).alias("source_key"),
        words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5"),
    )
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "source_key", "text_md5")
    sizes = cut(sizes.withColumn("h", F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")).drop("text_md5"))
    per_source, n_sources = targets(sizes, max_epochs, weights)
    rows = sizes.count()
    buckets = max(-(-rows // ROWS_PER_BUCKET), 4 * partitions(spark))
    sizes = sizes.withColumn("bucket", F.expr(f"h div {(1 << HASH_BITS) // buckets + 1}"))
    per_bucket = sizes.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    per_bucket = per_bucket.join(F.broadcast(per_source) if n_sources <= BROADCAST_SOURCES else per_source, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("before_row", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per_bucket, ["source_key", "bucket"])

    size, before, target = F.col("size"), F.col("before_bucket") + F.col("before_row"), F.col("target")
    goal = F.round(target).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(target / F.col("source_size")), F.lit(max_epochs).cast("long"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size") - before
    extra = F.when(rest * 2 >= size, size).otherwise(0) if whole_documents else F.greatest(F.least(rest, size), F.lit(0))
    extra = F.when(epochs < max_epochs, extra).otherwise(0)
    out = out.withColumns({"epochs": epochs, "extra": extra, "before": before, "goal": F.greatest(goal, F.lit(1))})
    readings = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("epochs")),
        lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("before") + F.when(e < F.col("epochs"), size).otherwise(F.col("extra")) / 2) / F.col("goal")),
    )
    keep = F.when(size == 0, 0).otherwise(F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    readings = F.slice(readings, F.lit(1), keep)
    timed = F.lit(None).cast("array<double>")
    for k, knots in enumerate(schedules):
        timed = F.when(F.col("sid") % len(schedules) == k, positions(readings, knots)).otherwise(timed)
    return out.withColumn("positions", timed).select("doc_id", "text_crc32", "source_key", "size", "source_size", "target", (F.col("epochs") * size + F.col("extra")).alias("taken"), "positions", "h")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), range-sorted by their first position; rows that the mix leaves out follow in hash order."""
    first = F.when(F.size("positions") > 0, F.get("positions", F.lit(0))).otherwise(1.0 + F.col("h") / float(1 << HASH_BITS))
    n = partitions(mixed.sparkSession)
    return mixed.withColumn("first_position", first).repartitionByRange(n, "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id").drop("h")
