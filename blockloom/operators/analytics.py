"""Experiment analytics: summaries, comparisons, grids, gates and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def histogram(stream: DataFrame, key: str, value: str, symbols: int = 256, plus: int = 1) -> DataFrame:
    """(key, sym, n) for all symbols, each count raised by ``plus``; a symbol that doesn't occur has a row."""
    counts = stream.groupBy(key, F.col(value).cast("long").alias("sym")).agg(F.count("*").alias("c"))
    by_key = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sym", "c"))).alias("m"))
    grid = by_key.select(key, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(symbols - 1).cast("long"))).alias("sym"))
    return grid.select(key, "sym", (F.coalesce(F.try_element_at("m", F.col("sym")), F.lit(0)) + plus).alias("n"))


def entropy_bits(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Sum of n (log2 N - log2 n), times 64 and rounded."""
    sums = counts.where(F.col(n) > 0).groupBy(key).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("part"))
    return sums.select(key, "total", F.round((F.col("total") * F.log2("total") - F.col("part")) * 64).cast("long").alias("bits_x64"))


def scaled_frequencies(counts: DataFrame, key: str, total: int = 4096) -> DataFrame:
    """First step of a model: n scaled to ``total`` with rounding, at least 1, and the cumulative sum before each symbol."""
    w = Window.partitionBy(key)
    before = w.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("all", F.sum("n").over(w))
    freq = F.greatest(F.lit(1).cast("long"), F.expr(f"(n * {total} + all div 2) div all"))
    return sums.select(key, "sym", freq.alias("freq")).withColumn("lo", F.coalesce(F.sum("freq").over(before), F.lit(0)))


def medians(df: DataFrame, keys: list[str], real: list[str] = (), whole: list[str] = ()) -> DataFrame:
    """Medians as the mean of the middle two (0 for none); of whole numbers cut to a whole number."""
    aggs = [F.coalesce(F.median(c), F.lit(0.0)).alias(f"median_{c}") for c in real] + [F.coalesce(F.median(c), F.lit(0.0)).cast("long").alias(f"median_{c}") for c in whole]
    return (df.groupBy(*keys) if keys else df).agg(*aggs)


def group_means(df: DataFrame, keys: list[str], values: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *(F.round(F.avg(v), digits).alias(f"avg_{v}") for v in values))


def subset_mean(df: DataFrame, value: str, condition: Column, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.when(condition, F.col(value))), F.lit(0.0)).alias(name))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")


def compared(results: DataFrame, baseline: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Results beside their baseline; rows without one stay and are marked."""
    base = baseline.select(key, F.lit(True).alias("in_baseline"), *(F.col(m).alias(f"base_{m}") for m in metrics))
    both = results.join(base, key, "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))
    return both.withColumns({f"diff_{m}": F.col(m) - F.col(f"base_{m}") for m in metrics})


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of a few settings, numbered in the order of the axes."""
    out = spark.range(1, numPartitions=1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


#: Settings in a list of pairs.
MOST_SETTINGS = 10_000


def pairs(low: DataFrame, high: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with a < b of two lists of settings; the second is broadcast, so its length is checked."""
    if high.limit(MOST_SETTINGS + 1).count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    return low.join(F.broadcast(high), F.col(a) < F.col(b))


def pending(candidates: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(finished.select(*keys).distinct(), keys, "left_anti")


def resumed(candidates: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return finished.join(candidates.select(*keys).distinct(), keys, "left_semi")


def with_missing(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, and those of ``more`` whose keys they lack."""
    return df.unionByName(more.join(df.select(*keys), keys, "left_anti"))


def gated(df: DataFrame, base_bytes: Column, base_ratio: Column, n_bytes: str, ratio: str) -> DataFrame:
    return df.withColumn("gate", F.when((F.col(n_bytes) <= base_bytes) & (F.col(ratio) >= base_ratio), "PASS").otherwise("FAIL"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order that a last column makes unique."""
    return df.orderBy(*order).limit(k)


def penalty_score(n_bytes: Column, base_bytes: Column, ms: Column, base_ms: Column, slack: float = 1.05, weight: float = 8.0) -> Column:
    return n_bytes / base_bytes + F.greatest(F.lit(0.0), ms / base_ms - slack) * weight


def refined(first: DataFrame, second: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """Two passes: the best ``k`` of the first, ranked anew by the measurements of the second."""
    return second.join(top(first, order, k).select(key), key, "left_semi").orderBy(*order)


def constrained_best(df: DataFrame, floors: dict[str, float], share: float, total: Column, order: str) -> DataFrame:
    """The first row of the largest total among those that keep ``share`` of every floor."""
    ok = F.lit(True)
    for column, floor in floors.items():
        ok = ok & (F.col(column) >= floor * share)
    return df.where(ok).withColumn("total", total).orderBy(F.col("total").desc(), order).limit(1)


def finite_positive(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))


def shares(df: DataFrame, component: str, n_bytes: str) -> DataFrame:
    """Bytes by component and their percentage of all; 0 of nothing."""
    sums = df.groupBy(component).agg(F.sum(n_bytes).alias("bytes"))
    return sums.withColumn("share", F.coalesce(F.try_divide(100.0 * F.col("bytes"), F.sum("bytes").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))


def funnel(df: DataFrame, reason: str) -> DataFrame:
    """Candidates by outcome, with the share of each among the rejected."""
    counts = df.groupBy(reason).agg(F.count("*").alias("n"))
    rejected = F.sum(F.when(F.col(reason) != "selected", F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.when(F.col(reason) != "selected", F.coalesce(F.try_divide(100.0 * F.col("n"), rejected), F.lit(0.0))).otherwise(0.0))


def counters(df: DataFrame) -> DataFrame:
    """Element-wise sums of all numeric columns."""
    return df.agg(*(F.sum(c).alias(c) for c, t in df.dtypes if t in ("int", "bigint", "double")))


def wide(df: DataFrame, key: str, name: str, names: list, value: str) -> DataFrame:
    """One column for each of the given names."""
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def latex_rows(df: DataFrame, label: str, numbers: list[str], digits: int = 4) -> DataFrame:
    """Lines of a LaTeX table."""
    cells = [F.replace(F.col(label), F.lit("_"), F.lit("\\_"))] + [F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in numbers]
    return df.select(label, F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def error_between(a: DataFrame, b: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Mean squared difference per key over the places that both have."""
    other = b.select(*keys, place, F.col(value).alias("other"))
    d = F.col(value) - F.col("other")
    return a.join(other, [*keys, place]).groupBy(*keys).agg(F.avg((d * d).cast("double")).alias("mse"))


def exactly(df: DataFrame, n: int) -> DataFrame:
    """The one count of the rows, or an error if it isn't ``n``."""
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select(F.when(F.col("rows") == n, F.col("rows")).otherwise(F.raise_error(F.concat(F.lit(f"{n} rows expected, got "), F.col("rows").cast("string")))).alias("rows"))


def bits_per_block(n_bytes: Column, blocks: Column) -> Column:
    return F.coalesce(F.try_divide(8.0 * n_bytes, blocks), F.lit(0.0))


def mean_run(blocks: Column, runs: Column) -> Column:
    return F.coalesce(F.try_divide(blocks.cast("double"), runs), F.lit(0.0))


def savings(raw: Column, coded: Column) -> Column:
    """Percent of the raw bytes that coding saves; 0 of nothing."""
    return F.coalesce(100.0 * (1.0 - F.try_divide(coded, raw)), F.lit(0.0))


def scaled_mean(total: Column, count: Column, fallback: Column, scale: int) -> Column:
    """Mean of a sum that is kept times ``scale``; where nothing was counted, over the fallback count."""
    return F.coalesce(F.try_divide(total.cast("double"), F.when(count > 0, count).otherwise(fallback)) / scale, F.lit(0.0))


def reasons(df: DataFrame, mode: str, reason: str, names: list[str], size: str, taken: str = "taken") -> DataFrame:
    """Per mode the candidates, how many had each outcome, and the mean size of those not taken."""
    each = [F.count_if(F.col(reason) == n).alias(n) for n in names]
    return df.groupBy(mode).agg(F.count("*").alias("n"), *each, F.avg(F.when(F.col(reason) != taken, F.col(size))).alias("mean_rejected"))
