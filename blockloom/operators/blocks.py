"""Operators on blocks (image_id, by, bx, b array<int>) of 64 samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom import config
from blockloom.config import ANIME, PHOTO, UI, ModeParams
from blockloom.functions.pixel import PREDICTORS, SMALL_VECTORS, clamp, palette_bits, quotient, residual_cost
from blockloom.operators.planes import neighbours, summed_costs

#: Offsets of the quadrant candidates, by index (fixed values).
QUADRANT_VECTORS = ((-4, 0), (0, -4), (-4, -4), (4, -4), (-8, 0), (0, -8), (-8, -8), (8, -8), (-12, 0), (0, -12), (-12, -4), (-4, -12), (-16, 0), (0, -16), (-16, -4), (-4, -16))
NEVER = 1 << 30
KEY = ("image_id", "by", "bx")


def total(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + of(v).cast("long"))


def transitions(values: Column) -> Column:
    """Changes between neighbours in raster order."""
    return F.size(F.filter(F.zip_with(F.slice(values, F.lit(2), F.size(values)), F.slice(values, F.lit(1), F.size(values) - 1), lambda a, b: a != b), lambda x: x))


def moments(blocks: DataFrame, cap: int = 9) -> DataFrame:
    """Distinct values (at most ``cap``), transitions and 64 times the variance."""
    b = F.col("b")
    return blocks.select(*blocks.columns, F.least(F.size(F.array_distinct(b)), F.lit(cap)).alias("unique"), transitions(b).alias("transitions"), (total(b, lambda v: v.cast("long") * v) - quotient(total(b) * total(b), 64)).alias("variance"))


def palette(blocks: DataFrame, most: int = 8) -> DataFrame:
    """Adds colors (by frequency, then value), size, and indices; null where a block has more than ``most`` values."""
    b = F.col("b")
    counted = F.transform(F.array_distinct(b), lambda v: F.struct((-F.size(F.filter(b, lambda x: x == v))).alias("n"), v.alias("v")))
    few = F.size(F.array_distinct(b)) <= most
    with_colors = blocks.withColumn("colors", F.when(few, F.transform(F.array_sort(counted), lambda s: s["v"])))
    return with_colors.withColumn("colors_size", F.size("colors")).withColumn("indices", F.when(F.col("colors").isNotNull(), F.transform("b", lambda v: F.array_position(F.col("colors"), v).cast("int") - 1)))


def palette_cost(colors: Column, changes: Column, profile: int) -> Column:
    """Half bits of a palette block."""
    n = F.size(colors)
    wide = F.size(F.filter(colors, lambda v: (v < -128) | (v > 127)))
    values = (n - wide) * config.COLOR + wide * config.WIDE_COLOR
    head = config.PALETTE_HEAD + values
    pair = head + F.when(changes <= config.PAIR_CHANGES, config.PAIR_FEW).otherwise(config.PAIR_MANY)
    many = head + config.INDEX_BIT * palette_bits(n)
    if profile != PHOTO:
        pair = pair - F.when(changes <= config.PAIR_SAVES[0], config.PAIR_SAVES[1]).otherwise(0)
        saved = F.when(F.lit(False), 0)
        for most, half_bits in config.MANY_SAVE:
            saved = saved.when(changes <= most, half_bits)
        many = many - saved.otherwise(0)
    else:
        many = many + values
    return F.when(n == 0, NEVER).when(n <= 1, head).when(n == 2, pair).otherwise(many)


def copy_cost(profile: int, small: bool = True) -> int:
    return (config.COPY_SMALL if small else config.COPY_ANY) + config.COPY_PROFILE.get(profile, 0)


def copy_matches(blocks: DataFrame) -> DataFrame:
    """Blocks equal to one of their four causal neighbours, with the first such candidate: an equi-join on place and content."""
    places = blocks.select(*KEY, F.xxhash64("b").alias("h"), "b")
    offsets = F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(x // 8).alias("dx"), F.lit(y // 8).alias("dy")) for k, (x, y) in enumerate(SMALL_VECTORS)])
    asked = places.withColumn("o", F.explode(offsets)).select(*KEY, "h", "b", F.col("o.candidate").alias("candidate"), (F.col("by") + F.col("o.dy")).alias("sy"), (F.col("bx") + F.col("o.dx")).alias("sx"))
    source = places.select("image_id", F.col("by").alias("sy"), F.col("bx").alias("sx"), "h", F.col("b").alias("sb"))
    found = asked.join(source, ["image_id", "sy", "sx", "h"]).where(F.col("b") == F.col("sb"))
    return found.groupBy(*KEY).agg(F.min("candidate").alias("candidate"))


def quadrant_matches(blocks: DataFrame, side: int = 8) -> DataFrame:
    """(by, bx, q, candidate): for each 4x4 quadrant the first of 16 earlier places with the same content; places are any multiple of four."""
    quads = blocks.select(*KEY, F.posexplode(F.array(*[F.array(*[F.get("b", F.lit((q // 2 * 4 + y) * 8 + q % 2 * 4 + x)) for y in range(4) for x in range(4)]) for q in range(4)])).alias("q", "c"))
    quads = quads.select(*KEY, "q", "c", (F.col("by") * 2 + quotient(F.col("q"), 2)).alias("qy"), (F.col("bx") * 2 + F.col("q") % 2).alias("qx"))
    offsets = F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(x // 4).alias("dx"), F.lit(y // 4).alias("dy")) for k, (x, y) in enumerate(QUADRANT_VECTORS)])
    asked = quads.withColumn("o", F.explode(offsets)).select(*KEY, "q", "c", F.col("o.candidate").alias("candidate"), (F.col("qy") + F.col("o.dy")).alias("sy"), (F.col("qx") + F.col("o.dx")).alias("sx"))
    source = quads.select("image_id", F.col("qy").alias("sy"), F.col("qx").alias("sx"), "c")
    return asked.join(source, ["image_id", "sy", "sx", "c"]).groupBy(*KEY, "q").agg(F.min("candidate").alias("candidate"))


def whole_quadrant_matches(blocks: DataFrame) -> DataFrame:
    """Blocks all of whose quadrants match, with the four candidates."""
    each = quadrant_matches(blocks).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("q", "candidate"))).alias("m"))
    return each.where(F.size("m") == 4).select(*KEY, F.col("m.candidate").alias("tile4"))


def filter_costs(plane: DataFrame, photo: bool = False) -> DataFrame:
    """Half bits of each block under its best predictor: 10, and the costs of its residuals."""
    kinds = tuple(k for k in range(len(PREDICTORS)) if photo or k != 5)
    keys = [F.col("image_id"), quotient(F.col("y"), 8).alias("by"), quotient(F.col("x"), 8).alias("bx")]
    each = summed_costs(neighbours(plane), keys, kinds, lambda m: residual_cost(m, photo))
    return each.groupBy(*KEY).agg((F.min("cost") + 10).alias("filter_bits"))


def mode_params(profile: int) -> ModeParams:
    """Limits for palette blocks by profile (fixed values)."""
    return {0: ModeParams(8, 58, 2_621_440), 1: ModeParams(8, 62, 4_194_304)}.get(profile, ModeParams(2, 63, 1_040_384))


def candidates(plane: DataFrame, blocks: DataFrame, profile: int) -> DataFrame:
    """Per block the half bits of each mode (NEVER where it doesn't apply): copy, tile4, palette, filter."""
    params = mode_params(profile)
    own = palette(moments(blocks), 8).withColumn("changes", F.when(F.col("indices").isNotNull(), transitions(F.col("indices"))))
    both = own.join(filter_costs(plane, profile == PHOTO), list(KEY)).join(copy_matches(blocks).withColumnRenamed("candidate", "copy_candidate"), list(KEY), "left").join(whole_quadrant_matches(blocks), list(KEY), "left")
    size, changes = F.col("colors_size"), F.col("changes")
    fits = F.col("colors").isNotNull() & (size <= params.palette_max_colors) & ((F.col("transitions") <= params.palette_transition_limit) | (size <= 1)) & (F.col("variance") <= params.palette_variance_limit)
    cost = palette_cost(F.col("colors"), changes, profile)
    if profile == ANIME:
        cost = cost - F.when((size >= 2) & (changes <= config.ANIME_SAVES[0]), config.ANIME_SAVES[1]).otherwise(0)
    rescued = (F.lit(profile != PHOTO) & F.col("colors").isNotNull() & (cost + config.RESCUE < F.col("filter_bits"))) if profile != PHOTO else F.lit(False)
    bias = F.when((changes <= config.BUSY_CHANGES) & (F.col("variance") >= config.BUSY_VARIANCE), config.BUSY_SAVES).otherwise(0) if profile != PHOTO else F.lit(0)
    copy = F.col("copy_candidate").isNotNull()
    return both.select(
        *KEY,
        F.when(copy, copy_cost(profile)).otherwise(NEVER).alias("copy_bits"),
        F.when(~copy & F.col("tile4").isNotNull(), config.QUADRANTS_COST).otherwise(NEVER).alias("tile4_bits"),
        F.when(~copy & F.coalesce(fits | rescued, F.lit(False)), cost - bias).otherwise(NEVER).alias("palette_bits"),
        "filter_bits",
        F.coalesce("copy_candidate", F.lit(-1)).alias("copy_candidate"),
        "unique",
        "transitions",
        "variance",
    )


def chosen_mode(tile4: Column, copy: Column, pal: Column, filt: Column) -> Column:
    """0 filter, 1 palette, 2 copy, 3 four quadrants; ties go to quadrants, copy, palette, filter."""
    return F.when((tile4 <= copy) & (tile4 <= pal) & (tile4 <= filt), 3).when((copy <= pal) & (copy <= filt), 2).when(pal <= filt, 1).otherwise(0)


#: Lines of blocks in a part of an image that one task walks through.
WALKED_LINES = 64
MODE_COSTS = ("filter_bits", "palette_bits", "copy_bits", "tile4_bits")


def walked(bits: list[tuple[int, ...]], last: int) -> list[int]:
    """The modes of blocks in order, from their costs by mode; the mode of the block before is favoured by 4."""
    out = []
    for own in bits:
        if own[2] < NEVER:
            last = 2
        else:
            less = [cost - config.KEPT_MODE * (mode == last and cost < NEVER) for mode, cost in enumerate(own)]
            last = min((3, 2, 1, 0), key=less.__getitem__)  # ties go to the first
        out.append(last)
    return out


def modes(costs: DataFrame, profile: int) -> DataFrame:
    """The mode of each block.

    The photo profile favours the mode of the block before, a recursion in raster order.  Parts of an image are walked from
    each of the four modes that may come before; one row for each part then tells which it was, and parts are walked with that.
    """
    t, c, p, f = (F.col(x) for x in ("tile4_bits", "copy_bits", "palette_bits", "filter_bits"))
    if profile != PHOTO:
        return costs.withColumn("mode", F.when(c < NEVER, 2).otherwise(chosen_mode(t, c, p, f)))
    parts = costs.select(*KEY, quotient(F.col("by"), WALKED_LINES).alias("part"), *(F.col(x).cast("long").alias(x) for x in MODE_COSTS))

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([("by", "ascending"), ("bx", "ascending")])

    def bits(table: pa.Table) -> list[tuple[int, ...]]:
        return list(zip(*(table.column(x).to_pylist() for x in MODE_COSTS), strict=True))

    def ends(table: pa.Table) -> pa.Table:
        own = bits(in_order(table))
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "part": table.column("part").slice(0, 1), **{f"after{k}": pa.array([walked(own, k)[-1]], pa.int32()) for k in range(4)}})

    def starts(table: pa.Table) -> pa.Table:
        table, last, out = table.sort_by("part"), 0, []
        for after in zip(*(table.column(f"after{k}").to_pylist() for k in range(4)), strict=True):
            out.append(last)
            last = after[last]
        return pa.table({"image_id": table.column("image_id"), "part": table.column("part"), "start": pa.array(out, pa.int32())})

    def decided(table: pa.Table) -> pa.Table:
        table = in_order(table)
        return pa.table({**{k: table.column(k) for k in KEY}, "mode": pa.array(walked(bits(table), table.column("start")[0].as_py()), pa.int32())})

    key = f"image_id {dict(costs.dtypes)['image_id']}"
    first = parts.groupBy("image_id", "part").applyInArrow(ends, f"{key}, part long, " + ", ".join(f"after{k} int" for k in range(4)))
    first = first.groupBy("image_id").applyInArrow(starts, f"{key}, part long, start int")
    got = parts.join(first, ["image_id", "part"]).groupBy("image_id", "part").applyInArrow(decided, f"{key}, by long, bx long, mode int")
    return costs.join(got, list(KEY))


def filter_block_buckets(decided: DataFrame) -> DataFrame:
    """Filter blocks by number of distinct values, with their means."""
    u = F.col("unique")
    bucket = F.when(u <= 2, "le2").when(u <= 4, "le4").when(u <= 8, "le8").otherwise("gt8")
    return decided.where("mode = 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("transitions").alias("avg_transitions"), F.avg("variance").alias("avg_variance"), F.avg(F.expr("filter_bits div 2")).alias("avg_bits"))


def cfl_fit(luma: DataFrame, chroma: DataFrame, keys: list[str]) -> DataFrame:
    """Integer least squares of chroma on luma per block: alpha (Q8), beta, and whether the fit is adopted (its error is less by more than 1024)."""
    both = luma.select(*keys, F.col("b").alias("yb")).join(chroma.select(*keys, F.col("b").alias("cb")), keys)
    y, c, n = F.col("yb"), F.col("cb"), F.size("yb").cast("long")
    both = both.withColumns({"n": n, "sy": total(y), "sc": total(c), "syy": total(y, lambda v: v * v), "syc": F.aggregate(F.zip_with(y, c, lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, v: s + v)})
    both = both.withColumns({"var": F.expr("syy * n - sy * sy"), "cov": F.expr("syc * n - sy * sc")})
    low = F.col("var") < 1024
    alpha = F.when(low, 0).otherwise(clamp(F.expr("(cov * 256 + shiftright(var, 1)) div greatest(var, 1)"), -255, 255))
    both = both.withColumn("alpha_q8", alpha.cast("long"))
    beta = F.when(low, F.expr("(sc + shiftright(n, 1)) div n")).otherwise(clamp(F.expr("(sc * 256 - alpha_q8 * (sy - n * 128) + n * 128) div (n * 256)"), 0, 255))
    both = both.withColumn("beta", beta.cast("long")).withColumn("alpha_q6", F.round(F.col("alpha_q8") / 4).cast("long"))
    guess = lambda v: clamp(F.shiftright(F.col("alpha_q6") * (v - 128) + 32, 6) + F.col("beta"), 0, 255)
    fitted = F.aggregate(F.zip_with(y, c, lambda a, b: (b - guess(a)) * (b - guess(a))), F.lit(0).cast("long"), lambda s, v: s + v)
    both = both.withColumns({"error_plain": total(c, lambda v: (v - 128) * (v - 128)), "error_fit": fitted})
    return both.select(*keys, "alpha_q8", "alpha_q6", "beta", "error_plain", "error_fit", (F.col("error_fit") < F.col("error_plain") - 1024).alias("applied"))


def profile_features(blocks: DataFrame, step: int | None = None) -> DataFrame:
    """Per image over sampled blocks: copy hit rate, mean difference between neighbours inside blocks, used sixteenths of the range."""
    size = blocks.groupBy("image_id").agg(F.count("*").alias("n_blocks"))
    every = F.when(F.col("n_blocks") < 256, 1).when(F.col("n_blocks") < 1024, 2).otherwise(4) if step is None else F.lit(step)
    some = blocks.join(size, "image_id").withColumn("every", every).where((F.col("by") % F.col("every") == 0) & (F.col("bx") % F.col("every") == 0))
    hits = copy_matches(blocks).withColumn("hit", F.lit(1))
    b = F.col("b")
    across = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k % 8 > 0, F.abs(F.get(b, k) - F.get(b, k - 1))).otherwise(0) + F.when(k >= 8, F.abs(F.get(b, k) - F.get(b, k - 8))).otherwise(0)), F.lit(0).cast("long"), lambda s, v: s + v)
    bins = F.array_distinct(F.transform(b, lambda v: quotient(clamp(v, 0, 255), 16)))
    each = some.join(hits, list(KEY), "left").select("image_id", "n_blocks", F.coalesce("hit", F.lit(0)).alias("hit"), across.alias("change"), bins.alias("bins"))
    sums = each.groupBy("image_id").agg(F.max("n_blocks").alias("n_blocks"), F.count("*").alias("samples"), F.sum("hit").alias("hits"), F.sum("change").alias("change"), F.size(F.array_distinct(F.flatten(F.collect_set("bins")))).alias("active_bins"))
    return sums.select("image_id", "n_blocks", "samples", (F.col("hits") / F.col("samples")).alias("copy_rate"), (F.col("change") / (F.col("samples") * 64)).alias("mean_diff"), "active_bins")


def profile(features: DataFrame) -> DataFrame:
    """0 UI, 1 anime, 2 photo, by scores of the features."""
    rate, bins, diff = F.col("copy_rate"), F.col("active_bins"), F.col("mean_diff")
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    ui = one(rate >= config.UI_RATE, 3) + one(bins <= config.UI_BINS, 2) + one(diff <= config.UI_DIFFERENCE, 1)
    anime = one((rate >= config.ANIME_RATE[0]) & (rate < config.ANIME_RATE[1]), 2) + one(bins.between(*config.ANIME_BINS), 2) + one(diff <= config.ANIME_DIFFERENCE, 2)
    few = (F.col("n_blocks") < config.LEAST_BLOCKS) | (F.col("samples") < config.LEAST_SAMPLES)
    early = (rate >= config.EARLY_ANIME[0]) & (bins <= config.EARLY_ANIME[1]) & (diff <= config.EARLY_ANIME[2])
    kind = F.when(few, PHOTO).when(early, ANIME).when(ui >= anime + 2, UI).when(anime >= 3, ANIME).otherwise(PHOTO)
    return features.withColumn("profile", kind)


def nearest_block(plane_blocks: DataFrame, radius: int = 2) -> DataFrame:
    """The causal block within ``radius`` blocks with the least sum of differences; the earliest in scan order wins ties.

    The candidates above come before those to the left.  Per block at most (2 radius + 1)² partners,
    joined on their exact places.
    """
    places = [(dy, dx) for dy in range(-radius, 0) for dx in range(-radius, radius + 1)] + [(0, dx) for dx in range(-radius, 0)]
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(places)])
    asked = plane_blocks.withColumn("o", F.explode(offsets)).select(*KEY, "b", "o", (F.col("by") + F.col("o.dy")).alias("sy"), (F.col("bx") + F.col("o.dx")).alias("sx"))
    source = plane_blocks.select("image_id", F.col("by").alias("sy"), F.col("bx").alias("sx"), F.col("b").alias("sb"))
    sad = F.aggregate(F.zip_with("b", "sb", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    best = asked.join(source, ["image_id", "sy", "sx"]).groupBy(*KEY).agg(F.min(F.struct(sad.alias("sad"), F.col("o.k").alias("k"), (F.col("o.dx") * 8).alias("dx"), (F.col("o.dy") * 8).alias("dy"))).alias("m"))
    return best.select(*KEY, "m.dx", "m.dy", "m.sad")


def shared_palettes(blocks: DataFrame, most: int = 255) -> DataFrame:
    """Palettes that occur more than once, with gains, best first; the palette itself breaks ties."""
    counted = blocks.where(F.col("colors").isNotNull()).groupBy("image_id", "colors").agg(F.count("*").alias("n"))
    gain = (F.col("n") - 1) * F.size("colors") - F.col("n")
    order = Window.partitionBy("image_id").orderBy(F.col("gain").desc(), F.col("n").desc(), F.size("colors").desc(), "colors")
    return counted.withColumn("gain", gain).where("gain > 0").withColumn("entry", F.row_number().over(order) - 1).where(F.col("entry") < most)
