"""Operators along and across the lines of a plane (image_id, y, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.functions.pixel import PREDICTORS, clamp, high_byte, fold_sign, low_byte, prediction, quotient, residual_cost


#: Places of an order that make a band: windows run inside bands, and one row for each band carries over what came before.
BAND = 4096


def band_of(order: str) -> Column:
    return quotient(F.col(order), BAND)


def with_last(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the value of the row before, in the order of whole numbers ``order``; null for the first row of its keys."""
    banded = df.withColumn("__band", band_of(order))
    inside = Window.partitionBy(*keys, "__band").orderBy(order)
    ends = banded.groupBy(*keys, "__band").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("end"))
    ends = ends.select(*keys, "__band", F.lag("end").over(Window.partitionBy(*keys).orderBy("__band")).alias("__carried"))
    both = banded.withColumns({name: F.lag(value).over(inside), "__nth": F.row_number().over(inside)}).join(ends, [*keys, "__band"])
    return both.withColumn(name, F.when(F.col("__nth") == 1, F.col("__carried.v")).otherwise(F.col(name))).drop("__band", "__nth", "__carried")


def with_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of a value over the rows of the same keys up to and with each row."""
    banded = df.withColumns({"__band": band_of(order), "__value": value})
    upto = Window.partitionBy(*keys, "__band").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    before = banded.groupBy(*keys, "__band").agg(F.sum("__value").alias("all")).select(*keys, "__band", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("__before"))
    both = banded.withColumn(name, F.sum("__value").over(upto)).join(before, [*keys, "__band"])
    return both.withColumn(name, F.col(name) + F.col("__before")).drop("__band", "__value", "__before")


def shifted(row: Column) -> Column:
    """A line moved right by one sample; zero comes in."""
    return F.concat(F.array(F.lit(0)), F.slice(row, F.lit(1), F.greatest(F.size(row) - 1, F.lit(0))))


def neighbours(plane: DataFrame) -> DataFrame:
    """(image_id, y, x, v, a, b, c): each sample with its left, upper and upper-left neighbour, 0 outside.

    One equi-join by line; no window over a column of the plane.
    """
    above = plane.select("image_id", (F.col("y") + 1).alias("y"), F.col("row").alias("above"))
    both = plane.join(above, ["image_id", "y"], "left").withColumn("above", F.coalesce("above", F.transform("row", lambda _: F.lit(0))))
    cells = F.arrays_zip(F.col("row").alias("v"), shifted(F.col("row")).alias("a"), F.col("above").alias("b"), shifted(F.col("above")).alias("c"))
    return both.select("image_id", "y", F.posexplode(cells).alias("x", "n")).select("image_id", "y", F.col("x").cast("long").alias("x"), "n.v", "n.a", "n.b", "n.c")


def residuals(cells: DataFrame, kinds: tuple[int, ...] = tuple(range(len(PREDICTORS)))) -> DataFrame:
    """Adds (f, r): a row for each predictor with the sample less its prediction."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    each = F.array(*[F.struct(F.lit(k).alias("f"), (F.col("v") - prediction(k, a, b, c)).cast("long").alias("r")) for k in kinds])
    return cells.withColumn("e", F.explode(each)).select(*cells.columns, "e.f", "e.r")


def row_costs(plane: DataFrame, model: str = "sad", photo: bool = False) -> DataFrame:
    """(image_id, y, f, cost) of each line under each predictor: sums of magnitudes or of half bits, or entropy times 64."""
    kinds = tuple(k for k in range(len(PREDICTORS)) if photo or k != 5)
    cells = neighbours(plane)
    if model == "entropy":
        counts = residuals(cells, kinds).groupBy("image_id", "y", "f", "r").agg(F.count("*").alias("n"))
        per_row = counts.groupBy("image_id", "y", "f").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("part"))
        return per_row.select("image_id", "y", "f", F.round((F.col("total") * F.log2("total") - F.col("part")) * 64).cast("long").alias("cost"))
    return summed_costs(cells, [F.col("image_id"), F.col("y")], kinds, (lambda m: m) if model == "sad" else (lambda m: residual_cost(m, photo)))


def summed_costs(cells: DataFrame, keys: list[Column], kinds: tuple[int, ...], cost) -> DataFrame:
    """(keys, f, cost): sums of the costs of residuals under each predictor.

    All predictors are summed side by side in one aggregate; rows are only multiplied afterwards.
    """
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    sums = cells.groupBy(*keys).agg(*(F.sum(cost(F.abs(F.col("v") - prediction(k, a, b, c)))).alias(f"cost_{k}") for k in kinds))
    names = [n for n in sums.columns if not n.startswith("cost_")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"cost_{k}").alias("cost")) for k in kinds]))
    return sums.select(*names, each.alias("e")).select(*names, "e.f", "e.cost")


def best_filters(costs: DataFrame) -> DataFrame:
    """The cheapest predictor of each line; ties go to the lowest id."""
    return costs.groupBy("image_id", "y").agg(F.min(F.struct("cost", "f")).alias("best")).select("image_id", "y", F.col("best.f").alias("f"), F.col("best.cost").alias("cost"))


def coarse_then_fine(plane: DataFrame, top_k: int = 2, fine: str = "entropy", photo: bool = False) -> DataFrame:
    """Two-stage choice: the ``top_k`` predictors by half bits, then the best of them by ``fine``."""
    order = Window.partitionBy("image_id", "y").orderBy("cost", "f")
    some = row_costs(plane, "bits", photo).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).select("image_id", "y", "f")
    return best_filters(row_costs(plane, fine, photo).join(some, ["image_id", "y", "f"], "left_semi"))


def split_residuals(plane: DataFrame, filters: DataFrame) -> DataFrame:
    """(image_id, y, x, f, lo, hi): residuals of the chosen predictors, signs folded, as two bytes."""
    each = residuals(neighbours(plane)).join(filters.select("image_id", "y", "f"), ["image_id", "y", "f"])
    folded = fold_sign(F.col("r"))
    return each.select("image_id", "y", "x", "f", low_byte(folded).alias("lo"), high_byte(folded).alias("hi"))


def delta(stream: DataFrame, key: str = "stream_id", pos: str = "pos", value: str = "b") -> DataFrame:
    """Differences modulo 256; the first value stays."""
    order = Window.partitionBy(key).orderBy(pos)
    return stream.withColumn("d", F.pmod(F.col(value) - F.lag(value, 1, 0).over(order), F.lit(256)))


def undelta(stream: DataFrame, key: str = "stream_id", pos: str = "pos", value: str = "d") -> DataFrame:
    order = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("restored", F.pmod(F.sum(value).over(order), F.lit(256)))


def dc_differences(blocks: DataFrame, key: str = "image_id", order: str = "bi", value: str = "dc", kind: str = "kind") -> DataFrame:
    """Each transformed block's first coefficient less that of the transformed block before it."""
    last = with_last(blocks.where(F.col(kind) == 0), [key], order, value, "__last")
    return last.withColumn("diff", F.col(value) - F.coalesce("__last", F.lit(0))).drop("__last")


def dc_restored(differences: DataFrame, key: str = "image_id", order: str = "bi") -> DataFrame:
    return with_total(differences, [key], order, F.col("diff"), "restored")


def runs(stream: DataFrame, key: str, pos: str, value: str, longest: int | None = None) -> DataFrame:
    """(key, start, value, length) of equal values in a row, split after ``longest``."""
    w = Window.partitionBy(key).orderBy(pos)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = stream.withColumn("island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.lit(0)
    if longest:
        marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy(key, "island").orderBy(pos)))
        part = quotient(F.col("nth") - 1, longest)
    marked = marked.withColumn("part", part)
    return marked.groupBy(key, "island", "part").agg(F.min(pos).alias("start"), F.first(value).alias("value"), F.count("*").alias("length")).drop("island", "part")


def run_statistics(all_runs: DataFrame, short: int = 2, long: int = 16) -> DataFrame:
    length = F.col("length")
    return all_runs.groupBy("value").agg(F.count("*").alias("runs"), F.sum((length <= short).cast("int")).alias("short_runs"), F.sum((length >= long).cast("int")).alias("long_runs"), F.sum("length").alias("symbols"))


def row_predictors(lines: DataFrame) -> DataFrame:
    """(image_id, y, p, cost) of byte lines under none, left, up and average; up is the last non-empty line; distances are circular."""
    filled = with_last(lines.where(F.size("row") > 0), ["image_id"], "y", "row", "above")
    both = filled.withColumn("above", F.coalesce("above", F.transform("row", lambda _: F.lit(0))))
    cells = F.arrays_zip(F.col("row").alias("v"), shifted(F.col("row")).alias("a"), F.col("above").alias("b"))
    each = both.select("image_id", "y", F.explode(cells).alias("n")).select("image_id", "y", F.col("n.v"), F.coalesce("n.a", F.lit(0)).alias("a"), F.coalesce("n.b", F.lit(0)).alias("b")).where("v is not null")
    costs = []
    for guess in (F.lit(0), F.col("a"), F.col("b"), quotient(F.col("a") + F.col("b"), 2)):
        d = F.pmod(F.col("v") - guess, F.lit(256))
        costs.append(F.sum(F.least(d, 256 - d)))
    wide = each.groupBy("image_id", "y").agg(*(c.alias(f"c{k}") for k, c in enumerate(costs)))
    return wide.select("image_id", "y", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("p", "cost"))


def best_row_predictor(costs: DataFrame) -> DataFrame:
    return costs.groupBy("image_id", "y").agg(F.min(F.struct("cost", "p")).alias("best")).select("image_id", "y", "best.p", "best.cost")


def flat_or_edge(cells: DataFrame, limit: int = 16) -> DataFrame:
    """Context of each sample: 0 where both gradients at the upper-left neighbour are small, 1 elsewhere."""
    gradient = F.greatest(F.abs(F.col("a") - F.col("c")), F.abs(F.col("b") - F.col("c")))
    return cells.withColumn("context", F.when(gradient < limit, 0).otherwise(1))


def ordinals(blocks: DataFrame, key: str = "image_id", order: str = "bi", kind: str = "kind") -> DataFrame:
    """The running index of each block among those of its kind."""
    return with_total(blocks, [key, kind], order, F.lit(1), "ordinal").withColumn("ordinal", F.col("ordinal") - 1)


def same_as_last(blocks: DataFrame, value: str, key: str = "image_id", order: str = "bi") -> DataFrame:
    return with_last(blocks, [key], order, value, "__last").withColumn("reused", F.coalesce(F.col(value) == F.col("__last"), F.lit(False))).drop("__last")


def preflight(plane: DataFrame, width: int, height: int, cap: int = 192) -> DataFrame:
    """Per image: distinct sampled values (at most ``cap`` + 1), mean run, mean difference and run density, times 100, and the screen flag."""
    sx, sy = max(1, width // 64), max(1, height // 64)
    step = max(1, height // max(1, min(height, 32)))
    grid = plane.where(F.col("y") % sy == 0).select("image_id", F.posexplode("row").alias("x", "v")).where(F.col("x") % sx == 0)
    unique = grid.groupBy("image_id").agg(F.least(F.count_distinct("v"), F.lit(cap + 1)).alias("unique_sample"))
    row = F.col("row")
    differences = F.zip_with(F.slice(row, F.lit(2), F.size(row)), F.slice(row, F.lit(1), F.size(row) - 1), lambda v, p: F.abs(v - p).cast("long"))
    lines = plane.where(F.col("y") % step == 0).select("image_id", F.size(row).cast("long").alias("pixels"), differences.alias("d"))
    sums = lines.groupBy("image_id").agg(
        F.sum("pixels").alias("pixels"),
        F.sum(1 + F.size(F.filter("d", lambda d: d > 0))).alias("runs"),
        F.sum(F.aggregate("d", F.lit(0).cast("long"), lambda s, d: s + d)).alias("change"),
        F.sum(F.size("d")).alias("steps"),
    )
    hundred = lambda a, b: clamp(F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) * 100).cast("long"), 0, 65535)
    out = unique.join(sums, "image_id").select("image_id", "unique_sample", hundred("pixels", "runs").alias("avg_run_x100"), hundred("change", "steps").alias("mean_diff_x100"), hundred("runs", "pixels").alias("entropy_x100"))
    few = (F.col("unique_sample") <= 48) | ((F.col("unique_sample") <= 96) & (F.col("avg_run_x100") >= 280))
    return out.withColumn("likely_screen", few & ~((F.col("mean_diff_x100") >= 2200) & (F.col("unique_sample") > 96)))


def natural_like(metrics: DataFrame, gate) -> DataFrame:
    ok = ~F.col("likely_screen") & (F.col("unique_sample") >= gate.unique_min) & (F.col("avg_run_x100") <= gate.avg_run_max) & (F.col("mean_diff_x100") >= gate.mean_diff_min) & (F.col("entropy_x100") >= gate.entropy_min)
    return metrics.withColumn("natural_like", ok)


def chroma_route(metrics: DataFrame, gate) -> DataFrame:
    return metrics.withColumn("chroma_route", (F.col("mean_diff_x100") <= gate.mean_diff_max) & (F.col("avg_run_x100") >= gate.avg_run_min))


def halved(plane: DataFrame) -> DataFrame:
    """Means of 2x2 samples, rounded down; the last line and column count twice where a size is odd."""
    pairs = lambda r: F.transform(F.sequence(F.lit(0), quotient(F.size(r) - 1, 2).cast("int")), lambda k: F.get(r, 2 * k) + F.get(r, F.least(2 * k + 1, F.size(r) - 1)))
    lines = plane.select("image_id", quotient(F.col("y"), 2).alias("y"), (F.col("y") % 2).alias("odd"), pairs(F.col("row")).alias("s"))
    both = lines.groupBy("image_id", "y").agg(F.max(F.when(F.col("odd") == 0, F.col("s"))).alias("even"), F.max(F.when(F.col("odd") == 1, F.col("s"))).alias("odd"))
    return both.select("image_id", "y", F.zip_with("even", F.coalesce("odd", "even"), lambda a, b: F.shiftright(a + b, 2)).alias("row"))


def doubled(plane: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear enlargement to width x height, ends on ends; a size of one repeats."""
    last = plane.groupBy("image_id").agg(F.max("y").alias("last"))
    ys = last.select("image_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    at = F.col("y") * F.col("last") / (height - 1) if height > 1 else F.lit(0.0)
    ys = ys.select("image_id", "y", F.floor(at).alias("lo"), F.least(F.floor(at) + 1, "last").alias("hi"), (at - F.floor(at)).alias("fy"))
    lo, hi = plane.select("image_id", F.col("y").alias("lo"), F.col("row").alias("r0")), plane.select("image_id", F.col("y").alias("hi"), F.col("row").alias("r1"))
    both = ys.join(lo, ["image_id", "lo"]).join(hi, ["image_id", "hi"])

    def sample(x: Column) -> Column:
        n = F.size("r0")
        place = x * (n - 1) / (width - 1) if width > 1 else x * 0.0
        left = F.floor(place).cast("int")
        right, fx, fy = F.least(left + 1, n - 1), place - F.floor(place), F.col("fy")
        top = F.get("r0", left) * (1 - fx) + F.get("r0", right) * fx
        bottom = F.get("r1", left) * (1 - fx) + F.get("r1", right) * fx
        return F.floor(top * (1 - fy) + bottom * fy + 0.5).cast("int")

    return both.select("image_id", "y", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), sample).alias("row"))


def padded(plane: DataFrame, to: int = 8) -> DataFrame:
    """Sizes rounded up to a multiple by repeating the last column and line."""
    row = F.col("row")
    wide = F.concat(row, F.array_repeat(F.element_at(row, -1), F.pmod(-F.size(row), F.lit(to)).cast("int")))
    lines = plane.select("image_id", "y", wide.alias("row"))
    last = lines.groupBy("image_id").agg(F.max(F.struct("y", "row")).alias("l"))
    more = F.pmod(-(F.col("l.y") + 1), F.lit(to)).cast("int")
    extra = last.where(more > 0).select("image_id", F.explode(F.sequence(F.col("l.y") + 1, F.col("l.y") + more)).alias("y"), F.col("l.row").alias("row"))
    return lines.unionByName(extra)


def cropped(plane: DataFrame, width: int, height: int) -> DataFrame:
    return plane.where(F.col("y") < height).withColumn("row", F.slice("row", 1, width))


def as_blocks(plane: DataFrame, size: int = 8) -> DataFrame:
    """(image_id, by, bx, b): blocks in raster order, from a padded plane."""
    parts = plane.select("image_id", quotient(F.col("y"), size).alias("by"), (F.col("y") % size).alias("line"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("row") / size).cast("int") - 1), lambda k: F.slice("row", k * size + 1, F.lit(size)))).alias("bx", "part"))
    whole = parts.groupBy("image_id", "by", "bx").agg(F.sort_array(F.collect_list(F.struct("line", "part"))).alias("parts"))
    return whole.select("image_id", "by", F.col("bx").cast("long").alias("bx"), F.flatten("parts.part").alias("b"))


def from_blocks(blocks: DataFrame, size: int = 8) -> DataFrame:
    parts = blocks.select("image_id", "by", "bx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.slice("b", k * size + 1, F.lit(size)))).alias("line", "part"))
    lines = parts.groupBy("image_id", (F.col("by") * size + F.col("line")).alias("y")).agg(F.sort_array(F.collect_list(F.struct("bx", "part"))).alias("parts"))
    return lines.select("image_id", "y", F.flatten("parts.part").alias("row"))
