"""Queries over the driver's tables, each with the SQL that gives the same rows.

Integers are BIGINT and reals DOUBLE on both sides.  Where no SQL is given the operator is a byte
codec or a recursion; its query returns what tests check by round trips.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.config import ANIME, PHOTO, UI, ChromaGate, NaturalGate
from blockloom.functions import block as B, pixel as P, text as T
from blockloom.operators import analytics as A, blocks as K, codecs as C, planes as L, search, streams
from blockloom.plans import lossless
from blockloom.sources import adapters as S
from blockloom.sources import container, logs, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: S.longs(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- common parts of the SQL

PLANE = """plane AS (SELECT 'e' AS image_id, CAST(vec_id AS BIGINT) AS y, CAST(i AS BIGINT) AS x,
  greatest(0, least(255, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 240) AS BIGINT) + 128)) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
CELLS = f"""{PLANE}, up AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS b FROM plane),
cells AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM up)"""
PAETH = "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"
MED = "CASE WHEN c >= greatest(a, b) THEN least(a, b) WHEN c <= least(a, b) THEN greatest(a, b) ELSE a + b - c END"
GUESSES = ("0", "a", "b", "(a + b) // 2", PAETH, MED, "(3 * a + b) // 4", "(a + 3 * b) // 4")
RESIDUALS = f"{CELLS}, resid AS (" + " UNION ALL ".join(f"SELECT image_id, y, x, {k} AS f, v - ({g}) AS r FROM cells" for k, g in enumerate(GUESSES)) + ")"
COST = "CASE WHEN abs(r) = 0 THEN {zero} WHEN abs(r) <= 1 THEN 4 WHEN abs(r) <= 3 THEN 6 WHEN abs(r) <= 7 THEN 8 WHEN abs(r) <= 15 THEN 10 WHEN abs(r) <= 31 THEN 12 WHEN abs(r) <= 63 THEN 14 WHEN abs(r) <= 127 THEN 16 ELSE 20 END"
RGB = f"""{PLANE}, rgb AS (SELECT y // 3 AS y, x, max(CASE WHEN y % 3 = 0 THEN v END) AS r, max(CASE WHEN y % 3 = 1 THEN v END) AS g, max(CASE WHEN y % 3 = 2 THEN v END) AS b
  FROM plane GROUP BY y // 3, x HAVING count(*) = 3)"""
PADDED = f"""{PLANE}, tall AS (SELECT * FROM plane UNION ALL SELECT p.image_id, p.y + k, p.x, p.v FROM plane p, (SELECT max(y) AS last FROM plane), (SELECT unnest(range(1, 8)) AS k) WHERE p.y = last AND k <= (8 - (last + 1) % 8) % 8)"""
BLOCKED = f"{PADDED}, blk AS (SELECT image_id, y // 8 AS by_, x // 8 AS bx, (y % 8) * 8 + x % 8 AS p, v FROM tall)"
ARRAYS = f"{BLOCKED}, arr AS (SELECT image_id, by_, bx, list(v ORDER BY p) AS b FROM blk GROUP BY image_id, by_, bx)"
RUNS_LOG = """runlog AS (SELECT l_orderkey * 8 + l_linenumber AS image_id, l_returnflag AS category, l_linestatus AS codec, CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(l_quantity AS DOUBLE) AS ms FROM lineitem)"""
BYTES = """bytes AS (SELECT doc_id AS stream_id, CAST(i AS BIGINT) AS pos, CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2)) AS BIGINT) AS b
  FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents), LATERAL (SELECT unnest(range(length(h) // 2)) AS i))"""


def whole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the padded plane."""
    return L.as_blocks(L.padded(S.plane(spark, sf_dir)))


def patterned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which every third diagonal is blank, so that some have equal neighbours."""
    blank = (F.col("by") + F.col("bx")) % 3 == 0
    return whole_blocks(spark, sf_dir).withColumn("b", F.transform("b", lambda v: F.when(blank, 0).otherwise(v)))


# ---- planes: predictors, residuals, statistics


@query(f"WITH {RESIDUALS}, costs AS (SELECT image_id, y, f, sum(abs(r)) AS cost FROM resid WHERE f <> 5 GROUP BY ALL) SELECT image_id, y, CAST(arg_min(f, cost * 8 + f) AS BIGINT) AS f, CAST(min(cost) AS BIGINT) AS cost FROM costs GROUP BY image_id, y")
def best_row_filter(spark, d):
    return L.best_filters(L.row_costs(S.plane(spark, d)))


@query(f"WITH {RESIDUALS}, costs AS (SELECT image_id, y, f, sum({COST.format(zero=1)}) AS cost FROM resid GROUP BY ALL) SELECT image_id, y, CAST(arg_min(f, cost * 8 + f) AS BIGINT) AS f, CAST(min(cost) AS BIGINT) AS cost FROM costs GROUP BY image_id, y")
def best_row_filter_half_bits(spark, d):
    return L.best_filters(L.row_costs(S.plane(spark, d), "bits", photo=True))


@query(f"""WITH {RESIDUALS}, coarse AS (SELECT image_id, y, f, sum({COST.format(zero=2)}) AS cost FROM resid WHERE f <> 5 GROUP BY ALL),
picked AS (SELECT image_id, y, f FROM coarse QUALIFY row_number() OVER (PARTITION BY image_id, y ORDER BY cost, f) <= 2),
counts AS (SELECT image_id, y, f, r, count(*) AS n FROM resid JOIN picked USING (image_id, y, f) GROUP BY ALL),
fine AS (SELECT image_id, y, f, CAST(round((sum(n) * log2(sum(n)) - sum(n * log2(n))) * 64) AS BIGINT) AS cost FROM counts GROUP BY image_id, y, f)
SELECT image_id, y, CAST(arg_min(f, cost * 8 + f) AS BIGINT) AS f, CAST(min(cost) AS BIGINT) AS cost FROM fine GROUP BY image_id, y""")
def coarse_then_entropy_filter(spark, d):
    return L.coarse_then_fine(S.plane(spark, d), 2, "entropy")


@query(f"WITH {RESIDUALS} SELECT r, count(*) AS n FROM resid WHERE f = 4 GROUP BY r")
def paeth_residual_histogram(spark, d):
    return L.residuals(L.neighbours(S.plane(spark, d)), (4,)).groupBy("r").agg(F.count("*").alias("n"))


@query(f"WITH {RESIDUALS} SELECT CAST(f AS BIGINT) AS f, CAST(sum(abs(r)) AS BIGINT) AS sad, CAST(sum(r) AS BIGINT) AS bias, CAST(max(abs(r)) AS BIGINT) AS worst FROM resid GROUP BY f")
def predictor_summary(spark, d):
    return L.residuals(L.neighbours(S.plane(spark, d))).groupBy("f").agg(F.sum(F.abs("r")).alias("sad"), F.sum("r").alias("bias"), F.max(F.abs("r")).alias("worst"))


@query(f"""WITH {RESIDUALS}, folded AS (SELECT f, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u, r FROM resid)
SELECT CAST(f AS BIGINT) AS f, CAST(sum(u) AS BIGINT) AS folded, CAST(sum(u & 255) AS BIGINT) AS low, CAST(sum(u >> 8) AS BIGINT) AS high, CAST(sum(r) AS BIGINT) AS restored FROM folded GROUP BY f""")
def zigzag_roundtrip(spark, d):
    u = P.fold_sign(F.col("r"))
    each = L.residuals(L.neighbours(S.plane(spark, d))).select("f", u.alias("u"))
    return each.groupBy("f").agg(F.sum("u").alias("folded"), F.sum(P.low_byte(F.col("u"))).alias("low"), F.sum(P.high_byte(F.col("u"))).alias("high"), F.sum(P.unfold_sign(F.col("u"))).alias("restored"))


@query(f"WITH {RESIDUALS}, best AS (SELECT image_id, y, arg_min(f, cost * 8 + f) AS f FROM (SELECT image_id, y, f, sum(abs(r)) AS cost FROM resid WHERE f <> 5 GROUP BY ALL) GROUP BY image_id, y), u AS (SELECT y, x, f, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM resid JOIN best USING (image_id, y, f)) SELECT y, CAST(f AS BIGINT) AS f, CAST(sum(u & 255) AS BIGINT) AS lo, CAST(sum(u >> 8) AS BIGINT) AS hi FROM u GROUP BY y, f")
def split_low_high(spark, d):
    plane = S.plane(spark, d)
    return L.split_residuals(plane, L.best_filters(L.row_costs(plane))).groupBy("y", "f").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))


@query(f"""WITH {PLANE}, steps AS (SELECT y, x, v, lag(v) OVER (PARTITION BY y ORDER BY x) AS p, (SELECT max(y) + 1 FROM plane) AS h FROM plane),
picked AS (SELECT * FROM steps WHERE y % greatest(1, h // greatest(1, least(h, 32))) = 0),
sums AS (SELECT count(*) AS pixels, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) AS runs, sum(abs(v - p)) AS change, count(p) AS steps FROM picked),
uniq AS (SELECT least(count(DISTINCT v), 193) AS u FROM steps WHERE y % greatest(1, h // 64) = 0),
m AS (SELECT 'e' AS image_id, CAST(u AS BIGINT) AS unique_sample, CAST(round(pixels / runs * 100) AS BIGINT) AS avg_run_x100, CAST(round(change / steps * 100) AS BIGINT) AS mean_diff_x100, CAST(round(runs / pixels * 100) AS BIGINT) AS entropy_x100 FROM sums, uniq)
SELECT *, (unique_sample <= 48 OR (unique_sample <= 96 AND avg_run_x100 >= 280)) AND NOT (mean_diff_x100 >= 2200 AND unique_sample > 96) AS likely_screen FROM m""")
def plane_preflight(spark, d):
    plane = S.plane(spark, d)
    height = plane.agg(F.max("y") + 1).first()[0]
    return L.preflight(plane, 64, height)


@query(ORACLES["plane_preflight"].replace("SELECT *, (unique", "SELECT *, unique_sample >= 64 AND avg_run_x100 <= 460 AND mean_diff_x100 >= 20 AND entropy_x100 >= 5 AND NOT likely_screen AS natural_like, mean_diff_x100 <= 80 AND avg_run_x100 >= 320 AS chroma_route FROM (SELECT *, (unique") + ")")
def natural_gate(spark, d):
    plane = S.plane(spark, d)
    height = plane.agg(F.max("y") + 1).first()[0]
    return L.chroma_route(L.natural_like(L.preflight(plane, 64, height), NaturalGate()), ChromaGate())


@query(f"WITH {CELLS} SELECT y, CAST(sum(CASE WHEN greatest(abs(a - c), abs(b - c)) < 16 THEN 0 ELSE 1 END) AS BIGINT) AS edge, count(*) AS n FROM cells GROUP BY y")
def flat_edge_split(spark, d):
    return L.flat_or_edge(L.neighbours(S.plane(spark, d))).groupBy("y").agg(F.sum("context").alias("edge"), F.count("*").alias("n"))


@query(f"""WITH {PLANE}, n AS (SELECT max(y) + 1 AS h FROM plane), q AS (SELECT y // 2 AS y, x // 2 AS x, v, CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END AS w FROM plane, n)
SELECT y, CAST(sum(s >> 2) AS BIGINT) AS total, count(*) AS n FROM (SELECT y, x, CAST(sum(v * w) AS BIGINT) AS s FROM q GROUP BY y, x) GROUP BY y""")
def downsample_420(spark, d):
    return L.halved(S.plane(spark, d)).select("y", K.total(F.col("row")).alias("total"), F.size("row").alias("n"))


@query(f"WITH {PLANE} SELECT y, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted FROM plane GROUP BY y")
def blocks_and_back(spark, d):
    plane = L.cropped(L.from_blocks(L.as_blocks(L.padded(S.plane(spark, d)))), 64, 1 << 40)
    height = S.plane(spark, d).agg((F.max("y") + 1).alias("h"))
    kept = plane.join(F.broadcast(height), F.col("y") < F.col("h"))
    return kept.select("y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"""WITH {PLANE}, byte AS (SELECT y, x, v, lag(v, 1, 0) OVER (PARTITION BY y ORDER BY x) AS a, coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS b FROM plane),
d AS (SELECT y, 0 AS p, v AS d FROM byte UNION ALL SELECT y, 1, ((v - a) % 256 + 256) % 256 FROM byte UNION ALL SELECT y, 2, ((v - b) % 256 + 256) % 256 FROM byte UNION ALL SELECT y, 3, ((v - (a + b) // 2) % 256 + 256) % 256 FROM byte),
c AS (SELECT y, p, sum(least(d, 256 - d)) AS cost FROM d GROUP BY y, p)
SELECT 'e' AS image_id, y, CAST(arg_min(p, cost * 4 + p) AS BIGINT) AS p, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY y""")
def byte_row_predictor(spark, d):
    return L.best_row_predictor(L.row_predictors(S.plane(spark, d)))


@query(f"WITH {PLANE}, z AS (SELECT x, y, greatest(-128, least(127, v - 128)) AS v FROM plane) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM z")
def level_shift(spark, d):
    return S.plane(spark, d).select(F.explode("row").alias("v")).agg(F.count("*").alias("n"), F.sum(P.clamp(F.col("v") - 128, -128, 127)).alias("total"))


# ---- colours


@query(f"""WITH {RGB}, t AS (SELECT y, x, r, g, b, greatest(0, least(255, (77 * r + 150 * g + 29 * b) >> 8)) AS luma, greatest(0, least(255, ((-43 * r - 85 * g + 128 * b) >> 8) + 128)) AS cb,
greatest(0, least(255, ((128 * r - 107 * g - 21 * b) >> 8) + 128)) AS cr FROM rgb) SELECT y, x, luma, cb, cr,
greatest(0, least(255, luma + ((359 * (cr - 128)) >> 8))) AS r2, greatest(0, least(255, luma - ((88 * (cb - 128) + 183 * (cr - 128)) >> 8))) AS g2, greatest(0, least(255, luma + ((454 * (cb - 128)) >> 8))) AS b2 FROM t""")
def ycbcr_both_ways(spark, d):
    y, cb, cr = P.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    out = S.rgb(spark, d).select("y", "x", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))
    r, g, b = P.ycbcr_to_rgb(F.col("luma"), F.col("cb"), F.col("cr"))
    return out.withColumns({"r2": r, "g2": g, "b2": b})


@query(f"""WITH {RGB}, t AS (SELECT y, x, r, g, b, r - b AS co, g - (b + ((r - b) >> 1)) AS cg, b + ((r - b) >> 1) AS t FROM rgb) SELECT y, x, t + (cg >> 1) AS luma, co, cg, r, g, b FROM t""")
def ycocg_roundtrip(spark, d):
    y, co, cg = P.rgb_to_ycocg(F.col("r"), F.col("g"), F.col("b"))
    out = S.rgb(spark, d).select("y", "x", y.alias("luma"), co.alias("co"), cg.alias("cg"))
    r, g, b = P.ycocg_to_rgb(F.col("luma"), F.col("co"), F.col("cg"))
    return out.withColumns({"r": r, "g": g, "b": b})


@query(f"WITH {RGB} SELECT y, x, 'r' AS channel, r AS v FROM rgb UNION ALL SELECT y, x, 'g', g FROM rgb UNION ALL SELECT y, x, 'b', b FROM rgb")
def planes_from_rgb(spark, d):
    return S.rgb(spark, d).unpivot(["y", "x"], ["r", "g", "b"], "channel", "v")


@query(f"""WITH {RGB}, t AS (SELECT y, x, r, greatest(0, least(255, (77 * r + 150 * g + 29 * b) >> 8)) AS luma FROM rgb), e AS (SELECT y, avg(CAST((r - luma) * (r - luma) AS DOUBLE)) AS mse FROM t GROUP BY y)
SELECT y, round(mse, 6) AS mse, CASE WHEN mse <= 0 THEN 99.0 ELSE round(10.0 * log10(255.0 * 255.0 / mse), 6) END AS psnr FROM e""")
def psnr_pairs(spark, d):
    rgb = S.rgb(spark, d)
    luma = rgb.select("y", "x", P.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))[0].alias("v"))
    errors = A.error_between(rgb.select("y", "x", F.col("r").alias("v")), luma, ["y"], "x", "v")
    return errors.select("y", F.round("mse", 6).alias("mse"), F.round(T.psnr(F.col("mse")), 6).alias("psnr"))


# ---- blocks


@query(f"""WITH {BLOCKED}, t AS (SELECT *, lag(v) OVER (PARTITION BY by_, bx ORDER BY p) AS q FROM blk)
SELECT image_id, by_ AS by, bx, CAST(least(count(DISTINCT v), 9) AS BIGINT) AS "unique", CAST(sum(CASE WHEN q <> v THEN 1 ELSE 0 END) AS BIGINT) AS transitions, CAST(sum(v * v) - (sum(v) * sum(v)) // 64 AS BIGINT) AS variance FROM t GROUP BY image_id, by_, bx""")
def block_moments(spark, d):
    return K.moments(whole_blocks(spark, d)).drop("b")


@query(f"""WITH {PLANE}, coarse AS (SELECT image_id, y, x, v // 32 AS v FROM plane), c AS (SELECT y, v, count(*) AS n FROM coarse GROUP BY y, v),
pal AS (SELECT y, list(v ORDER BY n DESC, v) AS colors FROM c GROUP BY y HAVING count(*) <= 8)
SELECT y AS bi, CAST(len(colors) AS BIGINT) AS size, array_to_string(list_transform(colors, lambda z: CAST(z AS VARCHAR)), ',') AS colors,
CAST((SELECT sum(list_position(colors, v) - 1) FROM coarse WHERE coarse.y = pal.y) AS BIGINT) AS index_sum FROM pal""")
def palette_extract(spark, d):
    coarse = S.blocks(spark, d).withColumn("b", F.transform("b", lambda v: P.quotient(v, 32)))
    got = K.palette(coarse).where(F.col("colors").isNotNull())
    return got.select("bi", F.col("colors_size").alias("size"), F.concat_ws(",", F.transform("colors", lambda v: v.cast("string"))).alias("colors"), K.total(F.col("indices")).alias("index_sum"))


@query(f"""WITH {ARRAYS}, cand AS (SELECT a.by_, a.bx, min(k) AS candidate FROM arr a JOIN (VALUES (0, 0, -1), (1, -1, 0), (2, -1, -1), (3, -1, 1)) o(k, dy, dx) ON true JOIN arr s ON s.by_ = a.by_ + dy AND s.bx = a.bx + dx AND s.b = a.b GROUP BY a.by_, a.bx)
SELECT 'e' AS image_id, by_ AS by, bx, CAST(candidate AS BIGINT) AS candidate FROM cand""".replace("v FROM tall)", "CASE WHEN (y // 8 + x // 8) % 3 = 0 THEN 0 ELSE v END AS v FROM tall)"))
def block_copy_match(spark, d):
    return K.copy_matches(patterned(spark, d))


@query(f"""WITH {PADDED}, qd AS (SELECT y // 4 AS qy, x // 4 AS qx, list(CASE WHEN (y // 8 + x // 8) % 3 = 0 THEN 0 ELSE v END ORDER BY y, x) AS c FROM tall GROUP BY y // 4, x // 4),
o(k, dx, dy) AS (VALUES {', '.join(f'({k}, {x // 4}, {y // 4})' for k, (x, y) in enumerate(K.QUADRANT_VECTORS))}),
m AS (SELECT a.qy, a.qx, min(k) AS k FROM qd a JOIN o ON true JOIN qd s ON s.qy = a.qy + dy AND s.qx = a.qx + dx AND s.c = a.c GROUP BY a.qy, a.qx)
SELECT 'e' AS image_id, qy // 2 AS by, qx // 2 AS bx, array_to_string(list(k ORDER BY qy, qx), ',') AS tile4 FROM m GROUP BY qy // 2, qx // 2 HAVING count(*) = 4""")
def tile4_match(spark, d):
    got = K.whole_quadrant_matches(patterned(spark, d))
    return got.withColumn("tile4", F.concat_ws(",", F.transform("tile4", lambda v: v.cast("string"))))


@query(f"""WITH {RESIDUALS}, c AS (SELECT image_id, y // 8 AS by_, x // 8 AS bx, f, sum({COST.format(zero=2)}) + 10 AS bits FROM resid WHERE f <> 5 GROUP BY ALL)
SELECT image_id, by_ AS by, bx, CAST(min(bits) AS BIGINT) AS filter_bits FROM c GROUP BY image_id, by_, bx""")
def block_filter_cost(spark, d):
    return K.filter_costs(S.plane(spark, d))


def decided(spark, d, profile):
    plane = S.plane(spark, d)
    coarse = plane.withColumn("row", F.transform("row", lambda v: P.quotient(v, 64)))
    return K.modes(K.candidates(coarse, L.as_blocks(L.padded(coarse)), profile), profile)


@query()
def mode_select_ui(spark, d):
    return decided(spark, d, UI)


@query()
def mode_select_photo(spark, d):
    return decided(spark, d, PHOTO)


@query()
def mode_mix(spark, d):
    return decided(spark, d, ANIME).groupBy("mode").agg(F.count("*").alias("n"), F.sum("filter_bits").alias("filter_bits"))


@query()
def filter_block_buckets(spark, d):
    return K.filter_block_buckets(decided(spark, d, UI))


@query(f"""WITH {ARRAYS}, hit AS (SELECT DISTINCT a.by_, a.bx FROM arr a JOIN (VALUES (0, -1), (-1, 0), (-1, -1), (-1, 1)) o(dy, dx) ON true JOIN arr s ON s.by_ = a.by_ + dy AND s.bx = a.bx + dx AND s.b = a.b),
n AS (SELECT count(*) AS n, CASE WHEN count(*) < 256 THEN 1 WHEN count(*) < 1024 THEN 2 ELSE 4 END AS every FROM arr),
picked AS (SELECT arr.by_, arr.bx FROM arr, n WHERE arr.by_ % every = 0 AND arr.bx % every = 0),
px AS (SELECT blk.*, lag(v) OVER (PARTITION BY by_, bx, p // 8 ORDER BY p) AS l, lag(v) OVER (PARTITION BY by_, bx, p % 8 ORDER BY p) AS u FROM blk),
sums AS (SELECT count(DISTINCT v // 16) AS bins, sum(coalesce(abs(v - l), 0) + coalesce(abs(v - u), 0)) AS change FROM px JOIN picked USING (by_, bx))
SELECT 'e' AS image_id, CAST((SELECT n FROM n) AS BIGINT) AS n_blocks, CAST((SELECT count(*) FROM picked) AS BIGINT) AS samples, (SELECT count(*) FROM picked JOIN hit USING (by_, bx)) / (SELECT count(*) FROM picked) AS copy_rate,
change / ((SELECT count(*) FROM picked) * 64) AS mean_diff, CAST(bins AS BIGINT) AS active_bins FROM sums""")
def profile_features(spark, d):
    return K.profile_features(whole_blocks(spark, d))


@query()
def profile_classifier(spark, d):
    return K.profile(K.profile_features(whole_blocks(spark, d)))


@query(f"""WITH {PLANE}, b AS (SELECT y AS bi, x, v FROM plane), pair AS (SELECT a.bi, a.v AS y, c.v AS c FROM b a JOIN b c ON c.bi = a.bi + 1 AND c.x = a.x WHERE a.bi % 2 = 0),
s AS (SELECT bi, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(c) AS BIGINT) AS sc, CAST(sum(y * y) * 64 - sum(y) * sum(y) AS BIGINT) AS var, CAST(sum(y * c) * 64 - sum(y) * sum(c) AS BIGINT) AS cov FROM pair GROUP BY bi),
al AS (SELECT *, CASE WHEN var < 1024 THEN 0 ELSE greatest(-255, least(255, (cov * 256 + (var >> 1)) // var)) END AS alpha_q8 FROM s)
SELECT bi, CAST(alpha_q8 AS BIGINT) AS alpha_q8, CAST(CASE WHEN var < 1024 THEN (sc + 32) // 64 ELSE greatest(0, least(255, (sc * 256 - alpha_q8 * (sy - 8192) + 8192) // 16384)) END AS BIGINT) AS beta FROM al""")
def cfl_fit(spark, d):
    blocks = S.blocks(spark, d)
    luma = blocks.where("bi % 2 = 0")
    chroma = blocks.where("bi % 2 = 1").withColumn("bi", F.col("bi") - 1)
    return K.cfl_fit(luma, chroma, ["bi"]).select("bi", "alpha_q8", "beta")


@query(f"""WITH {PLANE}, perm AS (SELECT unnest([{','.join(map(str, B.zigzag_order()))}]) AS x, unnest(range(64)) AS z) SELECT y AS bi, CAST(sum(v * (z + 1)) AS BIGINT) AS weighted, CAST(sum(CASE WHEN z BETWEEN 1 AND 15 THEN v ELSE 0 END) AS BIGINT) AS low,
CAST(sum(CASE WHEN z BETWEEN 16 AND 31 THEN v ELSE 0 END) AS BIGINT) AS mid, CAST(sum(CASE WHEN z > 31 THEN v ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN z > 0 THEN abs(v) ELSE 0 END) AS BIGINT) AS activity FROM plane JOIN perm USING (x) GROUP BY y""")
def zigzag_bands(spark, d):
    z = S.blocks(spark, d).withColumn("z", B.scan(F.col("b")))
    weighted = F.aggregate(F.transform("z", lambda v, k: v.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return z.select("bi", weighted.alias("weighted"), *(K.total(B.band_slice(F.col("z"), k)).alias(n) for k, n in ((1, "low"), (2, "mid"), (3, "high"))), B.activity(F.col("z")).alias("activity"))


_TABLE = B.quant_table(75)


@query(f"""WITH {PLANE}, q AS (SELECT unnest([{','.join(map(str, _TABLE))}]) AS q, unnest(range(64)) AS x), t AS (SELECT y, x, q, sign(v - 128) * ((abs(v - 128) + q // 2) // q) AS k FROM plane JOIN q USING (x))
SELECT y AS bi, CAST(sum(k) AS BIGINT) AS total, CAST(sum(abs(k)) AS BIGINT) AS size, CAST(sum(k * q) AS BIGINT) AS restored FROM t GROUP BY y""")
def quantise_blocks(spark, d):
    k = S.blocks(spark, d).withColumn("k", B.quantise(F.transform("b", lambda v: v - 128), _TABLE))
    return k.select("bi", K.total(F.col("k")).alias("total"), K.total(F.col("k"), F.abs).alias("size"), K.total(B.dequantise(F.col("k"), _TABLE)).alias("restored"))


_BASIS = ", ".join(f"({k}, {n}, {w})" for k, r in enumerate(B.dct_basis()) for n, w in enumerate(r))


@query(f"""WITH {PLANE}, basis(k, n, w) AS (VALUES {_BASIS}), px AS (SELECT y AS bi, x // 8 AS py, x % 8 AS n, v - 128 AS v FROM plane),
rws AS (SELECT bi, py, k AS kx, (CAST(sum(v * w) AS BIGINT) + 4096) >> 13 AS t FROM px JOIN basis USING (n) GROUP BY bi, py, k),
cols AS (SELECT bi, b.k AS ky, kx, (CAST(sum(t * w) AS BIGINT) + 4096) >> 13 AS c FROM rws JOIN basis b ON b.n = rws.py GROUP BY bi, b.k, kx)
SELECT bi, CAST(max(CASE WHEN ky = 0 AND kx = 0 THEN c END) AS BIGINT) AS dc, CAST(sum(c * (ky * 8 + kx + 1)) AS BIGINT) AS weighted FROM cols GROUP BY bi""")
def forward_dct(spark, d):
    c = S.blocks(spark, d).withColumn("c", B.forward_dct(F.transform("b", lambda v: v - 128)))
    return c.select("bi", F.get("c", F.lit(0)).alias("dc"), F.aggregate(F.transform("c", lambda v, k: v.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"""WITH {PLANE}, t AS (SELECT y AS bi, v, CASE WHEN v = 128 THEN 0 ELSE least(11, CAST(floor(log2(abs(v - 128))) AS BIGINT) + 1) END AS m FROM plane WHERE x = 0)
SELECT bi, 64 + m AS type, CASE WHEN m = 0 THEN 0 ELSE (CASE WHEN v < 128 THEN CAST(pow(2, m) AS BIGINT) ELSE 0 END) + abs(v - 128) - CAST(pow(2, m - 1) AS BIGINT) END AS raw, CASE WHEN m = 0 THEN 0 ELSE m + 1 END AS nbits FROM t""")
def dc_tokens(spark, d):
    return S.blocks(spark, d).select("bi", B.dc_token(F.get("b", F.lit(0)) - 128).alias("t")).select("bi", "t.type", "t.raw", "t.nbits")


@query(f"WITH {PLANE} SELECT y AS bi, CAST(sum((v - 128) // 16 * x) AS BIGINT) AS weighted FROM plane WHERE x > 0 GROUP BY y")
def ac_token_roundtrip(spark, d):
    values = F.transform(F.slice("b", 2, 63), lambda v: P.quotient(v - 128, 16).cast("int"))
    back = B.untoken_ac(B.ac_tokens(values))
    return S.blocks(spark, d).select("bi", F.aggregate(F.transform(back, lambda v, k: v.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"""WITH {PLANE}, f AS (SELECT y, v, y % 3 AS kind FROM plane WHERE x = 0) SELECT y AS bi, v - coalesce(lag(v) OVER (ORDER BY y), 0) AS diff, v AS restored FROM f WHERE kind = 0""")
def dc_dpcm(spark, d):
    blocks = S.plane(spark, d).select("image_id", F.col("y").alias("bi"), F.get("row", F.lit(0)).cast("long").alias("dc"), (F.col("y") % 3).alias("kind"))
    return L.dc_restored(L.dc_differences(blocks)).select("bi", "diff", "restored")


@query(f"""WITH {PLANE}, f AS (SELECT y, v, v % 4 AS kind FROM plane WHERE x = 0) SELECT y AS bi, kind, row_number() OVER (PARTITION BY kind ORDER BY y) - 1 AS ordinal FROM f""")
def kind_ordinals(spark, d):
    blocks = S.plane(spark, d).select("image_id", F.col("y").alias("bi"), (F.get("row", F.lit(0)) % 4).alias("kind"))
    return L.ordinals(blocks).select("bi", "kind", "ordinal")


@query(f"""WITH {PLANE}, f AS (SELECT y, v // 64 AS v FROM plane WHERE x = 0) SELECT y AS bi, coalesce(v = lag(v) OVER (ORDER BY y), false) AS reused FROM f""")
def palette_reuse(spark, d):
    blocks = S.plane(spark, d).select("image_id", F.col("y").alias("bi"), F.array(P.quotient(F.get("row", F.lit(0)), 64)).alias("colors"))
    return L.same_as_last(blocks, "colors").select("bi", "reused")


@query(f"""WITH {ARRAYS}, o(k, dy, dx) AS (VALUES {', '.join(f'({k}, {y}, {x})' for k, (y, x) in enumerate([(dy, dx) for dy in (-2, -1) for dx in range(-2, 3)] + [(0, -2), (0, -1)]))}),
m AS (SELECT a.by_, a.bx, k, dy, dx, list_sum(list_transform(list_zip(a.b, s.b), lambda p: abs(p[1] - p[2]))) AS sad FROM arr a JOIN o ON true JOIN arr s ON s.by_ = a.by_ + dy AND s.bx = a.bx + dx)
SELECT 'e' AS image_id, by_ AS by, bx, CAST(arg_min(dx, sad * 100 + k) * 8 AS BIGINT) AS dx, CAST(arg_min(dy, sad * 100 + k) * 8 AS BIGINT) AS dy, CAST(min(sad) AS BIGINT) AS sad FROM m GROUP BY by_, bx""")
def nearest_block(spark, d):
    return K.nearest_block(whole_blocks(spark, d))


@query(f"""WITH {PLANE}, a AS (SELECT y AS bi, CAST(sum(CASE WHEN x > 0 THEN abs(v - 128) ELSE 0 END) AS BIGINT) AS activity FROM plane GROUP BY y), m AS (SELECT *, avg(activity) OVER () AS mean FROM a)
SELECT bi, activity, round(sqrt(activity / mean), 6) AS scale, CAST(greatest(-127, least(127, trunc((sqrt(activity / mean) - 1.0) * 50.0))) AS BIGINT) AS delta FROM m""")
def adaptive_scales(spark, d):
    own = S.blocks(spark, d).select("bi", B.activity(F.transform("b", lambda v: v - 128)).alias("activity"))
    mean = own.agg(F.avg("activity").alias("mean"))
    scaled = own.join(F.broadcast(mean)).withColumn("scale", B.adaptive_scale(F.col("activity"), F.col("mean")))
    return scaled.select("bi", "activity", F.round("scale", 6).alias("scale"), B.adaptive_delta(F.col("scale")).alias("delta"))


@query("SELECT p_brand, CAST(sum(CASE WHEN p_size * 100 <= 50 * 98 THEN 1 ELSE 0 END) AS BIGINT) AS wrapped, CAST(sum(CASE WHEN CAST(floor(p_retailprice) AS BIGINT) * 1000 <= 1400 * 995 THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM part GROUP BY p_brand")
def wrapper_gate(spark, d):
    part = S.table(spark, d, "part")
    ok = lambda c: F.sum(c.cast("long"))
    return part.groupBy("p_brand").agg(ok(P.within_percent(F.col("p_size"), F.lit(50))).alias("wrapped"), ok(P.within_permille(F.floor("p_retailprice"), F.lit(1400), 995)).alias("accepted"))


# ---- byte streams


@query(f"WITH {BYTES}, t AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY stream_id ORDER BY pos) AS p FROM bytes) SELECT stream_id, CAST(sum((((b - p) % 256 + 256) % 256) * (pos % 97 + 1)) AS BIGINT) AS delta, CAST(sum(b * (pos % 97 + 1)) AS BIGINT) AS restored FROM t GROUP BY stream_id")
def delta_roundtrip(spark, d):
    both = lambda x: [(streams.weighted(y := streams.delta(x), 97), streams.weighted(streams.undelta(y), 97))] if len(x) else []
    return streams.map_rows(S.byte_streams(spark, d), both, ["delta", "restored"])


@query(f"WITH {BYTES}, c AS (SELECT stream_id, b, count(*) AS n FROM bytes GROUP BY ALL) SELECT stream_id, CAST(sum(n) AS BIGINT) AS total, CAST(round((sum(n) * log2(sum(n)) - sum(n * log2(n))) * 64) AS BIGINT) AS bits_x64 FROM c GROUP BY stream_id")
def byte_entropy(spark, d):
    return A.entropy_bits(streams.map_rows(S.byte_streams(spark, d), streams.counts, ["b", "n"]), "stream_id")


@query(f"WITH {BYTES}, c AS (SELECT b AS sym, count(*) AS n FROM bytes GROUP BY b), s AS (SELECT CAST(i AS BIGINT) AS sym, coalesce(n, 0) + 1 AS n FROM (SELECT unnest(range(256)) AS i) LEFT JOIN c ON c.sym = i), f AS (SELECT sym, n, greatest(1, (n * 4096 + CAST(sum(n) OVER () AS BIGINT) // 2) // CAST(sum(n) OVER () AS BIGINT)) AS freq FROM s) SELECT sym, n, freq, CAST(coalesce(sum(freq) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM f")
def cdf_prefix(spark, d):
    seen = spark.range(256).select(F.lit(0).alias("k"), F.col("id").alias("sym")).join(F.broadcast(streams.total_counts(S.byte_streams(spark, d))), F.col("sym") == F.col("b"), "left")
    counts = seen.select("k", "sym", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return counts.join(A.scaled_frequencies(counts, "k"), ["k", "sym"]).select("sym", "n", "freq", "lo")


RLE = f"""{PLANE}, s AS (SELECT y, x, v // 32 AS v FROM plane), m AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY y ORDER BY x) THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY y ORDER BY x) AS island FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY y, island ORDER BY x) AS nth FROM i), runs AS (SELECT y, min(x) AS start, any_value(v) AS value, count(*) AS length FROM n GROUP BY y, island, (nth - 1) // 4)"""


def coarse_runs(spark, d):
    cells = S.plane(spark, d).select("y", F.posexplode("row").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), P.quotient(F.col("v"), 32).alias("v"))
    return L.runs(cells, "y", "x", "v", 4)


@query(f"WITH {RLE} SELECT y, start, value, length FROM runs")
def rle_runs(spark, d):
    return coarse_runs(spark, d)


@query(f"WITH {RLE} SELECT value, count(*) AS runs, CAST(sum(CASE WHEN length <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS short_runs, CAST(sum(CASE WHEN length >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS long_runs, CAST(sum(length) AS BIGINT) AS symbols FROM runs GROUP BY value")
def rle_statistics(spark, d):
    return L.run_statistics(coarse_runs(spark, d), 2, 4)


@query(f"WITH {BYTES}, t AS (SELECT stream_id, pos, b, CASE WHEN b % 8 > 5 THEN 0 ELSE b % 8 END AS context FROM bytes) SELECT stream_id, context, count(*) AS n, CAST(sum(b * (k % 89 + 1)) AS BIGINT) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, context ORDER BY pos) AS k FROM t) GROUP BY ALL")
def context_split(spark, d):
    parts = lambda x: ((k, len(part), streams.weighted(part, 89, 1)) for k, part in streams.contexts(x))
    return streams.map_rows(S.byte_streams(spark, d), parts, ["context", "n", "weighted"])


@query(f"WITH {RESIDUALS}, u AS (SELECT y, (CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END) >> 8 AS hi FROM resid WHERE f = 0), z AS (SELECT y, (CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END) >> 8 AS hi FROM resid WHERE f = 4) SELECT y, count(*) AS n, CAST(sum(CASE WHEN hi = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, sum(CASE WHEN hi = 0 THEN 1 ELSE 0 END) >= 0.75 * count(*) AS sparse FROM z GROUP BY y")
def sparse_high_split(spark, d):
    hi = L.residuals(L.neighbours(S.plane(spark, d)), (4,)).withColumn("hi", P.high_byte(P.fold_sign(F.col("r"))))
    zeros = F.sum((F.col("hi") == 0).cast("long"))
    return hi.groupBy("y").agg(F.count("*").alias("n"), zeros.alias("zeros"), (zeros >= 0.75 * F.count("*")).alias("sparse"))


# ---- scalar functions


@query("""SELECT CAST(i AS BIGINT) AS i, CAST(CASE WHEN i <= 1 THEN 0 ELSE ceil(log2(i)) END AS BIGINT) AS bits, CAST(CASE WHEN i <= 1 THEN 0 WHEN i <= 2 THEN 1 WHEN i <= 4 THEN 2 ELSE 3 END AS BIGINT) AS pal_bits,
CAST(CASE WHEN i = 0 THEN 0 ELSE least(11, floor(log2(i)) + 1) END AS BIGINT) AS mag, CAST(CASE WHEN i <= 0 THEN 0 WHEN i <= 15 THEN 1 WHEN i <= 31 THEN 2 ELSE 3 END AS BIGINT) AS band, CAST(bit_count(CAST(i % 16 AS INTEGER)) AS BIGINT) AS pop FROM (SELECT unnest(range(3000)) AS i)""")
def small_integer_maps(spark, d):
    i = F.col("i")
    return spark.range(3000).select(F.col("id").alias("i")).select("i", P.bits_for_count(i).alias("bits"), P.palette_bits(i).alias("pal_bits"), P.magnitude_class(i).alias("mag"), B.band(i).alias("band"), F.bit_count(i % 16).alias("pop"))


@query("SELECT CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, CAST(CASE WHEN dx = -8 AND dy = 0 THEN 0 WHEN dx = 0 AND dy = -8 THEN 1 WHEN dx = -8 AND dy = -8 THEN 2 WHEN dx = 8 AND dy = -8 THEN 3 ELSE -1 END AS BIGINT) AS idx FROM (SELECT unnest([-8, 0, 8, 4]) AS dx), (SELECT unnest([-8, 0, 8]) AS dy)")
def small_vectors(spark, d):
    return A.grid(spark, dx=[-8, 0, 8, 4], dy=[-8, 0, 8]).withColumn("idx", P.small_vector_index(F.col("dx"), F.col("dy")))


@query("SELECT x, y, CAST(x & 255 AS BIGINT) AS r, CAST(y & 255 AS BIGINT) AS g, CAST((x + y) & 255 AS BIGINT) AS b FROM (SELECT unnest(range(320)) AS x), (SELECT unnest(range(64)) AS y)")
def pattern_source(spark, d):
    return synthetic.pattern(spark, 320, 64)


@query("SELECT p_partkey, p_name, CAST(CASE lower(p_type) WHEN 'small' THEN 0 WHEN 'large' THEN 1 ELSE -1 END AS BIGINT) AS kind, replace(p_name, '_', chr(92) || '_') AS escaped, regexp_replace(regexp_extract('out/run_' || p_name || '.v2.csv', '([^/]*)$', 1), '[.][^.]*$', '') AS stem FROM part")
def names_and_paths(spark, d):
    part = S.table(spark, d, "part")
    path = F.concat(F.lit("out/run_"), F.col("p_name"), F.lit(".v2.csv"))
    return part.select("p_partkey", "p_name", T.choice(F.col("p_type"), ("small", "large")).alias("kind"), T.latex_escape(F.col("p_name")).alias("escaped"), T.stem(path).alias("stem"))


# ---- experiment analytics


@query(f"WITH {RUNS_LOG} SELECT category, count(*) AS count, round(avg(size), 4) AS avg_size, round(avg(ms), 4) AS avg_ms FROM runlog GROUP BY category")
def group_summary(spark, d):
    return A.group_means(S.run_log(spark, d), ["category"], ["size", "ms"])


@query(f"WITH {RUNS_LOG} SELECT codec, category, count(*) AS count, round(avg(size), 4) AS avg_size, round(avg(ms), 4) AS avg_ms FROM runlog GROUP BY codec, category")
def two_key_summary(spark, d):
    return A.group_means(S.run_log(spark, d), ["codec", "category"], ["size", "ms"])


@query(f"WITH {RUNS_LOG} SELECT category, median(ms) AS median_ms, CAST(floor(median(size)) AS BIGINT) AS median_size FROM runlog GROUP BY category")
def median_metrics(spark, d):
    return A.medians(S.run_log(spark, d), ["category"], ["ms"], ["size"])


@query("SELECT CAST(coalesce(avg(CASE WHEN event_type IN ('click', 'view') THEN value END), 0.0) AS DOUBLE) AS mean_some FROM events")
def subset_mean(spark, d):
    return A.subset_mean(S.table(spark, d, "events"), "value", F.col("event_type").isin("click", "view"), "mean_some").select(F.col("mean_some"))


@query("""WITH r AS (SELECT o_custkey AS k, CAST(sum(floor(o_totalprice)) AS BIGINT) AS size FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, CAST(sum(floor(o_totalprice)) AS BIGINT) AS base_size FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT r.k, size, coalesce(base_size, 0) AS base_size, b.k IS NOT NULL AS in_baseline, coalesce(size - base_size, 0) AS diff_size FROM r LEFT JOIN b USING (k)""")
def ab_diff(spark, d):
    orders = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.floor("o_totalprice").alias("s"))
    half = lambda n: orders.where(F.col("o_orderkey") % 2 == n).groupBy("k").agg(F.sum("s").alias("size"))
    return A.compared(half(0), half(1), "k", ["size"]).na.fill(0)


@query("""WITH g AS (SELECT a, b, c, ((a * 7 + b * 3 + c) % 5) AS m, (a * b + c) % 7 AS bytes, (a * 100 + b * 10 + c) AS seq FROM (SELECT unnest([1, 2, 3, 4]) AS a), (SELECT unnest([5, 6, 7]) AS b), (SELECT unnest([0, 8, 9]) AS c)) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(m AS BIGINT) AS m, CAST(bytes AS BIGINT) AS bytes FROM g ORDER BY m DESC, bytes, seq LIMIT 5""")
def param_grid_rank(spark, d):
    g = A.grid(spark, a=[1, 2, 3, 4], b=[5, 6, 7], c=[0, 8, 9])
    g = g.withColumns({"m": (F.col("a") * 7 + F.col("b") * 3 + F.col("c")) % 5, "bytes": (F.col("a") * F.col("b") + F.col("c")) % 7})
    return A.top(g, [F.col("m").desc(), F.col("bytes"), F.col("a") * 100 + F.col("b") * 10 + F.col("c")], 5)


@query("SELECT low, mid FROM (SELECT unnest(range(1, 62)) AS low), (SELECT unnest(range(2, 63)) AS mid) WHERE mid > low")
def pair_grid(spark, d):
    return A.pairs(spark.range(1, 62).toDF("low"), spark.range(2, 63).toDF("mid"), "low", "mid")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def resume_pending(spark, d):
    done = S.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return A.pending(S.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), done, ["o_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def resume_finished(spark, d):
    keys = S.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.resumed(keys, S.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 3 = 0")
def insert_missing(spark, d):
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return A.with_missing(s.where("k % 3 <> 0"), s.withColumn("name", F.upper("name")), ["k"])


@query("""WITH r AS (SELECT p_brand, CAST(sum(floor(p_retailprice)) AS BIGINT) AS bytes, CAST(sum(p_size) AS BIGINT) AS ratio FROM part GROUP BY p_brand), g AS (SELECT *, CASE WHEN bytes <= (SELECT CAST(floor(median(bytes)) AS BIGINT) FROM r) AND ratio >= 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM r)
SELECT * FROM g ORDER BY gate DESC, bytes, p_brand LIMIT 10""")
def gate_rank(spark, d):
    r = S.table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.floor("p_retailprice")).alias("bytes"), F.sum("p_size").cast("long").alias("ratio"))
    middle = r.agg(F.floor(F.median("bytes")).alias("middle"))
    gated = A.gated(r.join(F.broadcast(middle)), F.col("middle"), F.lit(0), "bytes", "ratio").drop("middle")
    return A.top(gated, [F.col("gate").desc(), F.col("bytes"), F.col("p_brand")], 10)


@query(f"WITH {RUNS_LOG} SELECT image_id, size, ms, round(size / 50000.0 + greatest(0.0, ms / 20.0 - 1.05) * 8.0, 6) AS score FROM runlog ORDER BY size / 50000.0 + greatest(0.0, ms / 20.0 - 1.05) * 8.0, image_id LIMIT 20")
def penalty_topk(spark, d):
    score = A.penalty_score(F.col("size"), F.lit(50000.0), F.col("ms"), F.lit(20.0))
    best = A.top(S.run_log(spark, d).select("image_id", "size", "ms", score.alias("score")), [F.col("score"), F.col("image_id")], 20)
    return best.withColumn("score", F.round("score", 6))


@query("""WITH a AS (SELECT o_custkey AS k, CAST(sum(floor(o_totalprice)) AS BIGINT) AS cost FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 10) SELECT o_custkey AS k, CAST(max(floor(o_totalprice)) AS BIGINT) AS cost FROM orders WHERE o_custkey IN (SELECT k FROM a) GROUP BY 1""")
def two_pass_refine(spark, d):
    orders = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"))
    price = F.floor("o_totalprice")
    return A.refined(orders.agg(F.sum(price).alias("cost")), orders.agg(F.max(price).alias("cost")), "k", [F.col("cost"), F.col("k")], 10)


@query("""WITH r AS (SELECT p_brand, CAST(max(p_size) AS BIGINT) AS a, CAST(floor(max(p_retailprice)) AS BIGINT) AS b FROM part GROUP BY p_brand) SELECT p_brand, a, b, a + b AS total FROM r WHERE a >= 40 * 0.97 AND b >= 1000 * 0.97 ORDER BY a + b DESC, p_brand LIMIT 1""")
def constrained_best(spark, d):
    r = S.table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").cast("long").alias("a"), F.floor(F.max("p_retailprice")).alias("b"))
    return A.constrained_best(r, {"a": 40, "b": 1000}, 0.97, F.col("a") + F.col("b"), "p_brand")


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def pivot_metrics(spark, d):
    counts = S.table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag").agg(F.count("*").alias("n"))
    return A.wide(counts, "day", "l_returnflag", ["A", "N", "R"], "n").na.fill(0)


@query(f"WITH {RUNS_LOG}, s AS (SELECT category, CAST(sum(size) AS BIGINT) AS bytes FROM runlog GROUP BY category) SELECT category, bytes, round(100.0 * bytes / sum(bytes) OVER (), 6) AS share FROM s")
def component_share(spark, d):
    return A.shares(S.run_log(spark, d), "category", "size").withColumn("share", F.round("share", 6))


@query(f"""WITH {RUNS_LOG}, r AS (SELECT CASE WHEN size * 1000 <= 30000 * 995 THEN 'selected' WHEN ms > 25 THEN 'slow' ELSE 'large' END AS reason FROM runlog), c AS (SELECT reason, count(*) AS n FROM r GROUP BY reason)
SELECT reason, n, CASE WHEN reason <> 'selected' THEN round(100.0 * n / (SELECT sum(n) FROM c WHERE reason <> 'selected'), 6) ELSE 0.0 END AS share FROM c""")
def gate_funnel(spark, d):
    reason = F.when(P.within_permille(F.col("size"), F.lit(30000), 995), "selected").when(F.col("ms") > 25, "slow").otherwise("large")
    return A.funnel(S.run_log(spark, d).select(reason.alias("reason")), "reason").withColumn("share", F.round("share", 6))


@query("SELECT CAST(sum(event_id) AS BIGINT) AS event_id, CAST(sum(user_id) AS BIGINT) AS user_id, round(sum(value), 4) AS value FROM events")
def counter_sums(spark, d):
    return A.counters(S.table(spark, d, "events").select("event_id", "user_id", "value")).withColumn("value", F.round("value", 4))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_row_wins(spark, d):
    return A.last_by_key(S.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(CASE WHEN avg(value) > 0 THEN 1000.0 / avg(value) ELSE 0 END, 6) AS per_second FROM events WHERE value IS NOT NULL AND value > 0 AND isfinite(value) GROUP BY event_type")
def finite_samples(spark, d):
    kept = S.table(spark, d, "events").where(A.finite_positive(F.col("value")))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(T.per_second(F.avg("value")), 6).alias("per_second"))


@query("SELECT c_mktsegment, replace(c_mktsegment, '_', chr(92) || '_') || ' & ' || printf('%.2f', CAST(count(*) AS DOUBLE)) || ' ' || chr(92) || chr(92) AS line FROM customer GROUP BY c_mktsegment")
def latex_table(spark, d):
    counts = S.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return A.latex_rows(counts, "c_mktsegment", ["n"], 2)


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, round(8.0 * p_retailprice / p_size, 6) AS bpp, coalesce(round(p_retailprice / nullif(p_size - 1, 0), 6), 0.0) AS ratio FROM part")
def rates(spark, d):
    part = S.table(spark, d, "part")
    return part.select("p_partkey", "p_size", F.round(T.bits_per_pixel(F.col("p_retailprice"), F.col("p_size")), 6).alias("bpp"), F.round(P.ratio_or_zero(F.col("p_retailprice"), F.col("p_size") - 1), 6).alias("ratio"))


_LOG = """l_orderkey || '_' || l_linenumber || ' ' || printf('%.1f', l_extendedprice) || ' ' || printf('%.1f', l_extendedprice / 2) || ' -50% ' || printf('%.2f', l_quantity) || 'ms ' || printf('%.2f', l_quantity * 2) || 'ms' || l_returnflag"""


@query("SELECT l_orderkey || '_' || l_linenumber AS image, l_returnflag AS category, CAST(printf('%.2f', l_quantity) AS DOUBLE) AS png_dec_ms, CAST(printf('%.2f', l_quantity * 2) AS DOUBLE) AS own_dec_ms, CAST(-50 AS BIGINT) AS size_change_percent, 0.5 AS dec_speedup FROM lineitem WHERE l_linenumber <> 3")
def log_regex_parse(spark, d):
    items = S.table(spark, d, "lineitem")
    ms = lambda c: F.format_string("%.2fms", c)
    good = F.concat_ws(" ", F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.format_string("%.1f", F.col("l_extendedprice")), F.format_string("%.1f", F.col("l_extendedprice") / 2), F.lit("-50%"), ms(F.col("l_quantity").cast("double")), F.concat(ms(F.col("l_quantity").cast("double") * 2), F.col("l_returnflag")))
    lines = items.select(F.when(F.col("l_linenumber") == 3, F.lit("---- banner ----")).otherwise(good).alias("value"))
    return logs.benchmark_rows(lines).select("image", "category", "png_dec_ms", "own_dec_ms", "size_change_percent", "dec_speedup")


# ---- codecs and whole plans


def same_bytes(streams: DataFrame, function, codec=C.map_streams) -> DataFrame:
    """MD5 of what a codec gives back; the SQL has that of the input."""
    back = codec(streams, function, out="back")
    return back.select("stream_id", F.md5("back").alias("digest"), F.octet_length("back").cast("long").alias("n"))


def same_many(streams: DataFrame, function) -> DataFrame:
    """same_bytes() of a codec of many streams."""
    return same_bytes(streams, function, C.map_batches)


def unpacked(coded: list[bytes], streams: list[bytes]) -> list[bytes | None]:
    """LZ streams decoded to the sizes of what was coded."""
    return C.lz_decompress_many(coded, [len(x) for x in streams])


_SAME_DOCUMENTS = "SELECT doc_id AS stream_id, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS n FROM documents"


@query(_SAME_DOCUMENTS)
def lz_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: unpacked(C.lz_compress_many(x), x))


@query(_SAME_DOCUMENTS)
def lz_token_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: unpacked(C.rebuilt_many(C.Tokens(C.lz_compress_many(x)).streams()), x))


@query(_SAME_DOCUMENTS)
def lz_optimal_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: unpacked(C.lz_optimal_many(x), x))


@query(_SAME_DOCUMENTS)
def rans_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: C.adaptive_decode_many(C.adaptive_encode_many(x)))


@query(_SAME_DOCUMENTS)
def shared_model_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: unpacked(C.shared_decode_many(C.shared_encode_many(C.lz_compress_many(x), C.lz_model()), C.lz_model()), x))


@query(_SAME_DOCUMENTS)
def wrapper_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: C.unwrapped_many(C.smallest_many(x, 0xA9), 0xA9))


@query(_SAME_DOCUMENTS)
def bit_pack_roundtrip(spark, d):
    """Low three and high five bits packed apart."""
    low, high = (lambda x: C.unpack_bits(C.pack_bits(x & 7, 3), 3, len(x))), (lambda x: C.unpack_bits(C.pack_bits(x >> 3, 5), 5, len(x)))
    both = lambda x: (np.array(high(x), np.uint8) << 3 | np.array(low(x), np.uint8)).tobytes()
    return same_bytes(S.byte_streams(spark, d), lambda x: both(np.frombuffer(x, np.uint8)) if x else b"")


@query(_SAME_DOCUMENTS)
def restart_point_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), C.through_restarts_many)


@query(f"WITH {PLANE} SELECT y, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted FROM plane GROUP BY y")
def lossless_plane_roundtrip(spark, d):
    back = lossless.decode_planes(lossless.encode_planes(S.plane(spark, d), "balanced"))
    return back.select("y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"WITH {PLANE} SELECT y, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted FROM plane GROUP BY y")
def natural_route_roundtrip(spark, d):
    code = lambda samples: lossless.with_size(samples, lossless.NATURAL, lossless.natural_encode(samples, lossless.PRESETS["balanced"]))
    back = lossless.decode_planes(lossless.encode_planes(S.plane(spark, d), code=code))
    return back.select("y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"WITH {PLANE} SELECT y, CAST(sum((v // 8) * (x + 1)) AS BIGINT) AS weighted FROM plane GROUP BY y")
def screen_route_roundtrip(spark, d):
    coarse = S.plane(spark, d).withColumn("row", F.transform("row", lambda v: P.quotient(v, 8).cast("int")))
    back = lossless.decode_planes(lossless.encode_planes(coarse, code=lambda x: lossless.with_size(x, lossless.SCREEN, lossless.screen_encode(x))))
    return back.select("y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(_SAME_DOCUMENTS)
def separate_streams_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: C.streams_decode_many(C.streams_encode_many(x)))


@query(_SAME_DOCUMENTS)
def token_streams_roundtrip(spark, d):
    return same_many(S.byte_streams(spark, d), lambda x: C.token_streams_decode_many(C.token_streams_encode_many(x), [len(y) for y in x]))


@query()
def nearest_copies(spark, d):
    return search.nearest_copies(L.padded(S.plane(spark, d)))


@query()
def probe_streams(spark, d):
    return C.map_numbers(S.byte_streams(spark, d), C.probe, out="worth_it").groupBy("worth_it").agg(F.count("*").alias("n"))


@query()
def lz_sizes(spark, d):
    streams = S.byte_streams(spark, d)
    return C.map_batches(streams, lambda x: [len(y) for y in C.lz_compress_many(x)], out="lz_bytes", kind="long")


@query()
def codec_choice(spark, d):
    """The smallest of raw, range-coded and LZ for each stream, with its gate."""
    streams = S.byte_streams(spark, d)
    kinds = lambda x: [y[1] if y[:1] == b"\xa9" and y != raw else 0 for raw, y in zip(x, C.smallest_many(x, 0xA9), strict=True)]
    kind = C.map_batches(streams, kinds, out="kind", kind="long")
    return kind.groupBy("kind").agg(F.count("*").alias("n"))


@query()
def low_byte_modes(spark, d):
    """Bytes of each way to code the low bytes of a band."""

    def sizes(table):
        import pyarrow as pa

        order = np.argsort(table.column("y").to_numpy())
        rows = table.column("row").to_pylist()
        samples = np.array([rows[k] for k in order], np.int64)
        _, filters, lines = lossless.tile_parts(lossless.M.padded(samples), lossless.PRESETS["balanced"])
        got = lossless.lo_candidates([x & 255 for x in lines], filters)
        return pa.table({"mode": pa.array([m for m, _ in got], pa.int64()), "n_bytes": pa.array([len(p) for _, p in got], pa.int64())})

    bands = S.plane(spark, d).withColumn("band", F.expr("y div 512"))
    return bands.groupBy("band").applyInArrow(sizes, "mode long, n_bytes long").groupBy("mode").agg(F.sum("n_bytes").alias("n_bytes"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS width, CAST(p_partkey % 100 + 1 AS BIGINT) AS height, CAST(25 AS BIGINT) AS version, true AS valid, CAST(2 AS BIGINT) AS chunks, CAST(strlen(p_name) AS BIGINT) AS pln0, CAST(strlen(p_brand) AS BIGINT) AS unknown FROM part")
def container_headers(spark, d):
    """Containers made of part rows, read back with column expressions."""
    parts = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_name", "p_brand")

    def build(batches):
        import pyarrow as pa

        for b in batches:
            made = [container.pack(container.header(r["p_size"], r["id"] % 100 + 1), [("PLN0", r["p_name"].encode()), ("NOTE", r["p_brand"].encode())]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.binary())], ["id", "content"])

    files = parts.mapInArrow(build, "id long, content binary")
    heads = container.header_columns(files).select("id", "width", "height", "version", "valid")
    rows = container.chunk_rows(files, "id")
    sums = container.accounting(rows, "id", ("PLN0",)).join(rows.groupBy("id").agg(F.count("*").alias("chunks")), "id")
    return heads.join(sums, "id")


def whole_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, rgb bytes, height): 192 lines of the plane make the three channels of 64 x 64 samples; a last part makes a lower one."""
    lines = S.plane(spark, sf_dir).select(F.expr("y div 192").alias("id"), "y", "row")
    return lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("y", "row"))).alias("l")).select("id", F.col("l.row").alias("rows"))


def of_images(spark, d, rows_of, schema: str) -> DataFrame:
    """The rows (image, more) that a function makes of each image."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(rows) // 3
                if n:
                    out += [(k, *r) for r in rows_of(np.stack([np.array(rows[c * n : (c + 1) * n]) for c in range(3)], axis=-1).astype(np.uint8))]
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return whole_images(spark, d).mapInArrow(each, schema)


@query()
def image_compare(spark, d):
    """Bytes and PSNR of lossless and lossy containers of each image."""
    from blockloom.plans import images

    def rows(rgb):
        whole, lossy = images.encode_lossless(rgb), images.encode_lossy(rgb, 75)
        yield len(whole), bool((images.decode(whole) == rgb).all()), len(lossy), round(float(images.psnr(rgb, images.decode(lossy))), 4)

    return of_images(spark, d, rows, "id long, lossless_bytes long, exact boolean, lossy_bytes long, psnr double")


@query()
def quality_bench(spark, d):
    """Bytes and PSNR of each image at three qualities, full and subsampled chroma."""
    from blockloom.plans import images

    rows = lambda rgb: ((int(sub), q, n, round(x, 4)) for sub in (False, True) for q, n, x in images.quality_rows(rgb, subsample=sub))
    return of_images(spark, d, rows, "id long, subsampled long, quality long, n_bytes long, psnr double")


@query()
def screen_bench(spark, d):
    """Palettes and copies on and off: bytes and PSNR of each image in steps of 64, and the differences."""
    from blockloom.plans import images

    got = of_images(spark, d, lambda rgb: [images.screen_comparison(rgb // 64 * 64)], "id long, plain_bytes long, screen_bytes long, plain_psnr double, screen_psnr double")
    return got.withColumns({"saved_percent": A.savings(F.col("plain_bytes"), F.col("screen_bytes")), "gained_db": F.col("screen_psnr") - F.col("plain_psnr")})
