"""More queries with the SQL that gives the same rows: files and containers, logs, serialised streams, block modes, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom import config
from blockloom.config import ANIME, PHOTO, UI
from blockloom.functions import block as B, pixel as P, text as T
from blockloom.operators import analytics as A, blocks as K, codecs as C, planes as L
from blockloom.queries import ORACLES, PADDED, PLANE, QUERIES, RESIDUALS, RGB, RUNS_LOG, decided, query, whole_blocks
from blockloom.sources import adapters as S, container, logs, png, synthetic

# ---- images as files: each line of 64 colour pixels is an image of 8 x 8

_PIXEL_SUMS = f"""WITH {RGB} SELECT CAST(y AS VARCHAR) AS image_id, plane, x // 8 AS y, CAST(sum(v * (x % 8 + 1)) AS BIGINT) AS weighted
FROM (SELECT y, x, 'r' AS plane, r AS v FROM rgb UNION ALL SELECT y, x, 'g', g FROM rgb UNION ALL SELECT y, x, 'b', b FROM rgb) GROUP BY y, plane, x // 8"""


def image_files(spark, d, write) -> DataFrame:
    """(path, content) of images that ``write`` makes of (8, 8, 3) samples and a number."""
    lines = S.rgb(spark, d).groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    flat = lines.select("y", F.flatten(F.transform("p", lambda q: F.array(q["r"], q["g"], q["b"]))).alias("rgb"))

    def each(batches):
        for batch in batches:
            made = [write(np.array(v, np.uint8).reshape(8, 8, 3), y) for y, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return flat.mapInArrow(each, "path string, content binary")


def line_sums(images: DataFrame) -> DataFrame:
    lines = container.pixmap_lines(images)
    return lines.select("image_id", "plane", "y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(_PIXEL_SUMS)
def pixmap_files(spark, d):
    """P6 files with a comment, beside files that are cut off or of another kind."""
    comment = lambda p, y: container.write_ppm(p).replace(b"P6\n", b"P6\n# %d\n" % y, 1)
    good = image_files(spark, d, comment).where(container.is_ppm(F.col("content")))
    bad = good.select(F.concat(F.lit("cut"), "path").alias("path"), F.substring("content", 1, 60).alias("content")).union(good.select("path", F.lit(b"P5\n1 1\n255\n0").alias("content")))
    return line_sums(container.pixmaps(good.union(bad)))


@query(_PIXEL_SUMS)
def png_files(spark, d):
    """PNG files whose lines take all five filters in turn, beside damaged ones."""
    good = image_files(spark, d, lambda p, y: png.write_png(p, [(y + k) % 5 for k in range(5)]))
    return line_sums(png.images(good.union(good.select(F.concat(F.lit("cut"), "path").alias("path"), F.substring("content", 1, 50).alias("content")))))


_JPEG = ", ".join(f"({k}, {v}, {w})" for k, (v, w) in enumerate(zip(B.BASE_LUMA, B.BASE_CHROMA, strict=True)))


@query(f"""WITH base(k, l, c) AS (VALUES {_JPEG}), q AS (SELECT unnest(range(1, 101)) AS quality), pair AS (SELECT quality, greatest(1, least(100, quality - 12)) AS chroma FROM q),
s AS (SELECT *, CASE WHEN quality < 50 THEN CAST(5000.0 AS FLOAT) / CAST(quality AS FLOAT) ELSE CAST(200 - 2 * quality AS FLOAT) END AS sl, CASE WHEN chroma < 50 THEN CAST(5000.0 AS FLOAT) / CAST(chroma AS FLOAT) ELSE CAST(200 - 2 * chroma AS FLOAT) END AS sc FROM pair)
SELECT CAST(quality AS BIGINT) AS quality, CAST(chroma AS BIGINT) AS chroma, CAST(2 AS BIGINT) AS n_tables, CAST(sum(greatest(1, least(255, CAST(trunc((CAST(l AS FLOAT) * sl + CAST(50 AS FLOAT)) / CAST(100 AS FLOAT)) AS BIGINT))) * (k + 1)) AS BIGINT) AS luma_sum,
CAST(sum(greatest(1, least(255, CAST(trunc((CAST(c AS FLOAT) * sc + CAST(50 AS FLOAT)) / CAST(100 AS FLOAT)) AS BIGINT))) * (k + 1)) AS BIGINT) AS chroma_sum FROM s, base GROUP BY quality, chroma""")
def quantiser_chunks(spark, d):
    """Table chunks of all qualities, written and parsed."""

    def each(batches):
        for batch in batches:
            out = []
            for q in batch.column(0).to_pylist():
                chroma = B.chroma_quality(q)
                data = container.quant_chunk(q, [B.quant_table(q), B.quant_table(chroma, True), B.quant_table(chroma, True)])
                got, tables = container.parse_quant_chunk(data)
                sums = [sum(v * (k + 1) for k, v in enumerate(t)) for t in tables]
                out.append((got, chroma, len(set(map(tuple, tables[1:]))) + 1, sums[0], sums[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["quality", "chroma", "n_tables", "luma_sum", "chroma_sum"])

    return spark.range(1, 101).mapInArrow(each, "quality long, chroma long, n_tables long, luma_sum long, chroma_sum long")


_STREAMS = ("filter_ids", "lo", "hi", "block_types", "palette", "copy", "tile4")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(strlen(p_name) AS BIGINT) AS filter_ids, CAST(strlen(p_brand) AS BIGINT) AS lo, CAST(strlen(p_type) AS BIGINT) AS hi, CAST(p_size AS BIGINT) AS pixels, CAST(1 AS BIGINT) AS block_types, CAST(2 AS BIGINT) AS palette, CAST(3 AS BIGINT) AS copy, CAST(4 AS BIGINT) AS tile4, CAST(42 + strlen(p_name) + strlen(p_brand) + strlen(p_type) AS BIGINT) AS tile_bytes FROM part")
def tile_accounting(spark, d):
    """The bytes of the streams inside a tile, from its eight sizes, as column expressions."""
    body = [F.col(c).cast("binary") for c in ("p_name", "p_brand", "p_type")] + [F.expr(f"cast(repeat('x', {n}) as binary)") for n in (1, 2, 3, 4)]
    size = lambda v: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))
    sizes = [F.octet_length(b).cast("long") for b in body]
    tile = F.concat(*[size(s) for s in (*sizes[:3], F.col("p_size").cast("long"), *sizes[3:])], *body)
    tiles = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), tile.alias("content"))
    return container.tile_accounting(tiles, "id")


# ---- logs and result files


@query(r"""WITH t AS (SELECT * FROM lineitem WHERE l_linenumber <= 4) SELECT CASE WHEN l_linenumber = 1 THEN 'own' ELSE 'other' END AS codec, CAST(l_orderkey AS DOUBLE) AS quality, CAST(floor(l_extendedprice) AS DOUBLE) AS n_bytes, CAST(l_quantity AS DOUBLE) AS psnr, CAST(l_linenumber AS DOUBLE) AS ms,
8.0 * floor(l_extendedprice) / CASE WHEN l_linenumber = 2 THEN 1920 * 1080 ELSE 768 * 512 END AS bpp FROM t WHERE l_linenumber NOT IN (3, 4)""")
def rate_curve_lines(spark, d):
    """Blank-separated result lines, beside short ones and ones without figures."""
    n = F.col("l_linenumber")
    line = F.format_string("%s %d %d %d %d %s", F.when(n == 1, "own").otherwise("other"), F.col("l_orderkey"), F.floor("l_extendedprice"), F.floor("l_quantity"), n, F.when(n == 2, "a_1920x1080.ppm").when(n == 3, "N/A").otherwise("b.ppm"))
    lines = S.table(spark, d, "lineitem").where(n <= 4).select(F.when(n == 4, F.lit("---- own banner")).otherwise(F.concat(F.lit("  "), F.replace(line, F.lit(" "), F.lit("   ")))).alias("value"))
    return logs.curve_rows(lines)


@query("SELECT CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_bytes, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1) AS BIGINT) AS times, round((SELECT avg(o_orderkey % 100 + 0.5) FROM orders WHERE o_orderkey % 3 = 1), 6) AS mean_ms FROM orders WHERE o_orderkey % 3 = 0")
def scraped_totals(spark, d):
    """Totals and decode times picked out of a log by patterns."""
    o = F.col("o_orderkey")
    line = F.when(o % 3 == 0, F.format_string("  TOTAL   %d bytes", F.floor("o_totalprice"))).when(o % 3 == 1, F.format_string("Average Decode Time: %.1f ms", (o % 100 + 0.5).cast("double"))).otherwise("nothing of use: 17")
    lines = S.table(spark, d, "orders").select(line.alias("value"))
    times = logs.decode_times(lines).agg(F.count("*").alias("times"), F.round(F.avg("ms"), 6).alias("mean_ms"))
    return logs.total_bytes(lines).join(F.broadcast(times))


@query("SELECT o_orderkey, o_comment AS value FROM (SELECT o_orderkey, o_orderstatus || ' ' || o_orderkey || ' natural_' || (o_orderkey % 7) AS o_comment FROM orders) WHERE contains(o_comment, 'natural_3') OR contains(o_comment, 'F 1')")
def kept_lines(spark, d):
    line = F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string"), F.concat(F.lit("natural_"), (F.col("o_orderkey") % 7).cast("string")))
    return logs.kept(S.table(spark, d, "orders").select("o_orderkey", line.alias("value")), ["natural_3", "F 1"])


@query("SELECT p_partkey, CAST(4 AS BIGINT) AS n_fields, CAST(p_partkey AS VARCHAR) AS first, '' AS third, '\"' || p_brand AS last FROM part")
def plain_fields(spark, d):
    """Comma-separated fields without quoting; empty ones stay."""
    part = S.table(spark, d, "part")
    fields = T.split_plain(F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit(""), F.concat(F.lit('"'), F.col("p_brand"))))
    f = part.select("p_partkey", fields.alias("f"))
    return f.select("p_partkey", F.size("f").alias("n_fields"), F.get("f", F.lit(0)).alias("first"), F.get("f", F.lit(2)).alias("third"), F.get("f", F.lit(3)).alias("last"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS value FROM part""")
def json_report(spark, d):
    return logs.as_json(S.table(spark, d, "part").select("p_partkey", "p_brand", "p_size"))


def saved(spark, d, form: str) -> str:
    """A scratch folder of the session in the shared warehouse; it goes with the driver's JVM."""
    jvm = spark.sparkContext._jvm
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/blockloom-results-{spark.sparkContext.applicationId}/{form}-{jvm.java.util.UUID.randomUUID()}"
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    files.deleteOnExit(place.getParent())
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS image_id, CAST(p_size AS DOUBLE) AS size, p_retailprice / 4 AS ratio FROM part")
def results_file(spark, d):
    """Results written as CSV with fixed decimals and read by column names."""
    path = saved(spark, d, "csv")
    logs.write_results(S.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("image_id"), F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 4).alias("ratio")), path)
    return logs.results(spark, path)


@query("SELECT CAST(o_custkey AS VARCHAR) AS image_id, CAST(max(o_orderkey) AS VARCHAR) AS run FROM orders GROUP BY o_custkey")
def baseline_file(spark, d):
    """A results file by position: header, blank and short lines are skipped, the last row of a key wins."""
    path = saved(spark, d, "baseline")
    more = ",".join(["0"] * 11)
    rows = S.table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit(more)).alias("value"))
    noise = spark.createDataFrame([(-3, "image_id,run," + more), (-2, ""), (-1, "1,2,3")], "o_orderkey long, value string")
    rows.union(noise).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return logs.baseline(spark, path, ["image_id", "run"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def saved_rows(spark, d):
    """Results saved as JSON lines and loaded again; nothing saved gives no rows."""
    path = saved(spark, d, "json")
    none = logs.checkpoint_rows(spark, path, "k long, name string")
    S.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.json(path)
    return none.union(logs.checkpoint_rows(spark, path, "k long, name string"))


@query("SELECT count(*) AS rows FROM nation")
def row_assertion(spark, d):
    return A.exactly(S.table(spark, d, "nation"), 25)


_SETTINGS = [None, "", "7", " 8 ", "9x", "-3", "400", "3.5", "1e2", "true", "OFF", "yes", "nan"]


@query("""WITH t AS (SELECT unnest([NULL, '', '7', ' 8 ', '9x', '-3', '400', '3.5', '1e2', 'true', 'OFF', 'yes', 'nan']) AS s), c AS (SELECT s, CASE WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') THEN CAST(trim(s) AS BIGINT) END AS i, TRY_CAST(trim(s) AS DOUBLE) AS f FROM t)
SELECT s, CASE WHEN i BETWEEN 0 AND 100 THEN i ELSE 5 END AS whole, CAST(CASE WHEN i > 64 THEN 64 WHEN i BETWEEN 1 AND 64 THEN i ELSE 5 END AS BIGINT) AS threads, CASE WHEN isfinite(f) AND f BETWEEN 0 AND 100 THEN f ELSE 0.25 END AS share,
CASE WHEN lower(s) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(s) IN ('0', 'false', 'no', 'off') THEN false ELSE true END AS enabled FROM c""")
def settings(spark, d):
    """Settings from strings: what can't be parsed or lies outside gives the fallback; threads are held at their limit."""
    rows = [(s, config.setting_int(s, 5, 0, 100), config.setting_int(s, 5, 1, 64, clamp_high=True), config.setting_float(s, 0.25, 0.0, 100.0), config.setting_bool(s, True)) for s in _SETTINGS]
    return spark.createDataFrame(rows, "s string, whole long, threads long, share double, enabled boolean")


# ---- synthetic images


@query("SELECT x, y, CAST(floor(127.5 * (1 + sin(x / 50.0))) AS BIGINT) AS r, CAST(floor(127.5 * (1 + cos(y / 50.0))) AS BIGINT) AS g, CAST((x + y) % 256 AS BIGINT) AS b FROM (SELECT unnest(range(192)) AS x), (SELECT unnest(range(108)) AS y)")
def gradient_source(spark, d):
    return synthetic.waves(spark, 192, 108)


@query("""SELECT 'solid' AS kind, CAST(128 AS BIGINT) AS level, CAST(96 * 64 AS BIGINT) AS n UNION ALL
SELECT 'mockup', level, count(*) FROM (SELECT CASE WHEN y < 64 // 10 THEN 60 WHEN x < 96 // 5 THEN 200 WHEN y % 12 < 2 AND x % 7 < 5 THEN 20 ELSE 245 END AS level FROM (SELECT unnest(range(96)) AS x), (SELECT unnest(range(64)) AS y)) GROUP BY level""")
def made_up_images(spark, d):
    both = synthetic.solid(spark, 96, 64).withColumn("kind", F.lit("solid")).unionByName(synthetic.mockup(spark, 96, 64).withColumn("kind", F.lit("mockup")))
    return both.groupBy("kind", F.col("r").alias("level")).agg(F.count("*").alias("n"))


# ---- transforms, colours, enlargement

_INVERSE = ", ".join(f"({k}, {n}, {w})" for k, r in enumerate(B.inverse_basis().tolist()) for n, w in enumerate(r))


@query(f"""WITH {PLANE}, basis(k, n, w) AS (VALUES {_INVERSE}), c AS (SELECT y AS bi, x // 8 AS ky, x % 8 AS k, (v - 128) * 3 AS v FROM plane),
lines AS (SELECT bi, ky, n AS x, (CAST(sum(v * w) AS BIGINT) + 1024) >> 11 AS t FROM c JOIN basis USING (k) GROUP BY bi, ky, n),
px AS (SELECT bi, x, b.n AS y, (CAST(sum(t * w) AS BIGINT) + 131072) >> 18 AS s FROM lines JOIN basis b ON b.k = ky GROUP BY bi, x, b.n)
SELECT bi, CAST(sum(s * (y * 8 + x + 1)) AS BIGINT) AS weighted, CAST(max(s) AS BIGINT) AS highest FROM px GROUP BY bi""")
def inverse_transform(spark, d):
    def each(batches):
        for batch in batches:
            c = (np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, 64) - 128) * 3
            s = B.inverse_dct(c).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((s * np.arange(1, 65)).sum(axis=1)), pa.array(s.max(axis=1) if len(s) else [], pa.int64())], ["bi", "weighted", "highest"])

    return S.blocks(spark, d).mapInArrow(each, "bi long, weighted long, highest long")


_CFL = ORACLES["cfl_fit"].split("\nSELECT bi,")[0]


@query(f"""{_CFL}, fit AS (SELECT bi, alpha_q8, CASE WHEN var < 1024 THEN (sc + 32) // 64 ELSE greatest(0, least(255, (sc * 256 - alpha_q8 * (sy - 8192) + 8192) // 16384)) END AS beta, CAST(round(alpha_q8 / 4.0) AS BIGINT) AS alpha_q6 FROM al),
e AS (SELECT bi, alpha_q8, alpha_q6, beta, CAST(sum((c - 128) * (c - 128)) AS BIGINT) AS error_plain, CAST(sum((c - greatest(0, least(255, ((alpha_q6 * (y - 128) + 32) >> 6) + beta))) * (c - greatest(0, least(255, ((alpha_q6 * (y - 128) + 32) >> 6) + beta)))) AS BIGINT) AS error_fit FROM fit JOIN pair USING (bi) GROUP BY ALL)
SELECT bi, CAST(alpha_q8 AS BIGINT) AS alpha_q8, alpha_q6, CAST(beta AS BIGINT) AS beta, error_plain, error_fit, error_fit < error_plain - 1024 AS applied FROM e""")
def cfl_adoption(spark, d):
    blocks = S.blocks(spark, d)
    return K.cfl_fit(blocks.where("bi % 2 = 0"), blocks.where("bi % 2 = 1").withColumn("bi", F.col("bi") - 1), ["bi"])


@query(f"""WITH {PLANE}, n AS (SELECT max(y) + 1 AS h FROM plane), q AS (SELECT y // 2 AS y, x // 2 AS x, CAST(sum(v * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END) AS BIGINT) >> 2 AS v FROM plane, n GROUP BY 1, 2),
g AS (SELECT y, x, y * (SELECT max(y) FROM q) / 99 AS py, x * 31 / 63 AS px FROM (SELECT unnest(range(100)) AS y), (SELECT unnest(range(64)) AS x)),
c AS (SELECT *, CAST(floor(py) AS BIGINT) AS y0, least(CAST(floor(py) AS BIGINT) + 1, (SELECT max(y) FROM q)) AS y1, CAST(floor(px) AS BIGINT) AS x0, least(CAST(floor(px) AS BIGINT) + 1, 31) AS x1, py - floor(py) AS fy, px - floor(px) AS fx FROM g)
SELECT CAST(c.y AS BIGINT) AS y, CAST(sum(CAST(floor((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (e.v * (1 - fx) + f.v * fx) * fy + 0.5) AS BIGINT) * (c.x + 1)) AS BIGINT) AS weighted
FROM c JOIN q a ON a.y = y0 AND a.x = x0 JOIN q b ON b.y = y0 AND b.x = x1 JOIN q e ON e.y = y1 AND e.x = x0 JOIN q f ON f.y = y1 AND f.x = x1 GROUP BY c.y""")
def enlarged_420(spark, d):
    """The halved plane enlarged to 64 x 100."""
    big = L.doubled(L.halved(S.plane(spark, d)), 64, 100)
    return big.select("y", F.aggregate(F.transform("row", lambda v, x: v.cast("long") * (x + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


# ---- serialised streams


def coded_groups(spark, d, column, code) -> DataFrame:
    """(g, kind, n_bytes): the first byte and the size of what ``code`` makes of the values of 16 lines each."""
    rows = S.plane(spark, d).select(F.expr("y div 16").alias("g"), "y", column.alias("v"))
    lists = rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("y", "v"))).alias("l")).select("g", F.col("l.v").alias("v"))

    def each(batches):
        for batch in batches:
            out = [code(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] if x else -1 for x in out], pa.int64()), pa.array([len(x) for x in out], pa.int64())], ["g", "kind", "n_bytes"])

    return lists.mapInArrow(each, "g long, kind long, n_bytes long")


@query(f"""WITH {PLANE}, s AS (SELECT y // 16 AS g, y, CASE WHEN y // 16 % 3 = 0 THEN v % 4 WHEN y // 16 % 3 = 1 THEN v // 128 ELSE v // 200 * 3 END AS v FROM plane WHERE x = 0),
r AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY g ORDER BY y) THEN 0 ELSE 1 END AS new FROM s), t AS (SELECT g, count(*) AS n, count(DISTINCT v) AS used, sum(new) AS runs FROM r GROUP BY g),
b AS (SELECT g, 1 + (2 * n + 7) // 8 AS two, 2 + (n * CASE WHEN used <= 1 THEN 0 WHEN used = 2 THEN 1 ELSE 2 END + 7) // 8 AS packed, 2 + runs AS coded FROM t)
SELECT g, CAST(CASE WHEN coded < least(two, packed) THEN 3 WHEN packed <= two THEN 2 ELSE 1 END AS BIGINT) AS kind, CAST(least(two, packed, coded) AS BIGINT) AS n_bytes FROM b""")
def copy_streams(spark, d):
    """Streams of small copy vectors: two bits each, bits of those in use, or runs, whichever is smallest."""
    first, group = F.get("row", F.lit(0)), F.expr("y div 16") % 3
    small = list(C.VECTORS)
    return coded_groups(spark, d, F.when(group == 0, first % 4).when(group == 1, P.quotient(first, 128)).otherwise(P.quotient(first, 200) * 3), lambda v: C.copy_encode([small[k] for k in v]))


@query(f"""WITH {PLANE}, s AS (SELECT y // 16 AS g, v < CASE WHEN y // 16 % 2 = 0 THEN 100 ELSE 250 END AS on_ FROM plane WHERE x = 0), t AS (SELECT g, count(*) AS n, count(*) FILTER (on_) AS used FROM s GROUP BY g)
SELECT g, CAST(CASE WHEN 4 + (n + 7) // 8 + 2 * used < 2 * n THEN 1 ELSE 0 END AS BIGINT) AS kind, CAST(1 + least(4 + (n + 7) // 8 + 2 * used, 2 * n) AS BIGINT) AS n_bytes FROM t""")
def cfl_streams(spark, d):
    """Parameters of fitted blocks: all pairs, or a mask and the pairs in use."""
    limit = F.when(F.expr("y div 16") % 2 == 0, 100).otherwise(250)
    return coded_groups(spark, d, (F.get("row", F.lit(0)) < limit).cast("int"), lambda v: C.cfl_encode([(k % 64, 100 + k, bool(x)) for k, x in enumerate(v)]))


@query(f"""WITH {PLANE}, s AS (SELECT y, x, v // 96 AS k FROM plane), m AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY y ORDER BY x) THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY y ORDER BY x) AS island FROM m),
r AS (SELECT y, min(x) AS start, any_value(k) AS k, count(*) AS n FROM i GROUP BY y, island) SELECT y, string_agg(printf('%02X', CAST(k | ((n - 1) << 2) AS INTEGER)), '' ORDER BY start) AS bytes FROM r GROUP BY y""")
def block_type_runs(spark, d):
    """Runs of block kinds as bytes: kind in two bits, length less one above."""
    lines = S.plane(spark, d).select("y", F.transform("row", lambda v: P.quotient(v, 96)).alias("k"))

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([C.type_runs(k) for k in batch.column(1).to_pylist()], pa.binary())], ["y", "coded"])

    return lines.mapInArrow(each, "y long, coded binary").select("y", F.hex("coded").alias("bytes"))


@query(f"""WITH {PLANE}, bits AS (SELECT y, x * 3 + k AS i, (v >> k) & 1 AS bit FROM plane, (SELECT unnest([0, 1, 2]) AS k)), by8 AS (SELECT y, i // 8 AS j, CAST(sum(bit << (i % 8)) AS BIGINT) AS b FROM bits GROUP BY 1, 2)
SELECT y, string_agg(printf('%02X', CAST(b AS INTEGER)), '' ORDER BY j) AS bytes FROM by8 GROUP BY y""")
def packed_bits(spark, d):
    """The low three bits of a line's samples, least significant first."""

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([C.pack_bits([v & 7 for v in r], 3) for r in batch.column(1).to_pylist()], pa.binary())], ["y", "coded"])

    return S.plane(spark, d).select("y", "row").mapInArrow(each, "y long, coded binary").select("y", F.hex("coded").alias("bytes"))


@query("""WITH g AS (SELECT CAST(t AS BIGINT) AS tokens, CAST(b AS BIGINT) AS bytes FROM (SELECT unnest(range(0, 40000, 1111)) AS t), (SELECT unnest(range(0, 200000, 9973)) AS b)), p AS (SELECT *, greatest(1, (bytes // 64 - 12) // 40) AS points FROM g),
e AS (SELECT *, -(-tokens // points) AS each_ FROM (SELECT tokens, bytes, points FROM p)) SELECT tokens, bytes, CAST(greatest(64, least(4096, CASE WHEN ((tokens + points - 1) // points) // 8 * 8 = 0 THEN 8 ELSE ((tokens + points - 1) // points) // 8 * 8 END)) AS BIGINT) AS every FROM e""")
def restart_intervals(spark, d):
    rows = [(t, b, C.restart_interval(t, b)) for t in range(0, 40000, 1111) for b in range(0, 200000, 9973)]
    return spark.createDataFrame(rows, "tokens long, bytes long, every long")


@query(f"""WITH {PLANE}, c AS (SELECT y // 4 AS g, y, v // 32 AS v, count(*) AS n FROM plane GROUP BY ALL), pal AS (SELECT g, y, list(v ORDER BY n DESC, v) AS colors FROM c GROUP BY g, y HAVING count(*) <= 4)
SELECT g, count(*) AS blocks, count(*) FILTER (len(colors) = 2) AS pairs, CAST(0 AS BIGINT) AS wide, CAST(0 AS BIGINT) AS errors FROM pal GROUP BY g""")
def palette_stream_diagnostics(spark, d):
    """Counts of the blocks in a coded palette stream."""
    coarse = S.blocks(spark, d).withColumn("b", F.transform("b", lambda v: P.quotient(v, 32)))
    own = K.palette(coarse, 4).where(F.col("colors").isNotNull())
    lists = own.groupBy(F.expr("bi div 4").alias("g")).agg(F.sort_array(F.collect_list(F.struct("bi", "colors", "indices"))).alias("l"))
    names = ["blocks", "pairs", "wide", "errors"]

    def each(batches):
        for batch in batches:
            got = [C.palette_diagnostics(C.palette_encode([(x["colors"], x["indices"]) for x in l])) for l in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in got], pa.int64()) for n in names)], ["g", *names])

    return lists.mapInArrow(each, "g long, " + ", ".join(f"{n} long" for n in names))


@query(f"""WITH {PLANE}, c AS (SELECT y, v // 64 AS v, count(*) AS n FROM plane GROUP BY ALL), pal AS (SELECT y, list(v ORDER BY n DESC, v) AS colors FROM c GROUP BY y HAVING count(*) <= 8),
n AS (SELECT colors, count(*) AS n FROM pal GROUP BY colors), g AS (SELECT colors, n, (n - 1) * len(colors) - n AS gain FROM n)
SELECT array_to_string(list_transform(colors, lambda z: CAST(z AS VARCHAR)), ',') AS colors, n, CAST(gain AS BIGINT) AS gain, row_number() OVER (ORDER BY gain DESC, n DESC, len(colors) DESC, colors) - 1 AS entry FROM g WHERE gain > 0 QUALIFY entry < 255""")
def palette_dictionary(spark, d):
    coarse = S.blocks(spark, d).select(F.lit("e").alias("image_id"), F.transform("b", lambda v: P.quotient(v, 64)).alias("b"))
    got = K.shared_palettes(K.palette(coarse))
    return got.select(F.concat_ws(",", F.transform("colors", lambda v: v.cast("string"))).alias("colors"), "n", "gain", "entry")


# ---- block modes


def mode_sql(profile: int) -> str:
    """CTEs up to ``costs`` and ``decision``: half bits and mode of each block of the plane in steps of 64."""
    params = K.mode_params(profile)
    bits = "CASE WHEN abs(r) = 0 THEN {z} WHEN abs(r) <= 1 THEN 4 WHEN abs(r) <= 3 THEN 6 WHEN abs(r) <= 7 THEN 8 WHEN abs(r) <= 15 THEN 10 WHEN abs(r) <= 31 THEN 12 WHEN abs(r) <= 63 THEN 14 WHEN abs(r) <= 127 THEN 16 ELSE 20 END".format(z=1 if profile == PHOTO else 2)
    photo = profile == PHOTO
    index = "CASE WHEN n <= 4 THEN 256 ELSE 384 END"
    many = f"20 + n * 16 + {index} + n * 16" if photo else f"20 + n * 16 + {index} - CASE WHEN changes <= 16 THEN 96 WHEN changes <= 24 THEN 64 WHEN changes <= 32 THEN 32 ELSE 0 END"
    pair = "20 + n * 16 + CASE WHEN changes <= 24 THEN 48 ELSE 128 END" + ("" if photo else " - CASE WHEN changes <= 16 THEN 16 ELSE 0 END")
    anime = " - CASE WHEN n >= 2 AND changes <= 60 THEN 24 ELSE 0 END" if profile == ANIME else ""
    rescue = "false" if photo else "pal_cost + 8 < filter_bits"
    bias = "0" if photo else "CASE WHEN changes <= 32 AND variance >= 30000 THEN 32 ELSE 0 END"
    quads = ", ".join(f"({k}, {x // 4}, {y // 4})" for k, (x, y) in enumerate(K.QUADRANT_VECTORS))
    plane = RESIDUALS.replace("+ 128)) AS v\n", "+ 128)) // 64 AS v\n") + (", rs AS (SELECT * FROM resid)" if photo else ", rs AS (SELECT * FROM resid WHERE f <> 5)")
    return f"""{plane}, fb AS (SELECT by_, bx, min(cost) + 10 AS filter_bits FROM (SELECT y // 8 AS by_, x // 8 AS bx, f, CAST(sum({bits}) AS BIGINT) AS cost FROM rs GROUP BY ALL) GROUP BY by_, bx),
tall AS (SELECT y, x, v FROM plane UNION ALL SELECT p.y + k, p.x, p.v FROM plane p, (SELECT max(y) AS last FROM plane), (SELECT unnest(range(1, 8)) AS k) WHERE p.y = last AND k <= (8 - (last + 1) % 8) % 8),
blk AS (SELECT y // 8 AS by_, x // 8 AS bx, (y % 8) * 8 + x % 8 AS p, v FROM tall), arr AS (SELECT by_, bx, list(v ORDER BY p) AS b FROM blk GROUP BY by_, bx),
mom AS (SELECT by_, bx, count(DISTINCT v) AS uniq, CAST(sum(CASE WHEN q <> v THEN 1 ELSE 0 END) AS BIGINT) AS transitions, CAST(sum(v * v) - (sum(v) * sum(v)) // 64 AS BIGINT) AS variance FROM (SELECT *, lag(v) OVER (PARTITION BY by_, bx ORDER BY p) AS q FROM blk) GROUP BY by_, bx),
cp AS (SELECT a.by_, a.bx, min(k) AS candidate FROM arr a JOIN (VALUES (0, 0, -1), (1, -1, 0), (2, -1, -1), (3, -1, 1)) o(k, dy, dx) ON true JOIN arr s ON s.by_ = a.by_ + dy AND s.bx = a.bx + dx AND s.b = a.b GROUP BY a.by_, a.bx),
qd AS (SELECT y // 4 AS qy, x // 4 AS qx, list(v ORDER BY y, x) AS c FROM tall GROUP BY y // 4, x // 4), o(k, dx, dy) AS (VALUES {quads}),
qm AS (SELECT a.qy // 2 AS by_, a.qx // 2 AS bx, count(DISTINCT (a.qy, a.qx)) AS hits FROM qd a JOIN o ON true JOIN qd s ON s.qy = a.qy + dy AND s.qx = a.qx + dx AND s.c = a.c GROUP BY a.qy // 2, a.qx // 2),
raw AS (SELECT f.*, uniq AS n, transitions, transitions AS changes, variance, candidate, hits FROM tiles_of f JOIN mom USING (by_, bx) LEFT JOIN cp USING (by_, bx) LEFT JOIN qm USING (by_, bx)),
priced AS (SELECT *, (CASE WHEN n <= 1 THEN 20 + n * 16 WHEN n = 2 THEN {pair} ELSE {many} END){anime} AS pal_cost FROM raw),
costs AS (SELECT by_, bx, CASE WHEN candidate IS NOT NULL THEN {K.copy_cost(profile)} ELSE {K.NEVER} END AS copy_bits, CASE WHEN candidate IS NULL AND hits = 4 THEN 36 ELSE {K.NEVER} END AS tile4_bits,
CASE WHEN candidate IS NULL AND n <= 8 AND ((n <= {params.palette_max_colors} AND (transitions <= {params.palette_transition_limit} OR n <= 1) AND variance <= {params.palette_variance_limit}) OR {rescue}) THEN pal_cost - {bias} ELSE {K.NEVER} END AS palette_bits,
filter_bits, coalesce(candidate, -1) AS copy_candidate, least(n, 9) AS "unique", transitions, variance FROM priced),
decision AS (SELECT *, CASE WHEN copy_bits < {K.NEVER} THEN 2 WHEN tile4_bits <= copy_bits AND tile4_bits <= palette_bits AND tile4_bits <= filter_bits THEN 3 WHEN copy_bits <= palette_bits AND copy_bits <= filter_bits THEN 2 WHEN palette_bits <= filter_bits THEN 1 ELSE 0 END AS mode FROM costs)""".replace("tiles_of f", "fb f")


_MODE_ROWS = """SELECT 'e' AS image_id, by_ AS by, bx, CAST(copy_bits AS BIGINT) AS copy_bits, CAST(tile4_bits AS BIGINT) AS tile4_bits, CAST(palette_bits AS BIGINT) AS palette_bits, CAST(filter_bits AS BIGINT) AS filter_bits, CAST(copy_candidate AS BIGINT) AS copy_candidate,
CAST("unique" AS BIGINT) AS "unique", CAST(transitions AS BIGINT) AS transitions, CAST(variance AS BIGINT) AS variance, CAST(mode AS BIGINT) AS mode FROM """
ORACLES["mode_select_ui"] = f"WITH {mode_sql(UI)} {_MODE_ROWS} decision"
ORACLES["mode_mix"] = f"WITH {mode_sql(ANIME)} SELECT CAST(mode AS BIGINT) AS mode, count(*) AS n, CAST(sum(filter_bits) AS BIGINT) AS filter_bits FROM decision GROUP BY mode"
ORACLES["filter_block_buckets"] = f"""WITH {mode_sql(UI)} SELECT CASE WHEN "unique" <= 2 THEN 'le2' WHEN "unique" <= 4 THEN 'le4' WHEN "unique" <= 8 THEN 'le8' ELSE 'gt8' END AS bucket, count(*) AS n, avg(transitions) AS avg_transitions, avg(variance) AS avg_variance, avg(filter_bits // 2) AS avg_bits FROM decision WHERE mode = 0 GROUP BY 1"""
_LESS = {m: f"{c}_bits - CASE WHEN w.mode = {m} AND {c}_bits < {K.NEVER} THEN 4 ELSE 0 END" for m, c in ((0, "filter"), (1, "palette"), (2, "copy"), (3, "tile4"))}
ORACLES["mode_select_photo"] = f"""WITH RECURSIVE {mode_sql(PHOTO)}, numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY by_, bx) AS place FROM costs),
walk AS (SELECT CAST(0 AS BIGINT) AS place, 0 AS mode UNION ALL SELECT n.place, CASE WHEN copy_bits < {K.NEVER} THEN 2 WHEN {_LESS[3]} <= {_LESS[2]} AND {_LESS[3]} <= {_LESS[1]} AND {_LESS[3]} <= {_LESS[0]} THEN 3 WHEN {_LESS[2]} <= {_LESS[1]} AND {_LESS[2]} <= {_LESS[0]} THEN 2 WHEN {_LESS[1]} <= {_LESS[0]} THEN 1 ELSE 0 END
FROM walk w JOIN numbered n ON n.place = w.place + 1) {_MODE_ROWS} numbered JOIN walk USING (place)"""
ORACLES["profile_classifier"] = ORACLES["profile_features"].split("SELECT 'e' AS image_id, CAST((SELECT n FROM n)")[0] + """, feat AS (SELECT 'e' AS image_id, CAST((SELECT n FROM n)""" + ORACLES["profile_features"].split("SELECT 'e' AS image_id, CAST((SELECT n FROM n)")[1] + """),
s AS (SELECT *, CASE WHEN copy_rate >= 0.90 THEN 3 ELSE 0 END + CASE WHEN active_bins <= 10 THEN 2 ELSE 0 END + CASE WHEN mean_diff <= 12 THEN 1 ELSE 0 END AS ui, CASE WHEN copy_rate >= 0.60 AND copy_rate < 0.95 THEN 2 ELSE 0 END + CASE WHEN active_bins BETWEEN 8 AND 24 THEN 2 ELSE 0 END + CASE WHEN mean_diff <= 28 THEN 2 ELSE 0 END AS anime FROM feat)
SELECT image_id, n_blocks, samples, copy_rate, mean_diff, active_bins, CAST(CASE WHEN n_blocks < 64 OR samples < 32 THEN 2 WHEN copy_rate >= 0.10 AND active_bins <= 6 AND mean_diff <= 1.2 THEN 1 WHEN ui >= anime + 2 THEN 0 WHEN anime >= 3 THEN 1 ELSE 2 END AS BIGINT) AS profile FROM s"""


# ---- reports


@query(f"WITH {RUNS_LOG} SELECT category, codec, round(8.0 * sum(size) / count(*), 6) AS bits_per_block, round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT ms), 0), 6) AS mean_run, round(100.0 * (1.0 - sum(size) / 2.0 / nullif(sum(size), 0)), 6) AS savings FROM runlog GROUP BY category, codec")
def block_rates(spark, d):
    """Bits a block, mean run and savings, guarded against empty groups."""
    sums = S.run_log(spark, d).groupBy("category", "codec").agg(F.count("*").alias("n"), F.count_distinct("ms").alias("runs"), F.sum("size").alias("raw"))
    return sums.select("category", "codec", F.round(A.bits_per_block(F.col("raw"), F.col("n")), 6).alias("bits_per_block"), F.round(A.mean_run(F.col("n"), F.col("runs")), 6).alias("mean_run"), F.round(A.savings(F.col("raw"), F.col("raw") / 2.0), 6).alias("savings"))


@query(f"WITH {RUNS_LOG} SELECT category, round(CAST(sum(size) AS DOUBLE) / (CASE WHEN category = 'A' THEN count(*) ELSE 7 END) / 100, 6) AS mean_size FROM runlog GROUP BY category")
def scaled_means(spark, d):
    """Means of sums kept in hundredths; a count of 0 falls back on another."""
    sums = S.run_log(spark, d).groupBy("category").agg(F.sum("size").alias("total"), F.when(F.col("category") == "A", F.count("*")).otherwise(0).alias("n"))
    return sums.select("category", F.round(A.scaled_mean(F.col("total"), F.col("n"), F.lit(7), 100), 6).alias("mean_size"))


@query(f"""WITH {RUNS_LOG}, c AS (SELECT category, codec, size, CASE WHEN size * 1000 <= 20000 * 995 THEN 'taken' WHEN size > 40000 THEN 'too large' ELSE 'no gain' END AS reason FROM runlog)
SELECT codec, count(*) AS n, count(*) FILTER (reason = 'taken') AS taken, count(*) FILTER (reason = 'no gain') AS no_gain, count(*) FILTER (reason = 'too large') AS too_large, round(avg(size) FILTER (reason <> 'taken'), 4) AS mean_rejected FROM c GROUP BY codec""")
def mode_reasons(spark, d):
    """Candidates of each mode, how many were taken, and why the others were not."""
    size = F.col("size")
    reason = F.when(P.within_permille(size, F.lit(20000), 995), "taken").when(size > 40000, "too large").otherwise("no gain")
    got = A.reasons(S.run_log(spark, d).select("codec", "size", reason.alias("reason")), "codec", "reason", ["taken", "no gain", "too large"], "size")
    return got.select("codec", "n", "taken", F.col("no gain").alias("no_gain"), F.col("too large").alias("too_large"), F.round("mean_rejected", 4).alias("mean_rejected"))
