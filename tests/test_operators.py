"""Operators on small made-up tables: hand results, inverses, one partition against many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.config import PHOTO, UI
from blockloom.operators import analytics as A, blocks as K, planes as L
from blockloom.plans import lossless
from blockloom.sources import container, logs, synthetic
from blockloom.streaming import ingest


def plane(spark, samples):
    rows = [("i", y, [int(v) for v in line]) for y, line in enumerate(samples)]
    return spark.createDataFrame(rows, "image_id string, y long, row array<int>")


def samples_of(df):
    return np.array([r["row"] for r in df.orderBy("y").collect()])


def test_residuals_equal_numpy(spark):
    samples = np.random.default_rng(1).integers(0, 256, (11, 9))
    got = L.residuals(L.neighbours(plane(spark, samples))).collect()
    for k in range(8):
        want = samples - lossless.predictions(samples.astype(np.int64), k)
        mine = {(r["y"], r["x"]): r["r"] for r in got if r["f"] == k}
        assert all(mine[y, x] == want[y, x] for y in range(11) for x in range(9)), k


def test_parallel_equals_serial(spark):
    p = plane(spark, np.random.default_rng(2).integers(0, 256, (40, 16)))
    one = L.best_filters(L.row_costs(p.coalesce(1))).orderBy("y").collect()
    many = L.best_filters(L.row_costs(p.repartition(13))).orderBy("y").collect()
    assert one == many


@pytest.mark.parametrize("shape", [(7, 9), (1, 1), (16, 8)])
def test_padding_and_blocks(spark, shape):
    samples = np.random.default_rng(3).integers(0, 256, shape)
    padded = L.padded(plane(spark, samples))
    want = np.pad(samples, ((0, -shape[0] % 8), (0, -shape[1] % 8)), mode="edge")
    assert np.array_equal(samples_of(padded), want)
    assert np.array_equal(samples_of(L.from_blocks(L.as_blocks(padded))), want)
    assert np.array_equal(samples_of(L.cropped(padded, shape[1], shape[0])), samples)


def test_sizes_halved_and_doubled(spark):
    from blockloom.plans.images import enlarge, halve

    samples = np.random.default_rng(4).integers(0, 256, (7, 5))
    assert np.array_equal(samples_of(L.halved(plane(spark, samples))), halve(samples))
    assert np.array_equal(samples_of(L.doubled(plane(spark, samples), 9, 13)), enlarge(samples, 13, 9))


def test_runs(spark):
    s = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 5, 5, 2, 2, 5])], "k int, p int, v int")
    got = [tuple(r) for r in L.runs(s, "k", "p", "v", 2).orderBy("start").select("start", "value", "length").collect()]
    assert got == [(0, 5, 2), (2, 5, 1), (3, 2, 2), (5, 5, 1)]


def test_modes(spark):
    samples = np.zeros((16, 16), int)
    samples[0:8, 8:16] = np.random.default_rng(5).integers(0, 256, (8, 8))
    p = plane(spark, samples)
    for profile in (UI, PHOTO):
        got = {(r["by"], r["bx"]): r["mode"] for r in K.modes(K.candidates(p, L.as_blocks(p), profile), profile).collect()}
        assert got[1, 0] == 2  # equal to the block above
        assert got[0, 1] == 0  # noise
        assert len(got) == 4


def test_palette(spark):
    b = spark.createDataFrame([(0, [1] * 40 + [9] * 24), (1, list(range(64)))], "bi int, b array<int>")
    got = {r["bi"]: r for r in K.palette(b).collect()}
    assert got[0]["colors"] == [1, 9] and got[0]["indices"] == [0] * 40 + [1] * 24
    assert got[1]["colors"] is None


def test_medians_of_nothing(spark):
    none = spark.createDataFrame([], "a double, b long")
    assert tuple(A.medians(none, [], ["a"], ["b"]).first()) == (0.0, 0)
    some = spark.createDataFrame([(1.0, 1), (2.0, 2), (4.0, 4), (9.0, 9)], "a double, b long")
    assert tuple(A.medians(some, [], ["a"], ["b"]).first()) == (3.0, 3)


def test_comparison_keeps_unmatched(spark):
    r = spark.createDataFrame([("a", 5), ("b", 7)], "k string, n long")
    got = {x["k"]: (x["in_baseline"], x["diff_n"]) for x in A.compared(r, r.where("k = 'a'"), "k", ["n"]).collect()}
    assert got == {"a": (True, 0), "b": (False, None)}


def test_logs(spark):
    lines = spark.createDataFrame([("img_1  10.5 5.0 -52% 4.00ms 2.00msUI",), ("img_2 8.0 0.0 +3% 1.50x 2.50xPhoto",), ("total",), ("TOTAL 12",), ("Average Decode Time: 3.5 ms",)], "value string")
    got = {r["image"]: r.asDict() for r in logs.benchmark_rows(lines).collect()}
    assert got["img_1"]["dec_speedup"] == 2.0 and got["img_1"]["size_change_percent"] == -52 and got["img_1"]["enc_speedup"] == 0.0
    assert got["img_2"]["enc_speedup"] == 1.5 and got["img_2"]["dec_speedup"] == 2.5 and got["img_2"]["category"] == "Photo"
    assert logs.total_bytes(lines).first()[0] == 12 and logs.decode_times(lines).first()[0] == 3.5
    curves = spark.createDataFrame([("ours 90 98304 40.1 3.0 1920x1080",), ("jpeg 90 49152 38.0 2.0 x",), ("jpeg 80 N/A 1 2 3",), ("# banner",)], "value string")
    assert [r["codec"] for r in logs.curve_rows(curves).collect()] == ["ours", "jpeg"]


def test_result_files(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("id,a,b\nx,1,2\n\nshort\ny,3,\nx,5,6\n")
    got = {r["id"]: (r["a"], r["b"]) for r in logs.baseline(spark, str(f), ["id", "a", "b"], 3).collect()}
    assert got == {"x": ("5", "6"), "y": ("3", "")}
    logs.write_results(spark.createDataFrame([("x", 0.5)], "image_id string, v double"), str(tmp_path / "out"))
    assert logs.results(spark, str(tmp_path / "out")).first()["v"] == 0.5
    assert logs.checkpoint_rows(spark, str(tmp_path / "none"), "a int").count() == 0


def test_stream_reads_files_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    for k in range(2):
        (tmp_path / "src" / f"{k}.log").write_text(f"img_{k} 10.0 5.0 -50% 4.00ms 2.00msUI\nnoise\n")
        ingest.ingest(spark, src, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1


def test_pixmaps_and_containers(spark, tmp_path):
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    files = spark.createDataFrame([("a", bytearray(container.write_ppm(rgb))), ("b", bytearray(b"P5 junk"))], "path string, content binary")
    got = {r["path"]: r for r in container.pixmaps(files, lenient=True).collect()}
    assert bytes(got["a"]["rgb"]) == rgb.tobytes() and got["b"]["error"]
    assert files.where(container.is_ppm(F.col("content"))).count() == 1
    lines = container.pixmap_lines(container.pixmaps(files))
    assert sorted(tuple(r["row"]) for r in lines.where("plane = 'g' and y = 1").collect()) == [(13, 16, 19, 22)]
    packed = container.pack(container.header(4, 2), [("PLN0", b"abc"), ("NOTE", b"")])
    heads = container.header_columns(spark.createDataFrame([(1, bytearray(packed)), (2, bytearray(b"no"))], "id int, content binary"))
    assert {r["id"]: r["valid"] for r in heads.collect()} == {1: True, 2: False}
    assert container.chunk(packed, "PLN0") == b"abc"
    tables = [[k + 1 for k in range(64)]] * 3
    assert container.parse_quant_chunk(container.quant_chunk(75, tables)) == (75, tables)


def test_synthetic(spark):
    for make in (synthetic.noise, synthetic.solid, synthetic.mockup, synthetic.natural, synthetic.waves):
        low, high, n = make(spark, 20, 10).agg(F.min("r"), F.max("r"), F.count("*")).first()
        assert 0 <= low <= high <= 255 and n == 200


def test_row_counts_are_asserted(spark):
    assert A.exactly(spark.range(6), 6).first()["rows"] == 6
    with pytest.raises(Exception, match="6 rows expected"):
        A.exactly(spark.range(5), 6).collect()


def test_block_search_equals_numpy(spark):
    from blockloom.operators.search import nearest_copies, nearest_copy

    samples = np.random.default_rng(6).integers(0, 64, (24, 24))
    got = {(r["by"], r["bx"]): (r["dx"], r["dy"], r["sad"]) for r in nearest_copies(plane(spark, samples), 10).collect()}
    assert got == {(by, bx): nearest_copy(samples, by, bx, 10) for by in range(3) for bx in range(3)}


def test_block_search_query_reaches_64_samples(spark):
    from blockloom import queries
    from blockloom.operators.search import nearest_copies

    directory = "/root/testdata/sf0.001"
    got = {(r["by"], r["bx"]): r["sad"] for r in queries.QUERIES["nearest_copies"](spark, directory).collect()}
    want = {(r["by"], r["bx"]): r["sad"] for r in nearest_copies(queries.L.padded(queries.S.plane(spark, directory)), 64).collect()}
    near = {(r["by"], r["bx"]): r["sad"] for r in nearest_copies(queries.L.padded(queries.S.plane(spark, directory)), 16).collect()}
    assert got == want and got != near


def test_windows_carry_over_between_bands(spark, monkeypatch):
    """Differences, sums, ordinals and last values with three places in a band, gaps and several images."""
    monkeypatch.setattr(L, "BAND", 3)
    rng = np.random.default_rng(9)
    rows = [(image, int(at), int(rng.integers(0, 9)), int(rng.integers(0, 3))) for image in "ab" for at in np.flatnonzero(rng.random(60) < 0.6)]
    blocks = spark.createDataFrame(rows, "image_id string, bi long, dc long, kind long").repartition(5)
    last, total, seen = {}, {}, {}
    want = {}
    for image, at, dc, kind in sorted(rows):
        want[image, at] = (last.get(image), total.get(image, 0) + dc, seen.get((image, kind), 0))
        last[image], total[image], seen[image, kind] = dc, total.get(image, 0) + dc, seen.get((image, kind), 0) + 1
    out = L.ordinals(L.with_total(L.with_last(blocks, ["image_id"], "bi", "dc", "last"), ["image_id"], "bi", F.col("dc"), "total"))
    assert {(r["image_id"], r["bi"]): (r["last"], r["total"], r["ordinal"]) for r in out.collect()} == want
    back = L.dc_restored(L.dc_differences(blocks))
    assert all(r["restored"] == r["dc"] for r in back.collect())


def test_photo_modes_do_not_depend_on_the_parts(spark, monkeypatch):

    rng = np.random.default_rng(12)
    costs = [("e", by, bx, *(int(v) for v in rng.integers(20, 27, 4))) for by in range(9) for bx in range(5)]
    costs = [(*c[:5], K.NEVER if c[5] < 26 else c[5], c[6]) for c in costs]
    df = spark.createDataFrame(costs, "image_id string, by long, bx long, filter_bits long, palette_bits long, copy_bits long, tile4_bits long").repartition(4)
    want = dict(zip([c[1:3] for c in costs], K.walked([c[3:] for c in costs], 0), strict=True))
    for lines in (64, 2):
        monkeypatch.setattr(K, "WALKED_LINES", lines)
        assert {(r["by"], r["bx"]): r["mode"] for r in K.modes(df, PHOTO).collect()} == want
