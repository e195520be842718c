"""Round trips, malformed streams, fixed byte strings."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from blockloom.config import PRESETS, GlobalLz, NaturalGate, RouteGates, TileLz
from blockloom.operators import codecs as C, lz
from blockloom.operators.lz import Damaged
from blockloom.plans import images, lossless, lossy, modes
from blockloom.sources import container as K, png

STREAMS = [b"", b"a", b"ab", b"aaaaaaaa", bytes(range(256)), bytes(random.Random(1).choices(range(3), k=3000)), b"\0" * 100 + b"\1" + b"\0" * 50]


def test_fixed_bytes():
    assert C.lz_compress(b"aaaaaaaa").hex() == "00016101070100"
    assert C.lz_compress(b"ab").hex() == "00026162"
    assert C.type_runs([0, 0, 0, 1, 1, 2]) == bytes((8, 5, 2))
    assert C.model([1] * 256).tolist() == [16] * 256


@pytest.mark.parametrize("counts", [[1] * 256, [10**6] + [1] * 255, [1, 0, 0], [5, 3, 2], [0] * 4000 + [1]])
def test_model_total(counts):
    freq = C.model(counts)
    assert freq.sum() == C.TOTAL and freq.min() >= 1


@pytest.mark.parametrize("data", STREAMS)
def test_round_trips(data):
    assert C.adaptive_decode(C.adaptive_encode(data)) == data
    for params in (TileLz(), TileLz(chain_depth=16), TileLz(lazy=True)):
        assert C.lz_decompress(C.lz_compress(data, params), len(data)) == data
    assert C.lz_decompress(C.lz_optimal(data), len(data)) == data
    z = C.lz_compress(data)
    assert C.rebuilt(C.token_streams(z)) == z and C.rebuilt(C.token_streams(z, False), False) == z
    assert C.sparse_decode(C.sparse_encode(data), len(data)) == data
    assert C.unwrapped(C.smallest(data, 0xA9), 0xA9) == data
    assert lossless.undelta(lossless.delta(data)) == data
    assert C.streams_decode(C.streams_encode(data)) == data
    assert C.token_streams_decode(C.token_streams_encode(data), len(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes(data):
    assert C.lz_decompress(C.lz_compress(data), len(data)) == data
    assert C.adaptive_decode(C.adaptive_encode(data)) == data
    kinds = [x % 4 for x in data]
    assert C.from_type_runs(C.type_runs(kinds), len(kinds)) == kinds
    assert C.unpack_bits(C.pack_bits(kinds, 2), 2, len(kinds)) == kinds


def test_restart_points_equal_serial():
    data = STREAMS[5]
    freq = C.model(C.laplace(data))
    coded = C.rans_encode(data, freq)
    assert bytes(C.rans_decode(coded, len(data), freq)) == data
    points = C.restart_points(coded, len(data), freq, 512)
    assert b"".join(bytes(C.decode_part(coded, p, min(512, len(data) - p.token), freq)) for p in points) == data
    assert C.restart_interval(4_000_000, 2_000_000) % 8 == 0


def test_malformed():
    for bad in (b"\2", b"\1\5\0", b"\0\5ab", b"\1\3\1\0"):
        with pytest.raises(C.Damaged):
            C.lz_decompress(bad)
        assert isinstance(C.lz_decompress(bad, strict=False), bytes)
    for bad in (b"", b"\0" * 40, C.adaptive_encode(b"abc" * 50)[:-3]):
        with pytest.raises(C.Damaged):
            C.adaptive_decode(bad)
    assert not lossless.decode_band_or_zeros(b"junk", 3, 4).any()
    with pytest.raises(C.Damaged):
        K.parse_header(b"\0" * 48)
    with pytest.raises(C.Damaged):
        K.read_ppm(b"P6 3 3 255 xx")
    assert C.palette_diagnostics(b"P\1")["errors"] == 1


def test_copy_vectors():
    table = list(C.VECTORS)
    for vectors in ([table[0]] * 70, [table[k % 3] for k in range(20)], [table[k % 4] for k in range(9)], [(-8, 0), (5, 7)]):
        assert C.copy_decode(C.copy_encode(vectors), len(vectors)) == vectors
    assert C.copy_decode(b"\3\1", 3) == [table[0]] * 3


def test_palettes():
    blocks = [([5, -3], [k % 2 for k in range(64)]), ([300], [0] * 64), ([5, -3], [1] * 64)]
    assert C.palette_decode(C.palette_encode(blocks)) == blocks
    assert C.palette_diagnostics(C.palette_encode(blocks)) == {"blocks": 3, "pairs": 2, "wide": 1, "errors": 0}
    assert sorted(C.best_color_order([9, 1, 5], [0, 1, 2, 2])) == [1, 5, 9]


@pytest.mark.parametrize("shape", [(7, 9), (1, 1), (13, 5), (64, 64), (70, 64)])
@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_planes(shape, preset):
    rng = np.random.default_rng(shape[0])
    for samples in (rng.integers(0, 256, shape), np.full(shape, 7), np.add.outer(np.arange(shape[0]), np.arange(shape[1])) - 200, rng.integers(0, 4, shape)):
        assert np.array_equal(lossless.decode_band(lossless.encode_band(samples, PRESETS[preset])), samples)
        assert np.array_equal(lossless.natural_decode(lossless.natural_encode(samples.astype(np.int64), PRESETS[preset]), *shape), samples)


def test_every_low_byte_mode():
    rng = np.random.default_rng(5)
    lo = np.tile(np.cumsum(rng.integers(0, 3, (20, 64)), axis=1).astype(np.uint8), (4, 1))
    filters = rng.integers(0, 8, 80)
    got = lossless.lo_candidates(list(lo), filters)
    assert [m for m, _ in got] == list(range(9))
    for mode, payload in got:
        assert np.array_equal(lossless.lo_decode(bytes((mode,)) + payload, filters, [64] * 80), lo.ravel()), mode


def test_images():
    y, x = np.mgrid[0:64, 0:64]
    rgb = np.stack([(4 * x) % 256, (4 * y) % 256, (2 * (x + y)) % 256], -1).astype(np.uint8)
    whole = images.encode_lossless(rgb)
    assert np.array_equal(images.decode(whole), rgb) and images.encode_lossless(rgb) == whole
    assert images.psnr(rgb, images.decode(images.encode_lossy(rgb, 90))) > 30
    assert images.psnr(rgb, images.decode(images.encode_lossy(rgb, 90, subsample=True))) > 25
    assert images.info(whole)["width"] == 64
    assert np.array_equal(K.read_ppm(K.write_ppm(rgb)), rgb)


def test_quadratic_transforms_agree(spark):
    from pyspark.sql import functions as F

    from blockloom.functions import block as B

    block = np.random.default_rng(2).integers(-128, 128, 64)
    got = spark.range(1).select(B.forward_dct(F.array(*[F.lit(int(v)) for v in block])).alias("c")).first()["c"]
    assert got == images.transform(block[None])[0].tolist()
    back = B.inverse_dct(np.array([got]))[0]
    assert np.abs(back - block).max() <= 2


def test_cfl_streams():
    some = [(k - 5, 100 + k, k % 4 == 0) for k in range(20)]
    assert C.cfl_decode(C.cfl_encode(some)) == [(a, b, True) if on else (0, 128, False) for a, b, on in some]
    every = [(a, b, True) for a, b, _ in some]
    assert C.cfl_decode(C.cfl_encode(every)) == every and C.cfl_decode(b"") == []


def test_probe():
    noise = random.Random(2).randbytes(5000)
    assert C.probe(b"ab" * 4000) and C.probe(noise[:100])
    assert C.probe(noise) == (len(C.lz_compress(noise[:4096])) * 1000 <= 4096 * 1030)
    assert not C.probe(noise, permille=900)


def test_nearest_copy():
    from blockloom.operators.search import nearest_copy

    samples = np.random.default_rng(3).integers(0, 256, (24, 32))
    samples[16:24, 8:16] = samples[3:11, 13:21]
    assert nearest_copy(samples, 2, 1) == (5, -13, 0)
    assert nearest_copy(samples, 0, 0) == (0, 0, -1)


# ---- all streams at once, searches, blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12))
def test_many_streams_are_coded_as_one_by_one(streams):
    coded = C.adaptive_encode_many(streams)
    assert coded == [C.adaptive_encode(x) for x in streams]
    assert C.adaptive_decode_many(coded) == streams


def test_damaged_streams_among_many():
    good = C.adaptive_encode_many([b"abc" * 50, b"x" * 9])
    assert C.adaptive_decode_many([good[0][:-3], b"", good[1], good[0][:1000], good[0]]) == [None, None, b"x" * 9, None, b"abc" * 50]


def test_range_coder_bytes_by_hand():
    """Two symbols of equal weight, one lane: x = 65536; 'b' then 'a' from the back."""
    freq = np.zeros(256, np.int64)
    freq[97] = freq[98] = 2048
    x = 65536
    for symbol in reversed(b"ab"):
        low = 0 if symbol == 97 else 2048
        x = (x // 2048 << 12) + x % 2048 + low
    assert C.rans_encode(b"ab", freq, 1) == x.to_bytes(4, "big")
    assert C.rans_decode(C.rans_encode(b"ab", freq, 1), 2, freq, 1) == [97, 98]


def test_lz_bytes_by_hand():
    assert C.lz_compress(b"abcabcabcabd") == b"\0\x03abc\1\x08\x03\0\0\1d"
    assert C.lz_compress(b"ab") == b"\0\2ab" and C.lz_compress(b"") == b""
    assert C.type_runs([0] * 66 + [3]) == bytes((63 << 2, 1 << 2, 3))
    assert C.pack_bits([1, 2, 3, 4, 5], 3) == bytes((0b11010001, 0b1011000))
    assert C.lz_model().sum() == 4096 and C.lz_model().argmax() == 0


def best_match(data, p, depth, window, nice, near):
    slots, length, distance, seen = lz.slots_of(np.frombuffer(data, np.uint8)), 0, 0, 0
    for r in range(p - 1, -1, -1):
        if p >= len(slots) or slots[r] != slots[p]:
            continue
        seen += 1
        if seen > depth or p - r > window:
            break
        n = 0
        while n < min(255, len(data) - p) and data[r + n] == data[p + n]:
            n += 1
        if n > length and (n > 3 or n == 3 and (near is None or p - r <= near)):
            length, distance = n, p - r
        if length >= nice:
            break
    return length, distance


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=3, max_size=120).map(lambda x: bytes(b % 3 + 97 for b in x)), st.sampled_from([2, 8]), st.sampled_from([10, 1000]), st.sampled_from([None, 6]))
def test_chained_search_is_exhaustive_in_its_chain(data, depth, window, near):
    length, distance = lz.Matcher(data).best(depth, window, 16, near)
    assert list(zip(length.tolist(), distance.tolist(), strict=True)) == [best_match(data, p, depth, window, 16, near) for p in range(len(data))]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=90).map(lambda x: bytes(b % 3 + 97 for b in x)))
def test_optimal_parse_takes_the_fewest_bytes(data):
    coded = C.lz_optimal(data)
    assert C.lz_decompress(coded, len(data)) == data
    assert C.lz_decompress(C.lz_global(data, lazy=True), len(data)) == data and C.lz_decompress(C.lz_global(data), len(data)) == data
    if len(data) >= 3:
        length, _ = lz.candidates(lz.Matcher(data), GlobalLz())
        best = [0] + [1 << 30] * len(data)
        for p in range(len(data)):
            for n, cost in [(k, 2 + k) for k in range(1, len(data) - p + 1)] + [(n, 4) for n in length[p].tolist() if n]:
                best[p + n] = min(best[p + n], best[p] + cost)
        assert len(coded) == best[-1]


def kinds_of(samples):
    return lossless.tile_parts(modes.padded(samples), lossless.PRESETS["balanced"])[0].kinds


def four_kinds():
    rng = np.random.default_rng(4)
    out = np.full((64, 72), 200)
    out[8:40:9], out[:, 20:24], out[48:52, :30] = 30, 90, 7
    out[30:50, 30:60] = rng.integers(0, 256, (20, 30))
    return out


@pytest.mark.parametrize("samples", [four_kinds(), np.zeros((1, 1), int), np.random.default_rng(1).integers(-300, 300, (13, 21)), np.tile(np.arange(9) * 7, (17, 3))])
def test_all_routes_give_the_samples_back(samples):
    samples = samples.astype(np.int64)
    open_gates = RouteGates(always=True)
    for preset in lossless.PRESETS.values():
        assert (lossless.decode_band(lossless.encode_band(samples, preset, open_gates)) == samples).all()
        for _, payload in lossless.natural_modes(samples, preset):
            assert (lossless.natural_decode(payload, *samples.shape) == samples).all()
    tile = lossless.tile_encode(samples, lossless.PRESETS["balanced"])
    assert (lossless.tile_decode(tile, *samples.shape) == samples).all()
    assert sum(lossless.tile_sizes(tile)) - lossless.tile_sizes(tile)[3] + 32 == len(tile)


def test_blocks_of_all_kinds_are_coded():
    samples = four_kinds()
    assert set(np.unique(kinds_of(samples))) == {0, 1, 2, 3}
    assert len(lossless.tile_encode(samples, lossless.PRESETS["balanced"])) < len(C.adaptive_encode(samples.astype(np.uint8).tobytes()))


def test_png_depths_and_damage():
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    for k in range(5):
        assert (png.read_png(png.write_png(rgb, [k])) == rgb).all()
    whole = png.write_png(rgb)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    made = lambda head, raw, more=b"": png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert png.read_png(made((3, 1, 1, 0, 0, 0, 0), b"\0\xa0")).tolist() == [[[255] * 3, [0] * 3, [255] * 3]]
    assert png.read_png(made((2, 1, 4, 3, 0, 0, 0), b"\0\x10", chunk(b"PLTE", bytes(range(6))))).tolist() == [[[3, 4, 5], [0, 1, 2]]]
    assert png.read_png(made((1, 1, 16, 4, 0, 0, 0), b"\0\x12\x34\xff\xff")).tolist() == [[[0x12] * 3]]
    assert png.read_png(made((1, 1, 8, 6, 0, 0, 0), b"\0\1\2\3\4")).tolist() == [[[1, 2, 3]]]
    passes = b"".join(b"\0" + rgb[y, x0::dx].tobytes() for x0, y0, dx, dy in png.PASSES for y in range(y0, 9, dy) if len(rgb[y, x0::dx]))
    assert (png.read_png(made((7, 9, 8, 2, 0, 0, 1), passes)) == rgb).all()
    for bad in (b"", whole[:-20], whole.replace(b"IHDR", b"IHDX"), made((1, 1, 8, 2, 0, 0, 0), b"\0"), made((1, 1, 8, 2, 0, 0, 0), b"\7\1\2\3")):
        with pytest.raises((Damaged, struct.error)):
            png.read_png(bad)


# ---- the lossy plan


def picture(h=72, w=88):
    y, x = np.mgrid[0:h, 0:w]
    rgb = np.stack([128 + 100 * np.sin(x / 9 + y / 30), 128 + 90 * np.sin(x / 9 + y / 30 + 0.2), 60 + x + y / 2], -1)
    rgb += np.random.default_rng(3).normal(0, 4, rgb.shape)
    rgb[16:40, 24:56] = 200
    rgb[20:30, 30:50] = (10, 20, 240)
    rgb[48:64, 24:56] = rgb[16:32, 24:56]
    return np.clip(rgb, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("options", [lossy.Lossy(), lossy.Lossy(cfl=False), lossy.Lossy(adaptive=True), lossy.Lossy(screen=True), lossy.Lossy(True, True, True)])
@pytest.mark.parametrize("subsample", [False, True])
def test_lossy_images(options, subsample):
    rgb = picture()
    data = images.encode_lossy(rgb, 85, subsample, options)
    assert images.psnr(rgb, images.decode(data)) > (27 if subsample else 30)
    assert images.decode(data).shape == rgb.shape


def test_parts_of_a_lossy_plane():
    rgb = picture()
    y, cb, _ = images.to_ycbcr(rgb)
    table = images.quant_table(75)
    whole = lossy.encode_plane(y, table, lossy.Lossy(screen=True, adaptive=True))
    sizes = lossy.stream_sizes(whole)
    assert sizes["kinds"] and sizes["palettes"] and sizes["vectors"] and sizes["deltas"]
    assert len(whole) == 48 + sum(sizes.values())
    fitted, plain = (lossy.encode_plane(cb, table, lossy.Lossy(cfl=on), y) for on in (True, False))
    assert lossy.stream_sizes(fitted)["cfl"] and not lossy.stream_sizes(plain)["cfl"]
    exact = lossy.decode_plane(lossy.encode_plane(np.tile(y[:8, :8] // 64 * 64, (4, 4)), table, lossy.Lossy(screen=True)), table)
    assert (exact == np.tile(y[:8, :8] // 64 * 64, (4, 4))).all()


def test_restart_points_give_the_same_plane(monkeypatch):
    noise = np.random.default_rng(1).integers(0, 256, (64, 64))
    table = images.quant_table(90)
    plain = lossy.encode_plane(noise, table)
    monkeypatch.setattr(lossy, "RESTART_BYTES", 0)
    marked = lossy.encode_plane(noise, table)
    assert lossy.stream_sizes(marked)["restarts"] and not lossy.stream_sizes(plain)["restarts"]
    assert (lossy.decode_plane(marked, table) == lossy.decode_plane(plain, table)).all()


def test_band_tokens_round_trip():
    rng = np.random.default_rng(2)
    for size in (15, 16, 32):
        q = rng.integers(-3, 4, (40, size)) * (rng.random((40, size)) < 0.3)
        tokens = [t for row in q for t in lossy.block_tokens(row)]
        assert (lossy.from_block_tokens(tokens, 40, size) == q).all()


def test_fits_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    from blockloom.operators import blocks as K2

    rng = np.random.default_rng(6)
    luma = rng.integers(0, 256, (30, 64))
    chroma = np.clip(luma * rng.uniform(-0.9, 0.9, (30, 1)) + rng.normal(100, 20, (30, 64)), 0, 255).astype(int)
    luma[3] = 90
    table = lambda b: spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(b)], "bi long, b array<int>")
    want = K2.cfl_fit(table(luma), table(chroma), ["bi"]).orderBy("bi").select(F.col("alpha_q6"), F.col("beta"), F.col("applied")).collect()
    alpha, beta, adopted = lossy.cfl_fit(luma, chroma)
    assert list(zip(alpha.tolist(), beta.tolist(), adopted.tolist(), strict=True)) == [tuple(r) for r in want]


def test_a_look_at_the_band_is_that_of_the_columns(spark):
    from blockloom.operators import planes as L

    rng = np.random.default_rng(5)
    for samples in (rng.integers(0, 256, (70, 90)), np.add.outer(np.arange(40), np.arange(64)) // 8, np.full((9, 9), 3), np.repeat(rng.integers(0, 60, (64, 16)), 8, axis=1)):
        plane = spark.createDataFrame([("e", y, [int(v) for v in r]) for y, r in enumerate(samples)], "image_id string, y long, row array<int>")
        want = L.natural_like(L.preflight(plane, samples.shape[1], samples.shape[0]), NaturalGate()).first()
        m = lossless.preflight(samples)
        assert [want[k] for k in ("unique_sample", "avg_run_x100", "mean_diff_x100", "entropy_x100")] == [m[k] for k in ("unique", "run", "difference", "entropy")]
        assert (want["likely_screen"], want["natural_like"]) == (lossless.likely_screen(m), lossless.natural_like(m, NaturalGate()))


def test_presets_choose_routes():
    flat = np.repeat(np.random.default_rng(2).integers(0, 20, (64, 8)), 8, axis=1).astype(np.int64)
    names = lambda preset, chroma=False, gates=RouteGates(): [r for r, _ in lossless.routes(flat, PRESETS[preset], gates, chroma)]
    assert names("fast") == [lossless.TILE] and len(names("max", gates=RouteGates(always=True))) > 1
    assert names("balanced") == names("max", chroma=True)
    wide = np.cumsum(np.random.default_rng(3).integers(-9, 10, (512, 512)), axis=1).astype(np.int64)
    assert lossless.tried(lossless.preflight(wide), wide.size, 2, RouteGates()) == (False, True)
    assert lossless.tried(lossless.preflight(flat), flat.size, 0, RouteGates()) == (True, False)
