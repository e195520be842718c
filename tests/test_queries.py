"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from blockloom import more_queries, queries  # noqa: F401
from blockloom.operators import codecs
from blockloom.plans import images, lossless, modes

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    return df[cols].sort_values(cols, ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got = ordered(queries.QUERIES[name](spark, DIR).toPandas())
    want = ordered(duck.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


# ---- queries without SQL, against plain versions


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t.encode() for i, t in duck.sql("select doc_id, text from documents where text is not null").fetchall()}


def plain_greedy(data, window=32768):
    """The greedy parse as the format defines it: (bytes, tokens)."""
    heads, pos, size, run = {}, 0, 0, 0
    literals = lambda n: n + 2 * -(-n // 255)
    if len(data) < 3:
        return literals(len(data))
    while pos < len(data) - 2:
        h = ((data[pos] << 16 | data[pos + 1] << 8 | data[pos + 2]) * 0x1E35A7BD & 0xFFFFFFFF) >> 16
        ref = heads.get(h, -1)
        heads[h] = pos
        if ref < 0 or pos - ref > window or data[ref : ref + 3] != data[pos : pos + 3]:
            pos, run = pos + 1, run + 1
            continue
        n = 3
        while n < 255 and pos + n < len(data) and data[ref + n] == data[pos + n]:
            n += 1
        size, run, pos = size + literals(run) + 4, 0, pos + n
    return size + literals(run + len(data) - pos)


def test_lz_sizes(spark, texts):
    got = {r["stream_id"]: r["lz_bytes"] for r in queries.QUERIES["lz_sizes"](spark, DIR).collect()}
    assert {i: got[i] for i in texts} == {i: plain_greedy(t) for i, t in texts.items()}


def test_probe_streams(spark, texts):
    got = {r["worth_it"]: r["n"] for r in queries.QUERIES["probe_streams"](spark, DIR).where("worth_it is not null").collect()}
    want = {}
    for t in texts.values():
        ok = int(len(t) < 4096 or plain_greedy(t[:4096]) * 1000 <= 4096 * 1030)
        want[ok] = want.get(ok, 0) + 1
    assert got == want


def test_codec_choice(spark, texts):
    got = {r["kind"]: r["n"] for r in queries.QUERIES["codec_choice"](spark, DIR).where("kind is not null").collect()}
    want = {}
    for t in texts.values():
        best, kind = len(t), 0
        for k, size in ((1, 6 + len(codecs.adaptive_encode(t))), (2, 6 + plain_greedy(t))):
            if size < best and size * 1000 <= len(t) * 980:
                best, kind = size, k
        want[kind] = want.get(kind, 0) + 1
    assert got == want


def plane_of(duck):
    rows = duck.sql("select embedding from embeddings order by vec_id").fetchall()
    return np.clip(np.floor(np.array([r[0] for r in rows], np.float32).astype(float) * 240).astype(int) + 128, 0, 255)


def test_low_byte_modes(spark, duck):
    plane, want = plane_of(duck), {}
    for band in range(0, len(plane), 512):
        part = modes.padded(plane[band : band + 512])
        _, filters, lines = lossless.tile_parts(part, lossless.PRESETS["balanced"])
        sizes = [len(x) for x in lines]
        raw = np.concatenate(lines) & 255
        for mode, payload in lossless.lo_candidates([x & 255 for x in lines], filters):
            want[mode] = want.get(mode, 0) + len(payload)
            assert (lossless.lo_decode(bytes((mode,)) + payload, filters, sizes) == raw).all()
    got = {r["mode"]: r["n_bytes"] for r in queries.QUERIES["low_byte_modes"](spark, DIR).collect()}
    assert got == want and set(got) >= {0, 1, 2, 3, 4, 5, 6, 7, 8}


def test_nearest_copies(spark, duck):
    plane = modes.padded(plane_of(duck))
    got = {(r["by"], r["bx"]): (r["dx"], r["dy"], r["sad"]) for r in queries.QUERIES["nearest_copies"](spark, DIR).collect()}
    assert len(got) == plane.size // 64
    for by, bx in [(0, 0), (0, 3), (1, 0), (5, 7), (20, 4), (33, 1)]:
        y, x, best = by * 8, bx * 8, (0, 0, -1)
        own = plane[y : y + 8, x : x + 8]
        for sy in range(max(0, y - 64), y + 1):
            for sx in range(max(0, x - 64), min(plane.shape[1] - 8, x + 64) + 1):
                if not (sy + 8 <= y and sx <= x + 63 or sy == y and sx + 8 <= x):
                    continue
                sad = int(np.abs(plane[sy : sy + 8, sx : sx + 8] - own).sum())
                if best[2] < 0 or sad < best[2]:
                    best = (sx - x, sy - y, sad)
        assert got[by, bx] == best


def image_of(duck, k=0):
    rows = plane_of(duck)[192 * k : 192 * (k + 1)]
    n = len(rows) // 3
    return np.stack([rows[c * n : (c + 1) * n] for c in range(3)], axis=-1).astype(np.uint8)


def test_image_compare(spark, duck):
    rows = {r["id"]: r for r in queries.QUERIES["image_compare"](spark, DIR).collect()}
    assert len(rows) == -(-len(plane_of(duck)) // 192) and all(r["exact"] for r in rows.values())
    rgb = image_of(duck)
    coded = images.encode_lossy(rgb, 75)
    assert (rows[0]["lossless_bytes"], rows[0]["lossy_bytes"]) == (len(images.encode_lossless(rgb)), len(coded))
    error = ((images.decode(coded).astype(float) - rgb) ** 2).mean()
    assert abs(rows[0]["psnr"] - 10 * np.log10(255**2 / error)) < 1e-3


def test_quality_bench(spark, duck):
    rows = [r for r in queries.QUERIES["quality_bench"](spark, DIR).collect() if r["id"] == 0]
    assert sorted((r["subsampled"], r["quality"]) for r in rows) == [(s, q) for s in (0, 1) for q in (50, 75, 90)]
    full = {r["quality"]: r for r in rows if not r["subsampled"]}
    assert full[50]["n_bytes"] < full[75]["n_bytes"] < full[90]["n_bytes"] and full[50]["psnr"] < full[90]["psnr"]
    assert full[90]["n_bytes"] == len(images.encode_lossy(image_of(duck), 90))


def test_screen_bench(spark, duck):
    rows = {r["id"]: r for r in queries.QUERIES["screen_bench"](spark, DIR).collect()}
    rgb = image_of(duck) // 64 * 64
    assert rows[0]["plain_bytes"] == len(images.encode_lossy(rgb, 75))
    assert all(abs(r["saved_percent"] - 100 * (1 - r["screen_bytes"] / r["plain_bytes"])) < 1e-9 and abs(r["gained_db"] - (r["screen_psnr"] - r["plain_psnr"])) < 1e-9 for r in rows.values())


def test_all_queries_have_a_check():
    named = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(queries.QUERIES) - set(queries.ORACLES) <= named


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
