"""Codecs of many streams at once give the bytes of one by one."""

import numpy as np
import pytest

from blockloom import queries
from blockloom.operators import codecs as C, joined as J, lanes as M, lz

RNG = np.random.default_rng(1)
ODD = [b"", b"a", b"ab", b"abc", b"aaaa", b"a" * 1000, b"abcabcabcabd" * 50, bytes(range(256)) * 6, b"", RNG.integers(0, 2, 3000).astype(np.uint8).tobytes()]
ODD += [RNG.integers(0, k % 7 + 1, k * 5).astype(np.uint8).tobytes() for k in range(1, 60)]
SIZES = [len(x) for x in ODD]


@pytest.fixture(params=[1, 48, 10000])
def few(request, monkeypatch):
    """Streams step by step, some, or all of them one by one."""
    for module, name in ((J, "FEW"), (J, "FEW_PARSED"), (M, "FEW")):
        monkeypatch.setattr(module, name, request.param)


def damaged(x, size):
    try:
        return lz.lz_decompress(x, size)
    except lz.Damaged:
        return None


def test_optimal_parses_of_many_streams(few, monkeypatch):
    want = [lz.lz_optimal(x) for x in ODD]
    assert J.lz_optimal_many(ODD) == want
    monkeypatch.setattr(J, "PARSED", 2000)
    monkeypatch.setattr(J, "LONG", 2500)
    monkeypatch.setattr(J, "CHUNK", 64)
    assert J.lz_optimal_many(ODD) == want
    assert C.lz_decompress_many(want, SIZES) == ODD


def test_of_equal_matches_the_nearer_ones_stay():
    data = b"abcdX" * 3 + b"abcdeZ" + b"abcdY" * 3 + b"abcdeQ"
    length, distance = lz.candidates(lz.Matcher(data), lz.GlobalLz())
    for sizes, ways in zip(length.tolist(), distance.tolist(), strict=True):
        found = [(-n, d) for n, d in zip(sizes, ways, strict=True) if n]
        assert found == sorted(found)


def test_damaged_lz_streams_among_many(few):
    bad = []
    for x in map(lz.lz_compress, ODD):
        if x:
            part = bytearray(x[: int(RNG.integers(1, len(x) + 1))])
            part[int(RNG.integers(0, len(part)))] = int(RNG.integers(0, 4))
            bad.append(bytes(part))
    for size in (None, 0, 5, 40, 300):
        assert C.lz_decompress_many(bad, None if size is None else [size] * len(bad)) == [damaged(x, size) for x in bad]


def test_streams_of_a_task_are_coded_together(spark):
    """A function gets the streams of a batch, those of similar size first, and nulls stay null."""
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else bytearray(b"x" * (k % 7))) for k in range(40)], "stream_id long, content binary").coalesce(1)
    got = C.map_batches(rows, lambda x: [len(x) if len(y) == len(x[0]) else -len(y) for y in x], out="n", kind="long").collect()
    assert [r["n"] for r in sorted(got)] == [None if k % 5 == 0 else 32 if k % 7 == 6 else -(k % 7) for k in range(40)]


def test_one_model_for_many_streams(few):
    coded = C.shared_encode_many(ODD, C.lz_model())
    assert coded == [C.shared_encode(x, C.lz_model()) for x in ODD]
    assert C.shared_decode_many([*coded, coded[5][:-1], b"abc"], C.lz_model()) == [*ODD, None, None]


def test_all_parts_from_restart_points_at_once(few):
    assert C.through_restarts_many(ODD) == ODD
    freqs = M.models(np.stack([C.laplace(x) for x in ODD]))
    coded = M.encode_many([np.frombuffer(x, np.uint8) for x in ODD], freqs)
    found, stream, before = M.restart_many(coded, np.array(SIZES), freqs, 64)
    starts = np.cumsum([0, *map(len, coded)])
    want = [(k, p.token, p.byte, p.states) for k, x in enumerate(coded) for p in C.restart_points(x, SIZES[k], freqs[k], 64)]
    assert list(zip(stream.tolist(), before.tolist(), (found.pos - starts[stream]).tolist(), found.state.tolist(), strict=True)) == want


def test_the_smallest_forms_of_many_streams(few):
    for permille in (980, 1000):
        got = C.smallest_many(ODD, 0xA9, permille=permille)
        assert got == [C.smallest(x, 0xA9, permille=permille) for x in ODD]
        assert C.unwrapped_many(got, 0xA9) == ODD


def test_codec_choice_is_that_of_one_by_one(spark):
    texts = [r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"] is not None]
    kinds = [y[1] if (y := C.smallest(x, 0xA9))[:1] == b"\xa9" and y != x else 0 for x in texts]
    got = {r["kind"]: r["n"] for r in queries.QUERIES["codec_choice"](spark, "/root/testdata/sf0.001").where("kind is not null").collect()}
    assert got == {k: kinds.count(k) for k in set(kinds)}
    assert kinds == [y[1] if y[:1] == b"\xa9" and y != x else 0 for x, y in zip(texts, C.smallest_many(texts, 0xA9), strict=True)]


def test_token_streams_of_many_streams(few):
    coded = [lz.lz_compress(x) for x in ODD]
    parts = C.Tokens(coded).streams()
    want = [C.token_streams(x) for x in coded]
    assert all(parts[k] == [x[k] for x in want] for k in parts)
    assert C.rebuilt_many(parts) == coded


def test_separate_streams_of_many_streams(few):
    coded = C.streams_encode_many(ODD)
    assert coded == [C.streams_encode(x) for x in ODD]
    assert C.streams_decode_many(coded) == ODD


def test_token_streams_in_their_smallest_forms(few):
    coded = C.token_streams_encode_many(ODD)
    assert coded == [C.token_streams_encode(x) for x in ODD]
    assert C.token_streams_decode_many(coded, SIZES) == ODD


def test_greedy_parses_of_many_streams(few):
    coded = C.lz_compress_many(ODD)
    assert coded == [lz.lz_compress(x) for x in ODD]
    assert C.lz_decompress_many(coded) == C.lz_decompress_many(coded, SIZES) == ODD


def test_a_task_codes_a_few_megabytes_at_once(spark):
    """However large a batch is, a function gets no more than BATCH bytes, or one stream."""
    rows = spark.range(9).selectExpr("id AS stream_id", "cast(repeat('x', 1500000) AS binary) AS content").coalesce(1)
    got = C.map_batches(rows, lambda x: [sum(map(len, x))] * len(x), out="n", kind="long").collect()
    assert len(got) == 9 and max(r["n"] for r in got) <= J.BATCH


def test_sizes_of_greedy_parses(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["stream_id"]: r["lz_bytes"] for r in queries.QUERIES["lz_sizes"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: None if x is None else len(lz.lz_compress(x.encode())) for k, x in texts.items()}
    assert list(map(len, C.lz_compress_many([x.encode() for x in texts.values() if x is not None]))) == [n for n in (got[k] for k in texts) if n is not None]
