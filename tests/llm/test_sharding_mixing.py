from collections import Counter

import pytest

from blockloom.llm import mixing, sharding

from conftest_llm import SCHEMA, prose


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, prose(k, 1 + k * 7 % 90), "en", None if k % 11 == 0 else f"s{min(k % 7, 3)}", 1) for k in range(400)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_level_and_gapless(docs, n):
    got = sharding.shard_documents(docs, n).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == n
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


@pytest.mark.parametrize("epsilon,most", [(0.05, 0.3), (0.0, 0.6)])
def test_one_more_shard_moves_little(epsilon, most):
    counts = {c: 50 for c in range(1 << sharding.CELL_BITS)}
    total = sum(counts.values())

    def owners(n):
        out = {}
        for cell, lo, hi, shard, _ in sharding.walk(counts, n, epsilon=epsilon):
            for r in range(lo, hi):
                out[cell, r] = shard
        return out

    a, b = owners(8), owners(9)
    assert max(Counter(a.values()).values()) <= (1 + epsilon) * total / 8 + 1
    moved = sum(a[k] != b[k] for k in a)
    assert total / 9 * 0.9 <= moved <= total * most


def test_cells_grow_with_the_rows(docs, monkeypatch):
    assert [sharding.cell_bits_for(n) for n in (0, 1000, 10**8, 10**12)] == [12, 12, 13, 16]
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 1)
    monkeypatch.setattr(sharding, "CELL_BITS", 2)
    test_shards_are_level_and_gapless(docs, 8)


def test_overflow_goes_clockwise():
    prefs = sharding.preferences(4)
    for cell, lo, hi, shard, _ in sharding.walk({c: 3 for c in range(1 << sharding.CELL_BITS)}, 4):
        assert shard in prefs[cell] and hi > lo


def test_all_columns_stay(docs):
    out = sharding.sharded(docs, 5)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(400))


def test_targets_by_hand(docs):
    got = mixing.mix(docs).collect()
    sources = {}
    for r in docs.collect():
        sources.setdefault(r["source"], []).append(r["doc_id"])
    names = sorted((s for s in sources if s is not None)) + [None]
    size = {s: sum(r["size"] for r in got if r["doc_id"] in set(sources[s])) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        mine = [r for r in got if r["doc_id"] in set(sources[s])]
        want = 3 * size[s] if s in capped else level * weight[s]
        assert all(abs(r["target"] - want) < 1e-6 and r["source_size"] == size[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
        assert all(len(r["positions"]) == -(-r["taken"] // r["size"]) for r in mine)


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        area = lambda t: sum((w0 + (w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0))) / 2 * (min(t, t1) - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False) if t > t0)  # noqa: E731, B023
        for u in (0.0, 0.1, 0.5, 0.77, 1.0):
            t = spark.range(1).select(mixing.position(F.lit(u), knots).alias("t")).first()["t"]
            assert abs(area(t) / area(1.0) - u) < 1e-9


def test_order_and_reruns(docs):
    a = [(r["doc_id"], r["first_position"]) for r in mixing.in_training_order(mixing.mix(docs)).collect()]
    b = [(r["doc_id"], r["first_position"]) for r in mixing.in_training_order(mixing.mix(docs.repartition(7))).collect()]
    assert a == b and [p for _, p in a] == sorted(p for _, p in a)
