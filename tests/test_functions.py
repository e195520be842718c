"""Values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from blockloom import config
from blockloom.functions import block as B, pixel as P, text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize("v,u", [(0, 0), (-1, 1), (1, 2), (-2, 3), (2, 4), (-255, 509), (255, 510)])
def test_signs(spark, v, u):
    assert one(spark, P.fold_sign(F.lit(v))) == u
    assert one(spark, P.unfold_sign(F.lit(u))) == v


@pytest.mark.parametrize("rgb,want", [((255, 0, 0), (63, 255, -127)), ((0, 255, 0), (127, 0, 255)), ((0, 0, 255), (63, -255, -127)), ((10, 20, 30), (20, -20, 0))])
def test_reversible_colours(spark, rgb, want):
    got = tuple(one(spark, c) for c in P.rgb_to_ycocg(*lit(*rgb)))
    assert got == want
    assert tuple(one(spark, c) for c in P.ycocg_to_rgb(*lit(*got))) == rgb


@pytest.mark.parametrize("rgb,want", [((255, 0, 0), (76, 85, 255)), ((0, 255, 0), (149, 43, 21)), ((10, 20, 30), (18, 134, 122))])
def test_luma_chroma(spark, rgb, want):
    assert tuple(one(spark, c) for c in P.rgb_to_ycbcr(*lit(*rgb))) == want


@pytest.mark.parametrize("f,abc,want", [(P.paeth, (10, 20, 15), 15), (P.paeth, (10, 20, 20), 10), (P.med, (10, 20, 5), 20), (P.med, (10, 20, 25), 10), (P.med, (10, 20, 15), 15), (P.med, (10, 20, 10), 20)])
def test_predictors(spark, f, abc, want):
    assert one(spark, f(*lit(*abc))) == want


def test_averages_cut_toward_zero(spark):
    assert one(spark, P.prediction(3, *lit(-3, 0, 0))) == -1
    assert one(spark, P.prediction(6, *lit(-3, 0, 0))) == -2


def test_quant_tables():
    assert [B.quant_table(q)[0] for q in (10, 50, 75, 90, 100)] == [80, 16, 8, 3, 1]
    assert min(B.quant_table(100)) == 1 and max(B.quant_table(1)) == 255


def test_zigzag_order():
    order = B.zigzag_order()
    assert sorted(order) == list(range(64))
    assert order[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and order[-3:] == [55, 62, 63]


def test_flat_block_transform(spark):
    got = one(spark, B.forward_dct(F.array_repeat(F.lit(8), 64)))
    assert got[0] == 65
    assert all(v == 0 for v in got[1:])


@pytest.mark.parametrize("v,want", [(0, (64, 0, 0)), (1, (65, 0, 2)), (-1, (65, 2, 2)), (-3, (66, 5, 3)), (7, (67, 3, 4)), (-8, (68, 16, 5))])
def test_tokens(spark, v, want):
    assert tuple(one(spark, B.dc_token(F.lit(v)))) == want


def test_ac_tokens_come_back(spark):
    values = [0] * 5 + [3, 0, 0, -2] + [0] * 53 + [1]
    tokens = B.ac_tokens(F.array(*lit(*values)))
    assert one(spark, B.untoken_ac(tokens)) == values
    assert one(spark, B.untoken_ac(B.ac_tokens(F.array_repeat(F.lit(0), 63)))) == [0] * 63


def test_nulls(spark):
    null = F.lit(None).cast("int")
    for c in (P.fold_sign(null), P.clamp(null, 0, 9), P.residual_cost(null), P.magnitude_class(null), P.palette_bits(null), B.band(null), T.choice(F.lit(None).cast("string"), ("a",))):
        assert one(spark, c) is None


def test_gate_accepts_equality(spark):
    assert one(spark, P.within_permille(F.lit(990), F.lit(1000), 990))
    assert one(spark, P.within_permille(F.lit(990), F.lit(1000), 991))
    assert not one(spark, P.within_permille(F.lit(991), F.lit(1000), 990))


def test_psnr(spark):
    assert one(spark, T.psnr(F.lit(0.0), 100.0)) == 100.0
    assert one(spark, T.psnr(F.lit(255.0**2))) == 0.0


def test_settings():
    assert config.setting_int("7", 1, 0, 9) == 7
    assert config.setting_int("70", 1, 0, 9) == 1
    assert config.setting_int("70", 1, 0, 9, clamp_high=True) == 9
    assert config.setting_int(None, 1, 0, 9) == config.setting_int("x", 1, 0, 9) == 1
    assert config.setting_float("nan", 0.5, 0, 1) == 0.5
    assert config.setting_bool("ON", False) and not config.setting_bool("?", False)
