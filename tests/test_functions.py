"""Scalar functions at their edges, against Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import data as d
from tessella.functions import scalar as s
from tessella.plans.session import configure


@pytest.fixture(scope="module")
def sp(spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    yield configure(spark)
    spark.conf.set("spark.sql.ansi.enabled", old)


def col(sp, cols, rows, schema):
    return [tuple(r) for r in sp.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + schema).orderBy("k").select(*cols).collect()]


def test_whole_division(sp):
    rows = [(a, b) for a in (-7, -6, 0, 6, 7, -(1 << 63), (1 << 63) - 1) for b in (-3, -1, 2, 3, (1 << 63) - 1) if (a, b) != (-(1 << 63), -1)]
    a, b = F.col("a"), F.col("b")
    got = col(sp, [s.quot(a, b), s.rem(a, b), s.div(a, b), s.mod(a, b)], rows, "a long, b long")
    quot = lambda x, y: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
    assert got == [(quot(x, y), x - y * quot(x, y), x // y, x % y) for x, y in rows]
    with pytest.raises(Exception, match="division by zero"):
        col(sp, [s.quot(a, b)], [(1, 0)], "a long, b long")


def test_wraparound(sp):
    a = F.col("a")
    assert col(sp, [s.add(a, 1), s.mul(a, 2), s.negate(s.sub(a, (1 << 63) - 1))], [((1 << 63) - 1,)], "a long") == [(-(1 << 63), -2, 0)]
    assert col(sp, [s.from_integral(a, "tinyint"), s.abs_(a)], [(300,)], "a long") == [(44, 300)]


def test_bits(sp):
    rng = random.Random(1)
    xs = [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
    a = F.col("a")
    u = lambda x: x % (1 << 64)
    sg = lambda x: x - (1 << 64) if x >> 63 else x
    got = col(sp, [s.pop_count(a), s.count_leading_zeros(a), s.count_trailing_zeros(a), s.rotate_l(a, 13), s.rotate_r(a, 13), s.shift_l(a, 64), s.shift_r(a, 70), s.shift_l(a, 5), s.shift(a, -3), s.test_bit(a, 63), s.complement(a)], [(x,) for x in xs], "a long")
    rot = lambda x, n: sg((x << n | x >> (64 - n)) % (1 << 64))
    want = [(bin(u(x)).count("1"), 64 - u(x).bit_length(), (u(x) & -u(x)).bit_length() - 1 if x else 64, rot(u(x), 13), rot(u(x), 51), 0, -1 if x < 0 else 0, sg(u(x << 5)), x >> 3, x < 0, ~x) for x in xs]
    assert got == want
    small = col(sp, [s.pop_count(a, "int"), s.count_leading_zeros(a, "int"), s.count_trailing_zeros(a, "int"), s.rotate_l(a, 4, "int")], [(-1,), (1,), (0,)], "a int")
    assert small == [(32, 0, 0, -1), (1, 31, 0, 16), (0, 32, 32, 0)]


def same(x, y):
    return (math.isnan(x) and math.isnan(y)) or x == y


def test_floats(sp):
    inf, nan = math.inf, math.nan
    a, b = F.col("a"), F.col("b")
    got = col(sp, [s.fdiv(a, b)], [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (6.0, 3.0)], "a double, b double")
    assert all(same(x[0], y) for x, y in zip(got, [inf, -inf, nan, nan, 2.0]))
    got = col(sp, [s.log(a)], [(0.0,), (-1.0,), (1.0,), (nan,)], "a double")
    assert all(same(x[0], y) for x, y in zip(got, [-inf, nan, 0.0, nan]))
    assert col(sp, [s.round_(a), s.truncate(a), s.floor(a), s.ceiling(a)], [(2.5,), (-2.5,), (3.5,)], "a double") == [(2, 2, 2, 3), (-2, -2, -3, -2), (4, 3, 3, 4)]
    assert col(sp, [s.eq(a, b), s.ne(a, b), s.lt(a, b), s.ge(a, b)], [(nan, nan), (1.0, nan), (1.0, 2.0)], "a double, b double") == [(False, True, False, False), (False, True, False, False), (False, True, True, False)]
    xs = [1.0, 0.5, -3.75, 1e300, 5e-324, 2.0**-1022, 0.0, 1.7976931348623157e308]
    got = col(sp, [s.significand(a), s.exponent(a)], [(x,) for x in xs], "a double")
    assert got == [math.frexp(x) for x in xs]
    got = col(sp, [s.encode_float(*s.decode_float(a)), s.is_denormalized(a), s.is_negative_zero(a)], [(x,) for x in [*xs, -0.0]], "a double")
    assert [g[0] for g in got] == [*xs, 0.0] and [g[1] for g in got] == [x == 5e-324 for x in [*xs, 0]] and [g[2] for g in got] == [False] * 8 + [True]


def test_gcd_power_data(sp):
    a, b = F.col("a"), F.col("b")
    rows = [(12, 18), (0, 5), (-4, 6), (7, 0), (1 << 40, 3 << 20)]
    assert col(sp, [s.gcd(a, b), s.lcm(a, b)], rows, "a long, b long") == [(math.gcd(x, y), math.lcm(x, y)) for x, y in rows]
    assert col(sp, [s.power(a, b)], [(3, 7), (2, 63), (5, 0)], "a long, b long") == [(2187,), (-(1 << 63),), (1,)]
    r = d.ratio(a, b)
    assert col(sp, [r["num"], r["den"], d.radd(r, d.ratio(1, 2))["num"]], [(2, -4), (6, 4), (3, 0)], "a long, b long")[:2] == [(-1, 2, 0), (3, 2, 2)]
    q = d.to_rational(F.col("x"))
    assert col(sp, [q["num"], q["den"]], [(0.75,), (-2.5,), (3.0,)], "x double") == [(3, 4), (-5, 2), (3, 1)]
    z = d.complex_(a, b)
    w = d.csqrt(z)
    ((re, im, m),) = col(sp, [w["re"], w["im"], d.magnitude(z)], [(-3, 4)], "a long, b long")
    assert abs(complex(re, im) ** 2 - (-3 + 4j)) < 1e-12 and m == 5
    assert col(sp, [d.maybe(0, lambda x: x + 1, a), d.bind(a, lambda x: F.when(x > 1, x)), d.lift_m(lambda x, y: x * y, a, b)], [(2, 5), (None, 5), (1, None)], "a long, b long") == [(3, 2, 10), (0, None, None), (2, None, None)]
    assert col(sp, list(d.unvec(d.vec(a, b, a), 3)), [(1, 2)], "a long, b long") == [(1, 2, 1)]


def test_signs_of_zero_divisors_and_exponents(sp):
    a, b = F.col("a"), F.col("b")
    got = col(sp, [s.fdiv(a, b).cast("string"), s.recip(b).cast("string")], [(1.0, -0.0), (-1.0, -0.0), (0.0, -0.0), (1.0, 0.0)], "a double, b double")
    assert got == [("-Infinity", "-Infinity"), ("Infinity", "-Infinity"), ("NaN", "-Infinity"), ("Infinity", "Infinity")]
    with pytest.raises(Exception, match="negative exponent"):
        col(sp, [s.power(a, F.lit(-1))], [(2,)], "a long")
    with pytest.raises(Exception, match="nothing"):
        col(sp, [d.from_just(a)], [(None,)], "a long")
    nested = col(sp, [d.nest(a).isNull(), d.join_maybe(d.nest(a))], [(None,), (3,)], "a long")
    assert nested == [(False, None), (False, 3)]
