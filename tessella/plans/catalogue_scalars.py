"""Registered queries: scalar functions at ordinary and at extreme arguments, over all orders."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import data as fd
from ..functions import scalar as fs
from ..operators import elementwise as e
from .catalogue import MAT, ORD, Tables, query


def _over(name: str, outputs: list[str], base: str, f: Any) -> None:
    """A query over all orders: ``f`` (index, value) gives as many columns as there are SQL ``outputs`` over ``base``."""
    names = ["v"] if len(outputs) == 1 else [f"v_{k + 1}" for k in range(len(outputs))]
    sql = "SELECT i0, " + ", ".join(f"{o} AS {n}" for o, n in zip(outputs, names)) + f" FROM ({base})"
    query(name, sql)(lambda t: e.imap(lambda ix, v: f(ix[0], v), t.orders))


def _long(x: Any) -> Column:
    return F.lit(x).cast("long")


def _six(*xs: Column) -> tuple[Column, ...]:
    """Six decimals, at which the libraries of both sides agree."""
    return tuple(F.round(x, 6) for x in xs)


SIGNED = f"SELECT i0, v % 1001 - 500 AS a FROM {ORD}"


def _signed(v: Column) -> Column:
    return v % 1001 - 500


_over("signs", ["-a", "abs(a)", "CAST(sign(a) AS BIGINT)", "a + 1", "a - 1", "a % 2 = 0", "a % 2 <> 0"], SIGNED, lambda i, v: (lambda a: (fs.negate(a), fs.abs_(a), fs.signum(a, "long"), fs.succ(a), fs.pred(a), fs.even(a), fs.odd(a)))(_signed(v)))
_over("quot_rem", ["a // 7", "a % 7", "CAST(floor(a / 7) AS BIGINT)", "a - 7 * CAST(floor(a / 7) AS BIGINT)"], SIGNED, lambda i, v: (*fs.quot_rem(_signed(v), _long(7)), *fs.div_mod(_signed(v), _long(7))))
_over("powers", ["CAST(pow(a % 10, i0 % 6) AS BIGINT)", "round(pow(CAST(2 AS DOUBLE), i0 % 9 - 4), 6)", "round(pow(abs(a) + CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE)), 6)", "round(ln(abs(a) + 1) / ln(CAST(3 AS DOUBLE)), 6)"], SIGNED, lambda i, v: (lambda a: (fs.power(a % 10, i % 6), *_six(fs.power_signed(F.lit(2.0), i % 9 - 4), fs.pow_(fs.abs_(a) + F.lit(1.0), F.lit(0.3)), fs.log_base(F.lit(3.0), fs.abs_(a) + F.lit(1.0)))))(_signed(v)))

# ---------------------------------------------------------------- floats

UNIT = f"SELECT i0, (v % 199 - 99) / CAST(100 AS DOUBLE) AS x FROM {ORD}"


def _unit(v: Column) -> Column:
    return (v % 199 - 99) / F.lit(100.0)


_over("trig_inverse", [f"round({f}(x), 6)" for f in ("tan", "asin", "acos", "atanh", "asinh", "sinh", "cosh")] + ["round(acosh(abs(x) + 1), 6)"], UNIT, lambda i, v: (lambda x: _six(*(f(x) for f in (fs.tan, fs.asin, fs.acos, fs.atanh, fs.asinh, fs.sinh, fs.cosh)), fs.acosh(F.abs(x) + 1)))(_unit(v)))

#: A float of each kind, by turns: ordinary, zeros of both signs, infinities, NaN, denormalised.
KINDS = [2.5, 0.0, -0.0, fs.INF, -fs.INF, fs.NAN, 1e-310, -4.0]
KINDS_SQL = "CASE i0 % 8 " + " ".join(f"WHEN {k} THEN CAST('{x}' AS DOUBLE)" for k, x in enumerate(KINDS)) + " END"
SPECIAL = f"SELECT i0, i0 % 8 AS k, {KINDS_SQL} AS x FROM {ORD}"


def _special(i: Column) -> Column:
    out: Any = F
    for k, x in enumerate(KINDS):
        out = out.when(i % 8 == k, F.lit(x))
    return out


def _kind(x: Column) -> Column:
    return F.when(F.isnan(x), "nan").when(x == F.lit(fs.INF), "inf").when(x == F.lit(-fs.INF), "-inf").otherwise("finite")


def _kinds(*names: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


_over("nan_tests", ["k = 5", "k IN (3, 4)", "k = 6", "k = 2", "true"], SPECIAL, lambda i, v: (lambda x: (fs.is_nan(x), fs.is_infinite(x), fs.is_denormalized(x), fs.is_negative_zero(x), fs.is_ieee(x)))(_special(i)))
_over("float_division", [_kinds("finite", "inf", "-inf", "finite", "finite", "nan", "inf", "finite"), _kinds("inf", "nan", "nan", "inf", "-inf", "nan", "inf", "-inf"), _kinds("-inf", "nan", "nan", "-inf", "inf", "nan", "-inf", "inf"), "CASE k WHEN 0 THEN CAST(0.4 AS DOUBLE) WHEN 7 THEN CAST(-0.25 AS DOUBLE) ELSE 0 END"], SPECIAL, lambda i, v: (lambda x: (_kind(fs.recip(x)), _kind(fs.fdiv(x, 0.0)), _kind(fs.fdiv(x, F.lit(-0.0))), F.when(i % 8 == 0, fs.recip(x)).when(i % 8 == 7, fs.fdiv(1.0, x)).otherwise(F.lit(0.0))))(_special(i)))
_over("nan_order", ["k IN (2, 1)", "k <> 1 AND k <> 2", "k IN (4, 7)", "k IN (0, 3, 6)", "k IN (1, 2, 4, 7)", "k IN (0, 1, 2, 3, 6)"], SPECIAL, lambda i, v: (lambda x: (fs.eq(x, 0.0), fs.ne(x, 0.0), fs.lt(x, 0.0), fs.gt(x, 0.0), fs.le(x, 0.0), fs.ge(x, 0.0)))(_special(i)))

WHOLE = f"SELECT i0, v + 1 AS a, CAST(length(ltrim(bin(v + 1), '0')) AS BIGINT) AS w FROM {ORD}"
_over("float_parts", ["w", "a / pow(CAST(2 AS DOUBLE), w)", "CAST(a * pow(CAST(2 AS DOUBLE), 53 - w) AS BIGINT)", "w - 53", "CAST(a * 8 AS DOUBLE)", "a / CAST(4 AS DOUBLE)"], WHOLE, lambda i, v: (lambda x: (fs.exponent(x).cast("long"), fs.significand(x), fs.decode_float(x)[0], fs.decode_float(x)[1].cast("long"), fs.scale_float(3, x), fs.encode_float(v + 1, -2)))((v + 1).cast("double")))
_over("float_format", ["CAST(2 AS BIGINT)", "CAST(53 AS BIGINT)", "CAST(-1021 AS BIGINT)", "CAST(1024 AS BIGINT)", "CAST(24 AS BIGINT)"], ORD, lambda i, v: (fs.float_radix(), *(x.cast("long") for x in (fs.float_digits(), *fs.float_range(), fs.float_digits("float")))))

QUARTERS = f"SELECT i0, (v % 1001 - 500) / CAST(4 AS DOUBLE) AS x FROM {ORD}"


def _quarters(v: Column) -> Column:
    return _signed(v) / F.lit(4.0)


_over("float_modulus", ["CAST(floor(x / 0.75) AS BIGINT)", "x - floor(x / 0.75) * 0.75", "CAST(floor(x / -1.5) AS BIGINT)", "x - floor(x / -1.5) * -1.5", "CAST(trunc(x) AS BIGINT)", "x - trunc(x)"], QUARTERS, lambda i, v: (lambda x: (fs.fdiv_floor(x, F.lit(0.75)), fs.fmod_floor(x, F.lit(0.75)), *fs.fdiv_mod(x, F.lit(-1.5)), *fs.proper_fraction(x)))(_quarters(v)))
_over("to_rational", ["n // gcd(n, 8)", "8 // gcd(n, 8)"], f"SELECT i0, v % 997 + 1 AS n FROM {ORD}", lambda i, v: (lambda q: (fd.numerator(q), fd.denominator(q)))(fd.to_rational((v % 997 + 1) / F.lit(8.0))))

# ---------------------------------------------------------------- comparisons, truth, conversions

_over("logic", ["a = 3", "a <> 3", "a > 3", "a <= 3", "a > 3 AND a < 90", "a < 3 OR a > 90", "a > 3 AND i0 > 5", "a > 3 OR i0 > 5", "NOT (a > 3)", "CASE WHEN a > 3 THEN a ELSE -a END"], SIGNED, lambda i, v: (lambda a: (fs.eq(a, 3), fs.ne(a, 3), fs.gt(a, 3), fs.le(a, 3), fs.land(a > 3, a < 90), fs.lor(a < 3, a > 90), fs.land_strict(a > 3, i > 5), fs.lor_strict(a > 3, i > 5), fs.not_(a > 3), fs.cond(a > 3, a, -a)))(_signed(v)))
_over("conversions", ["CAST(a AS DOUBLE)", "CAST(a AS DOUBLE) / 2", "CAST(a AS SMALLINT)", "(a % 256 + 256) % 256", "CAST(7 AS BIGINT)", "CAST(NULL AS DOUBLE)", "pi()", "CAST(-32768 AS SMALLINT)", "CAST(9223372036854775807 AS BIGINT)"], SIGNED, lambda i, v: (lambda a: (fs.from_integral(a, "double"), fs.to_floating(a) / 2, fs.coerce(a, "smallint"), fs.word(a, 8), fs.constant(7).cast("long"), fs.undef("double"), fs.pi(), fs.min_bound("smallint"), fs.max_bound("long")))(_signed(v)))
_over("lifts", ["a + 1", "a * i0", "a + i0 + 2", "i0 + 1", "i0 * 2 + 1", "i0 * 3 + 3", "a"], SIGNED, lambda i, v: (lambda a: (fs.lift1(lambda x: x + 1)(a), fs.lift2(lambda x, y: x * y)(a, i), fs.lift3(lambda x, y, z: x + y + z)(a, i, 2), fs.ilift1(lambda k: k + 1)((i,))[0], fs.ilift2(lambda k, m: k + m)((i,), (i + 1,))[0], fs.ilift3(lambda k, m, n: k + m + n)((i,), (i + 1,), (i + 2,))[0], fs.unlift(F.struct(fs.lift((a, i))[0].alias("e0"), F.lit(1).alias("e1")), 2)[0]))(_signed(v)))

# ---------------------------------------------------------------- bits

_over("shifts", ["CASE WHEN i0 % 9 >= 4 THEN v << CAST(i0 % 9 - 4 AS INTEGER) ELSE v >> CAST(4 - i0 % 9 AS INTEGER) END", "v << 2", "v >> 2", "CAST(1 AS BIGINT) << CAST(i0 % 40 AS INTEGER)", "CAST(0 AS BIGINT)", "true", "CAST(64 AS BIGINT)", "CAST(0 AS BIGINT)"], ORD, lambda i, v: (fs.shift(v, i % 9 - 4), fs.unsafe_shift_l(v, 2), fs.unsafe_shift_r(v, 2), fs.bit(i % 40), fs.zero_bits(), fs.is_signed("long"), fs.finite_bit_size("long").cast("long"), fs.shift_l(v, 64)))
TURNED = f"SELECT i0, ((a << 5) & 4294967295) | (a >> 27) AS l, (a >> 5) | ((a << 27) & 4294967295) AS r FROM (SELECT i0, v % 2147483648 AS a FROM {ORD})"
_over("rotations", ["CAST(CASE WHEN l > 2147483647 THEN l - 4294967296 ELSE l END AS INTEGER)", "CAST(CASE WHEN r > 2147483647 THEN r - 4294967296 ELSE r END AS INTEGER)", "CAST(CASE WHEN r > 2147483647 THEN r - 4294967296 ELSE r END AS INTEGER)"], TURNED, lambda i, v: (lambda a: (fs.rotate_l(a, 5, "int"), fs.rotate_r(a, 5, "int"), fs.rotate(a, -5, "int")))((v % (1 << 31)).cast("int")))

# ---------------------------------------------------------------- optional values, sums

THIRD = f"SELECT i0, v, CASE WHEN v % 3 = 0 THEN v END AS m, CASE WHEN i0 % 2 = 0 THEN i0 END AS k FROM {ORD}"


def _third(i: Column, v: Column) -> tuple[Column, Column]:
    return F.when(v % 3 == 0, v), F.when(i % 2 == 0, i)


_over("maybe_tests", ["m IS NULL", "m IS NOT NULL", "coalesce(m, 1)", "CASE WHEN m IS NOT NULL THEN m + 1 ELSE 0 END", "m * 2", "CASE WHEN m IS NOT NULL THEN CAST(5 AS BIGINT) END", "CASE WHEN m IS NOT NULL THEN true END", "v", "CAST(NULL AS BIGINT)"], THIRD, lambda i, v: (lambda m: (fd.is_nothing(m), fd.is_just(m), fd.from_just(fd.just(fd.from_maybe(1, m))), fd.maybe(0, lambda x: x + 1, m), fd.fmap(lambda x: x * 2, m), fd.replace(_long(5), m), fd.void(m), fd.just(v), fd.nothing()))(_third(i, v)[0]))
_over("maybe_monad", ["CASE WHEN m % 2 = 0 THEN m // 2 END", "CASE WHEN m IS NOT NULL THEN k END", "CASE WHEN v % 2 = 0 AND (v // 2) % 2 = 0 THEN v // 4 END", "CASE WHEN v % 2 = 0 THEN m IS NOT NULL ELSE true END", "CASE WHEN v % 2 <> 0 THEN m IS NOT NULL ELSE true END", "CASE WHEN m IS NOT NULL AND v % 2 = 0 THEN v END"], THIRD, lambda i, v: _monad(v, *_third(i, v)))
_over("maybe_lifts", ["m + 1", "m + k", "m + k + v", "m + k + v + 1", "m + k + v + 3"], THIRD, lambda i, v: (lambda m, k: (fd.lift_m(lambda a: a + 1, m), fd.lift_m2(lambda a, b: a + b, m, k), fd.lift_m3(lambda a, b, x: a + b + x, m, k, v), fd.lift_m4(lambda a, b, x, y: a + b + x + y, m, k, v, _long(1)), fd.lift_m5(lambda a, b, x, y, z: a + b + x + y + z, m, k, v, _long(1), _long(2))))(*_third(i, v)))


def _monad(v: Column, m: Column, k: Column) -> tuple[Column, ...]:
    half = lambda x: F.when(x % 2 == 0, fs.quot(x, 2))
    inner = fd.join_maybe(F.when(m.isNotNull(), fd.nest(F.when(v % 2 == 0, v))))
    return fd.bind(m, half), fd.then(m, k), fd.kleisli(half, half)(v), fd.when(v % 2 == 0, m.isNotNull()), fd.unless(v % 2 == 0, m.isNotNull()), inner


def _sides(v: Column) -> Column:
    return F.when(v % 2 == 0, fd.left(v, "long")).otherwise(fd.right(-v, "long"))


_over("either_tests", ["v % 2 = 0", "v % 2 <> 0", "CASE WHEN v % 2 = 0 THEN v END", "CASE WHEN v % 2 <> 0 THEN -v END"], ORD, lambda i, v: (lambda x: (fd.is_left(x), fd.is_right(x), fd.from_left(x), fd.from_right(x)))(_sides(v)))


@query("rights", f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, -v AS v FROM {ORD} WHERE v % 2 <> 0")
def _(t: Tables) -> Any:
    return fd.rights(e.amap(_sides, t.orders))[0]


# ---------------------------------------------------------------- complex numbers, vectors

PLANE = f"SELECT i0, CAST(v % 50 - 25 AS DOUBLE) AS a, CAST(i0 % 40 + 1 AS DOUBLE) AS b FROM {ORD}"


def _plane(i: Column, v: Column) -> Column:
    return fd.complex_(v % 50 - 25, i % 40 + 1)


_over("complex_parts", ["a", "b", "-b", "round(sqrt(a * a + b * b), 6)"], PLANE, lambda i, v: (lambda z: (fd.real(z), fd.imag(z), fd.conjugate(z)["im"], F.round(fd.magnitude_naive(z), 6)))(_plane(i, v)))
_over("polar", ["round(sqrt(a * a + b * b), 6)", "round(atan2(b, a), 6)", "round(b * cos(a), 6)", "round(b * sin(a), 6)", "round(cos(a), 6)", "round(sin(a), 6)"], PLANE, lambda i, v: (lambda z: _six(*fd.polar(z), *(fd.mk_polar(z["im"], z["re"])[x] for x in ("re", "im")), *(fd.cis(z["re"])[x] for x in ("re", "im"))))(_plane(i, v)))
_over("vec", ["v", "i0", "v + i0"], ORD, lambda i, v: (lambda x: (*x, x[0] + x[1]))(fd.unvec(fd.vec(v, i), 2)))


@query("element_types", f"SELECT i0, i1, CAST(v % 100 AS TINYINT) AS v_1, CAST(v AS SMALLINT) AS v_2, CAST(v AS INTEGER) AS v_3, CAST(v AS FLOAT) AS v_4, v > 0 AS v_5 FROM {MAT}")
def _(t: Tables) -> Any:
    return e.amap(lambda v: (fs.from_integral(v % 100, "tinyint"), fs.from_integral(v, "smallint"), fs.from_integral(v, "int"), fs.to_floating(v, "float"), v > 0), t.matrix)
