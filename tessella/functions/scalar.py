"""Scalar functions with the semantics of machine arithmetic: wrap-around integers, IEEE division, NaN that equals nothing.

Columns in, columns out; all stay in generated code. Integers wrap where ANSI mode is off (``plans.session.configure``).
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
WIDTH = {"tinyint": 8, "smallint": 16, "int": 32, "long": 64, "bigint": 64, "byte": 8, "short": 16}


def _c(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(x: Column, f: Any) -> Column:
    """``f(x)`` where x is evaluated once, however often ``f`` names it: without this nested definitions grow exponentially."""
    return F.element_at(F.transform(F.array(x), f), 1)


def constant(x: Any) -> Column:
    return F.lit(x)


def undef(dtype: str = "double") -> Column:
    return F.lit(None).cast(dtype)


def coerce(x: Column, dtype: str) -> Column:
    return x.cast(dtype)


def lift(x: Any) -> Any:
    """Host values, and tuples of them, as columns."""
    return tuple(lift(y) for y in x) if isinstance(x, tuple) else _c(x)


def unlift(x: Column, n: int) -> tuple[Column, ...]:
    """The components of a struct column with fields e0, e1, ..."""
    return tuple(x[f"e{k}"] for k in range(n))


def lift_function(f: Any) -> Any:
    """A function of tuples as a function of columns: arguments and results are lifted, of any number."""
    return lambda *xs: lift(f(*[lift(x) for x in xs]))


lift1 = lift2 = lift3 = lift_function


def ilift(f: Any) -> Any:
    """A function of integers as one of rank-1 indices."""
    return lambda *ixs: (f(*[ix[0] for ix in ixs]),)


ilift1 = ilift2 = ilift3 = ilift


# ---------------------------------------------------------------- numbers


def add(a: Any, b: Any) -> Column:
    return _c(a) + _c(b)


def sub(a: Any, b: Any) -> Column:
    return _c(a) - _c(b)


def mul(a: Any, b: Any) -> Column:
    return _c(a) * _c(b)


def negate(a: Column) -> Column:
    return -a


def abs_(a: Column) -> Column:
    return F.abs(a)


def signum(a: Column, dtype: str) -> Column:
    """-1, 0 or 1 in the element's type; zeros and NaN of floats stay as they are."""
    return F.when(a > 0, F.when(F.isnan(a.cast("double")), a).otherwise(F.lit(1).cast(dtype))).when(a < 0, F.lit(-1).cast(dtype)).otherwise(a)


def succ(a: Column) -> Column:
    return a + 1


def pred(a: Column) -> Column:
    return a - 1


def min_bound(dtype: str) -> Column:
    return F.lit(-(1 << (WIDTH[dtype] - 1))).cast(dtype)


def max_bound(dtype: str) -> Column:
    return F.lit((1 << (WIDTH[dtype] - 1)) - 1).cast(dtype)


def pi() -> Column:
    return F.lit(math.pi)


# ---------------------------------------------------------------- whole division


def _checked(b: Any) -> Column:
    return F.when(_c(b) == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(_c(b))


def quot(a: Any, b: Any) -> Column:
    """Truncates to zero."""
    return F.call_function("div", _c(a), _checked(b))


def rem(a: Any, b: Any) -> Column:
    """Sign of the dividend."""
    return _c(a) % _checked(b)


def div(a: Any, b: Any) -> Column:
    """Floors."""
    r = rem(a, b)
    return quot(a, b) - F.when((r != 0) & ((r < 0) != (_c(b) < 0)), 1).otherwise(0)


def mod(a: Any, b: Any) -> Column:
    """Sign of the divisor."""
    r = rem(a, b)
    return F.when((r != 0) & ((r < 0) != (_c(b) < 0)), r + _c(b)).otherwise(r)


def quot_rem(a: Any, b: Any) -> tuple[Column, Column]:
    return quot(a, b), rem(a, b)


def div_mod(a: Any, b: Any) -> tuple[Column, Column]:
    return div(a, b), mod(a, b)


def even(a: Column) -> Column:
    return a % 2 == 0


def odd(a: Column) -> Column:
    return a % 2 != 0


def gcd(a: Any, b: Any) -> Column:
    """Euclid in at most 93 steps, which are enough for 64 bits."""
    start = F.struct(F.abs(_c(a)).cast("long").alias("x"), F.abs(_c(b)).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["x"]


def lcm(a: Any, b: Any) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(quot(a, F.when(g == 0, 1).otherwise(g)) * _c(b)))


def power(a: Any, n: Any) -> Column:
    """a ** n for whole n, by squaring, wrapping like the products it stands for; a negative n is an error."""
    n = F.when(_c(n) < 0, F.raise_error(F.lit("negative exponent")).cast("long")).otherwise(_c(n))
    start = F.struct(F.lit(1).cast("long").alias("r"), _c(a).cast("long").alias("b"), _c(n).cast("long").alias("n"))
    step = lambda s, _: F.struct(F.when(s["n"] % 2 == 1, s["r"] * s["b"]).otherwise(s["r"]).alias("r"), (s["b"] * s["b"]).alias("b"), F.shiftright(s["n"], 1).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step)["r"]


def power_signed(a: Any, n: Any) -> Column:
    """a ** n of a float for whole n of either sign."""
    p = F.pow(_c(a).cast("double"), F.abs(_c(n)))
    return F.when(_c(n) >= 0, p).otherwise(fdiv(1.0, p))


# ---------------------------------------------------------------- floats


def fdiv(a: Any, b: Any) -> Column:
    """IEEE division: x/0 is an infinity, with the signs of x and of the zero; 0/0 is NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) != is_negative_zero(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def recip(a: Any) -> Column:
    return fdiv(1.0, a)


def log(a: Any) -> Column:
    a = _c(a).cast("double")
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.ln(F.when(a > 0, a).otherwise(F.lit(1.0))))


def log_base(b: Any, a: Any) -> Column:
    return fdiv(log(a), log(b))


sin, cos, tan, asin, acos, atan = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan
sinh, cosh, tanh, asinh, acosh, atanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh
exp, sqrt, pow_, atan2, is_nan = F.exp, F.sqrt, F.pow, F.atan2, F.isnan


def _whole(a: Column, dtype: str) -> Column:
    return a.cast("long").cast(dtype)


def truncate(a: Column, dtype: str = "long") -> Column:
    return _whole(a, dtype)


def round_(a: Column, dtype: str = "long") -> Column:
    """Half to even."""
    return _whole(F.rint(a), dtype)


def floor(a: Column, dtype: str = "long") -> Column:
    return _whole(F.floor(a), dtype)


def ceiling(a: Column, dtype: str = "long") -> Column:
    return _whole(F.ceil(a), dtype)


def proper_fraction(a: Column, dtype: str = "long") -> tuple[Column, Column]:
    t = truncate(a, dtype)
    return t, a - t


def fdiv_floor(a: Any, b: Any) -> Column:
    """floor(a / b)."""
    return floor(fdiv(a, b))


def fmod_floor(a: Any, b: Any) -> Column:
    return _c(a) - fdiv_floor(a, b) * _c(b)


def fdiv_mod(a: Any, b: Any) -> tuple[Column, Column]:
    return fdiv_floor(a, b), fmod_floor(a, b)


def is_infinite(a: Column) -> Column:
    return F.abs(a) == F.lit(INF)


def is_denormalized(a: Column) -> Column:
    return (a != 0) & (F.abs(a) < F.lit(2.2250738585072014e-308))


def is_negative_zero(a: Column) -> Column:
    """-0.0 equals 0.0, but not as text."""
    return (a == 0) & (a.cast("string") == "-0.0")


def is_ieee(a: Column) -> Column:
    return F.lit(True)


def float_radix() -> Column:
    return F.lit(2).cast("long")


def float_digits(dtype: str = "double") -> Column:
    return F.lit({"double": 53, "float": 24, "half": 11}[dtype])


def float_range(dtype: str = "double") -> tuple[Column, Column]:
    lo, hi = {"double": (-1021, 1024), "float": (-125, 128), "half": (-13, 16)}[dtype]
    return F.lit(lo), F.lit(hi)


def exponent(a: Column) -> Column:
    """e with |a| = m * 2^e and m in [0.5, 1); 0 for 0."""
    x = F.abs(a.cast("double"))
    ok = F.when((x > 0) & (x < INF), x).otherwise(F.lit(1.0))
    tiny = ok < 1e-290
    y = F.when(tiny, ok * F.lit(2.0**200)).otherwise(ok)
    e = F.floor(F.log2(y)).cast("int") + 1
    half = lambda e: y / F.pow(F.lit(2.0), e - 1) / 2  # noqa: E731 - the power itself would overflow at 1024
    e = F.when(half(e) >= 1, e + 1).when(half(e) < 0.5, e - 1).otherwise(e)
    return F.when((x > 0) & (x < INF), e - F.when(tiny, 200).otherwise(0)).otherwise(F.lit(0))


def scale_float(n: Any, a: Column) -> Column:
    """a * 2^n, in two steps so that no intermediate overflows."""
    n = _c(n).cast("int")
    h = F.floor(n / 2).cast("int")
    return a * F.pow(F.lit(2.0), h) * F.pow(F.lit(2.0), n - h)


def significand(a: Column) -> Column:
    return F.when(a == 0, a).otherwise(scale_float(-exponent(a), a))


def decode_float(a: Column) -> tuple[Column, Column]:
    """Mantissa of 53 bits and exponent."""
    mantissa = let(exponent(a), lambda e: scale_float(F.lit(53) - e, a).cast("long"))
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(mantissa), F.when(a == 0, F.lit(0)).otherwise(exponent(a) - 53)


def encode_float(m: Any, e: Any) -> Column:
    return scale_float(e, _c(m).cast("double"))


def from_integral(a: Column, dtype: str) -> Column:
    return a.cast(dtype)


def to_floating(a: Column, dtype: str = "double") -> Column:
    return a.cast(dtype)


# ---------------------------------------------------------------- comparisons


def _nan(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.isnan(x.cast("double"))
    return out


def eq(a: Any, b: Any) -> Column:
    """Floats: NaN equals nothing. For other types plain == is the same."""
    a, b = _c(a), _c(b)
    return (a == b) & ~_nan(a, b)


def ne(a: Any, b: Any) -> Column:
    return ~eq(a, b)


def lt(a: Any, b: Any) -> Column:
    a, b = _c(a), _c(b)
    return (a < b) & ~_nan(a, b)


def gt(a: Any, b: Any) -> Column:
    return lt(b, a)


def le(a: Any, b: Any) -> Column:
    a, b = _c(a), _c(b)
    return (a <= b) & ~_nan(a, b)


def ge(a: Any, b: Any) -> Column:
    return le(b, a)


def max_(a: Any, b: Any) -> Column:
    return F.when(le(a, b), _c(b)).otherwise(_c(a))


def min_(a: Any, b: Any) -> Column:
    return F.when(le(a, b), _c(a)).otherwise(_c(b))


def compare(a: Any, b: Any) -> Column:
    """0 for less, 1 for equal, 2 for greater."""
    return F.when(eq(a, b), 1).when(le(a, b), 0).otherwise(2)


def land(a: Column, b: Column) -> Column:
    """b isn't evaluated where a is false."""
    return F.when(a, b).otherwise(F.lit(False))


def lor(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).otherwise(b)


def land_strict(a: Column, b: Column) -> Column:
    return a & b


def lor_strict(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def cond(c: Column, yes: Any, no: Any) -> Column:
    return F.when(c, _c(yes)).otherwise(_c(no))


# ---------------------------------------------------------------- bits


def band(a: Any, b: Any) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bor(a: Any, b: Any) -> Column:
    return _c(a).bitwiseOR(_c(b))


def xor(a: Any, b: Any) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def complement(a: Column) -> Column:
    return F.bitwise_not(a)


def _shl(a: Column, n: Column, dtype: str) -> Column:
    return F.call_function("shiftleft", a, n.cast("int")).cast(dtype)


def shift_l(a: Column, n: Any, dtype: str = "long") -> Column:
    """Zero from the width on."""
    n, w = _c(n), WIDTH[dtype]
    return F.when(n >= w, F.lit(0).cast(dtype)).otherwise(_shl(a, n, dtype))


def shift_r(a: Column, n: Any, dtype: str = "long") -> Column:
    """Arithmetic; the sign from the width on."""
    n, w = _c(n), WIDTH[dtype]
    return F.when(n >= w, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast(dtype)).otherwise(F.call_function("shiftright", a, n.cast("int")).cast(dtype))


def unsafe_shift_l(a: Column, n: Any, dtype: str = "long") -> Column:
    return _shl(a, _c(n), dtype)


def unsafe_shift_r(a: Column, n: Any, dtype: str = "long") -> Column:
    return F.call_function("shiftright", a, _c(n).cast("int")).cast(dtype)


def shift(a: Column, n: Any, dtype: str = "long") -> Column:
    n = _c(n)
    return F.when(n >= 0, shift_l(a, F.abs(n), dtype)).otherwise(shift_r(a, F.abs(n), dtype))


def _unsigned(a: Column, dtype: str) -> Column:
    w = WIDTH[dtype]
    return a.cast("long") if w == 64 else a.cast("long").bitwiseAND(F.lit((1 << w) - 1).cast("long"))


def rotate_l(a: Column, n: Any, dtype: str = "long") -> Column:
    w = WIDTH[dtype]
    k, x = F.pmod(_c(n), F.lit(w)).cast("int"), _unsigned(a, dtype)
    turned = F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(w) - k))
    return F.when(k == 0, a).otherwise(turned.cast(dtype))


def rotate_r(a: Column, n: Any, dtype: str = "long") -> Column:
    return rotate_l(a, -_c(n), dtype)


def rotate(a: Column, n: Any, dtype: str = "long") -> Column:
    return rotate_l(a, n, dtype)


def zero_bits(dtype: str = "long") -> Column:
    return F.lit(0).cast(dtype)


def bit(i: Any, dtype: str = "long") -> Column:
    return shift_l(F.lit(1).cast("long"), i, "long").cast(dtype)


def set_bit(a: Column, i: Any, dtype: str = "long") -> Column:
    return bor(a, bit(i, dtype))


def clear_bit(a: Column, i: Any, dtype: str = "long") -> Column:
    return band(a, complement(bit(i, dtype)))


def complement_bit(a: Column, i: Any, dtype: str = "long") -> Column:
    return xor(a, bit(i, dtype))


def test_bit(a: Column, i: Any, dtype: str = "long") -> Column:
    return band(a, bit(i, dtype)) != 0


test_bit.__test__ = False  # not a test


def is_signed(dtype: str) -> Column:
    return F.lit(True)


def finite_bit_size(dtype: str) -> Column:
    return F.lit(WIDTH[dtype])


def pop_count(a: Column, dtype: str = "long") -> Column:
    return F.bit_count(_unsigned(a, dtype))


def count_leading_zeros(a: Column, dtype: str = "long") -> Column:
    return F.lit(WIDTH[dtype]) - F.length(F.ltrim(F.bin(_unsigned(a, dtype)), F.lit("0")))


def count_trailing_zeros(a: Column, dtype: str = "long") -> Column:
    x = _unsigned(a, dtype)
    return F.when(x == 0, F.lit(WIDTH[dtype])).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


# ---------------------------------------------------------------- unsigned words


def word(a: Column, bits: int) -> Column:
    """An unsigned word of up to 32 bits in a long: mask after every operation."""
    return a.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def word64_lt(a: Column, b: Column) -> Column:
    """Unsigned order of 64-bit patterns."""
    flip = F.lit(-(1 << 63)).cast("long")
    return a.bitwiseXOR(flip) < b.bitwiseXOR(flip)
