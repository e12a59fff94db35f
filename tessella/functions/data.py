"""Optional and sum types, complex and rational numbers, as columns and structs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import permute
from ..plans.arr import Arr
from .scalar import _c, fdiv, gcd, let, quot

# ---------------------------------------------------------------- Maybe: a nullable column


def just(x: Any) -> Column:
    return _c(x)


def nothing(dtype: str = "long") -> Column:
    return F.lit(None).cast(dtype)


def is_nothing(m: Column) -> Column:
    return m.isNull()


def is_just(m: Column) -> Column:
    return m.isNotNull()


def from_maybe(d: Any, m: Column) -> Column:
    return F.coalesce(m, _c(d))


def from_just(m: Column) -> Column:
    """The present value; nothing is an error."""
    return F.when(m.isNull(), F.raise_error(F.lit("nothing where a value was needed"))).otherwise(m)


def nest(m: Column) -> Column:
    """A present value that is itself optional, so that nothing and just nothing differ: a struct, null for nothing."""
    return F.struct(m.alias("e"))


def join_maybe(m: Column) -> Column:
    """The inner optional value of a nested one."""
    return F.when(m.isNotNull(), m["e"])


def maybe(d: Any, f: Callable[[Column], Any], m: Column) -> Column:
    return F.when(m.isNotNull(), _c(f(m))).otherwise(_c(d))


def fmap(f: Callable[[Column], Any], m: Column) -> Column:
    return F.when(m.isNotNull(), _c(f(m)))


def replace(x: Any, m: Column) -> Column:
    return F.when(m.isNotNull(), _c(x))


def void(m: Column) -> Column:
    return F.when(m.isNotNull(), F.lit(True))


def bind(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(m.isNotNull(), f(m))


def then(m: Column, k: Column) -> Column:
    return F.when(m.isNotNull(), k)


def kleisli(f: Callable[[Column], Column], g: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: bind(f(x), g)


def when(c: Column, m: Column) -> Column:
    return F.when(c, m).otherwise(F.lit(True))


def unless(c: Column, m: Column) -> Column:
    return when(~c, m)


def lift_m(f: Callable[..., Any], *ms: Column) -> Column:
    """A function of 1 to 5 present values; nothing if any is missing."""
    ok = F.lit(True)
    for m in ms:
        ok = ok & m.isNotNull()
    return F.when(ok, _c(f(*ms)))


lift_m2 = lift_m3 = lift_m4 = lift_m5 = lift_m


def justs(a: Arr) -> tuple[Arr, Arr]:
    """The present values, and how many each innermost row has."""
    return permute.filter(lambda v: v.isNotNull(), a)


# ---------------------------------------------------------------- Either: struct(tag, l, r)


def left(x: Column, right_type: str) -> Column:
    return F.struct(F.lit(0).cast("tinyint").alias("tag"), x.alias("l"), F.lit(None).cast(right_type).alias("r"))


def right(x: Column, left_type: str) -> Column:
    return F.struct(F.lit(1).cast("tinyint").alias("tag"), F.lit(None).cast(left_type).alias("l"), x.alias("r"))


def is_left(e: Column) -> Column:
    return e["tag"] == 0


def is_right(e: Column) -> Column:
    return e["tag"] == 1


def from_left(e: Column) -> Column:
    return e["l"]


def from_right(e: Column) -> Column:
    return e["r"]


def either(f: Callable[[Column], Column], g: Callable[[Column], Column], e: Column) -> Column:
    return F.when(is_left(e), f(e["l"])).otherwise(g(e["r"]))


def lefts(a: Arr) -> tuple[Arr, Arr]:
    got, counts = permute.filter(is_left, a)
    return got.with_values(from_left(got.value)), counts


def rights(a: Arr) -> tuple[Arr, Arr]:
    got, counts = permute.filter(is_right, a)
    return got.with_values(from_right(got.value)), counts


# ---------------------------------------------------------------- Complex: struct(re, im)


def complex_(re: Any, im: Any) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conjugate(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def cadd(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def csub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def cmul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cdiv(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_(fdiv(a["re"] * b["re"] + a["im"] * b["im"], n), fdiv(a["im"] * b["re"] - a["re"] * b["im"], n))


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def magnitude_naive(z: Column) -> Column:
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def phase(z: Column) -> Column:
    return F.when((z["re"] == 0) & (z["im"] == 0), F.lit(0.0)).otherwise(F.atan2(z["im"], z["re"]))


def polar(z: Column) -> tuple[Column, Column]:
    return magnitude(z), phase(z)


def mk_polar(r: Any, t: Any) -> Column:
    return complex_(_c(r) * F.cos(_c(t)), _c(r) * F.sin(_c(t)))


def cis(t: Any) -> Column:
    return complex_(F.cos(_c(t)), F.sin(_c(t)))


def cexp(z: Column) -> Column:
    return complex_(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def csqrt(z: Column) -> Column:
    m = magnitude(z)
    u = F.sqrt((m + F.abs(z["re"])) / 2)
    v = F.when(u == 0, F.lit(0.0)).otherwise(F.abs(z["im"]) / F.when(u == 0, F.lit(1.0)).otherwise(u * 2))
    re, im = F.when(z["re"] < 0, v).otherwise(u), F.when(z["re"] < 0, u).otherwise(v)
    return complex_(re, F.when(z["im"] < 0, -im).otherwise(im))


# ---------------------------------------------------------------- Ratio: struct(num, den), den positive; x / 0 is 1 / 0


def reduce(x: Any, y: Any) -> Column:
    x, y = _c(x).cast("long"), _c(y).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def made(s: Column) -> Column:
        x, y, g = s["x"], s["y"], s["g"]
        safe = F.when(g == 0, one).otherwise(g)
        return F.struct(F.when(y == 0, one).otherwise(quot(x, safe)).alias("num"), F.when(y == 0, none).otherwise(quot(y, safe)).alias("den"))

    return let(let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.struct(s["x"], s["y"], gcd(s["x"], s["y"]).alias("g"))), made)


def ratio(x: Any, y: Any) -> Column:
    x, y = _c(x).cast("long"), _c(y).cast("long")
    s = F.when(y < 0, F.lit(-1).cast("long")).when(y > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return reduce(x * s, F.abs(y))


def numerator(r: Column) -> Column:
    return r["num"]


def denominator(r: Column) -> Column:
    return r["den"]


def radd(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rsub(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def rmul(a: Column, b: Column) -> Column:
    return reduce(a["num"] * b["num"], a["den"] * b["den"])


def rdiv(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"], a["den"] * b["num"])


def rlt(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] < b["num"] * a["den"]


def to_rational(x: Column) -> Column:
    """The exact ratio of a double, where it fits 64 bits: mantissa times a power of two."""
    from .scalar import decode_float, shift_l

    def made(s: Column) -> Column:
        m, e = s["m"], s["e"]
        one = F.lit(1).cast("long")
        return reduce(F.when(e >= 0, shift_l(m, e)).otherwise(m), F.when(e >= 0, one).otherwise(shift_l(one, -e)))

    m, e = decode_float(x)
    return let(F.struct(m.alias("m"), e.alias("e")), made)


# ---------------------------------------------------------------- Vec: fixed-length arrays


def vec(*xs: Any) -> Column:
    return F.array(*[_c(x) for x in xs])


def unvec(v: Column, n: int) -> tuple[Column, ...]:
    return tuple(F.element_at(v, k + 1) for k in range(n))
