"""Whole programs over arrays: linear algebra, pricing and sorting."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import elementwise as e
from ..operators import permute as p
from ..operators import reduce as r
from . import blocks
from .arr import Arr, as_tuple, names
from .session import materialise


def dotp(xs: Arr, ys: Arr) -> Arr:
    return r.fold("sum", 0, e.zip_with(lambda x, y: x * y, xs, ys))


def saxpy(alpha: Any, xs: Arr, ys: Arr) -> Arr:
    return e.zip_with(lambda x, y: x * alpha + y, xs, ys)


def sasum(xs: Arr) -> Arr:
    return r.fold("sum", 0, e.amap(F.abs, xs))


def smvm(rows: int, entries: DataFrame, x: Arr) -> Arr:
    """Sparse matrix times vector. ``entries`` has row, col and val, in any order; rows without entries give 0. One equi-join on the column index, one partial aggregate on the row."""
    vec = x.df.select(F.col("i0").alias("col"), F.col("v").alias("x_"))
    got = entries.join(vec, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x_")).alias("s_"))
    frame = x.spark.range(rows).select(F.col("id").alias("i0"))
    return Arr.of(frame.join(got, F.col("i0") == F.col("row"), "left").select("i0", F.coalesce("s_", F.lit(0)).alias("v")), (rows,), 1)


def smvm_segments(seg: Arr, cols: Arr, vals: Arr, x: Arr) -> Arr:
    """The same from row lengths and parallel vectors of columns and values."""
    prod = e.zip_with(lambda a, b: a * b, p.gather(cols, x), vals)
    return r.fold_seg("sum", 0, prod, seg)


def black_scholes(options: Arr, riskfree: float = 0.02, volatility: float = 0.30) -> Arr:
    """(call, put) of options given as (price, strike, years)."""

    def cnd(d: Column) -> Column:
        k = 1.0 / (1.0 + 0.2316419 * F.abs(d))
        poly = k * (0.31938153 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
        tail = 0.39894228040143267794 * F.exp(-0.5 * d * d) * poly
        return F.when(d > 0, 1.0 - tail).otherwise(tail)

    def price(o: Any) -> tuple[Column, Column]:
        s, x, t = o
        root = volatility * F.sqrt(t)
        d1 = (F.ln(s / x) + (riskfree + 0.5 * volatility * volatility) * t) / root
        a, b, disc = cnd(d1), cnd(d1 - root), F.exp(-riskfree * t)
        return s * a - x * disc * b, x * disc * (1.0 - b) - s * (1.0 - a)

    return e.amap(price, options)


def radix_sort_by(key: Callable[[Any], Column], a: Arr, bits: int | None = None, digit: int = 8) -> Arr:
    """Stable ascending sort of a vector by a whole-number key, least significant digit first: every pass ranks elements by (digit, position) and scatters them.

    ``bits`` is how many low bits of the key are sorted by; keys that don't fit are an error. Without it, one aggregate
    finds how many the keys need; negative keys need all 64, the sign inverted. A null key is an error.
    """
    n = a.extent[0]
    keys = a.with_values(key(a.value).cast("long")).df
    least, most, nulls = keys.agg(F.min("v"), F.max("v"), F.count_if(F.col("v").isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} null keys")
    least, most = least or 0, most or 0
    signed = bits is None and least < 0
    if bits is None:
        bits = 64 if signed else most.bit_length()
    elif bits < 64 and (least < 0 or most >> bits):
        raise ValueError(f"keys from {least} to {most} do not fit into {bits} bits")
    for low in range(0, bits, digit):
        k = key(a.value).cast("long")
        d = F.shiftrightunsigned(k.bitwiseXOR(F.lit(-(1 << 63))) if signed else k, low).bitwiseAND(F.lit((1 << digit) - 1).cast("long"))
        df = a.with_values((*a.values, d * F.lit(n).cast("long") + a.dims[0].column)).df
        cols = names(len(a.values) + 1)
        src = df.select(*[F.col(c).alias(v) for c, v in zip(cols, a.names)], F.col(cols[-1]).alias("pos_"))
        a = Arr.of(materialise(blocks.dense(src, "pos_", max(n << digit, 1), "i0").select("i0", *a.names)), (n,), len(a.values))
    return a


def sort_by(a: Arr, *keys: Column, descending: bool = False) -> Arr:
    """A vector sorted by keys over its values (``F.col("v")``, ...), equal ones in their old order. A range exchange sorts; places come from partition counts."""
    df = a.df
    order = [k.desc() if descending else k.asc() for k in keys] + [F.col("i0").asc()]
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id().cast("long"), "in_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    from pyspark.sql import Window as W

    counts = parts.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    return Arr.of(parts.join(before, "part_").select((F.col("b_") + F.col("in_")).alias("i0"), *a.names), a.known, len(a.values))


def max_segment_sum(a: Arr) -> Arr:
    """The largest sum of adjacent elements of each row (0 for none): an associative, non-commutative fold over (best prefix, best suffix, best, total)."""

    def lift(x: Column) -> tuple[Column, ...]:
        pos = F.greatest(x, F.lit(0).cast("long"))
        return pos, pos, pos, x

    def f(x: tuple, y: tuple) -> tuple[Column, ...]:
        (xp, xs, xb, xt), (yp, ys, yb, yt) = x, y
        return F.greatest(xp, xt + yp), F.greatest(ys, yt + xs), F.greatest(xb, yb, xs + yp), xt + yt

    zero = F.lit(0).cast("long")
    best = r.fold(f, (zero,) * 4, e.amap(lift, a))
    return best.with_values(best.values[2])


def sieve(spark: Any, n: int) -> list[int]:
    """Primes up to n by irregular expansion: each number from 2 crosses out its multiples."""
    from ..sources.arrays import fill, generate, to_list

    base = generate(spark, (max(int(n**0.5) - 1, 0),), lambda i: i + 2)
    gone = p.expand(lambda x: F.floor(F.lit(n) / x) - 1, lambda x, k: x * (k + 2), base)
    flags = p.permute("const", fill(spark, (n + 1,), F.lit(True)), lambda ix, v: gone.value, gone.with_values(F.lit(False)))
    kept, _ = p.filter(lambda v: v[1] & (v[0] >= 2), e.imap(lambda ix, v: (ix[0], v), flags))
    return [as_tuple(x)[0] for x in to_list(kept)]
