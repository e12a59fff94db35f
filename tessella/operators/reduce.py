"""Reductions of the innermost dimension, and segmented reductions.

An operator is one of "sum", "prod", "min", "max", "and", "or" (a tuple of them for tuple elements), or any associative
Python function of columns. Built-in ones become partial aggregates; others fold packed blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.arr import Arr, as_column, as_tuple, linear
from ..sources.arrays import fill
from .elementwise import amap
from .shape import flatten


def _total(a: Arr, op: Any) -> Arr:
    """Row by row, without a seed; rows without elements are missing."""
    outer, inner = a.ix[:-1], a.ix[-1]
    n = a.known[-1]
    return Arr.of(blocks.fold(a.df, outer, inner, a.names, op, a.types, n), a.known[:-1], len(a.values))


def fold(op: Any, z: Any, a: Arr) -> Arr:
    """Each innermost row, from the left, with the seed applied once: f(z, total); an empty row gives z."""
    seed = [as_column(x).cast(t) for x, t in zip(as_tuple(z), a.types)]
    outer = a.known[:-1]
    if outer and a.extent[-1] == 0:
        return fill(a.spark, a.extent[:-1], tuple(seed))
    total, combine = _total(a, op), blocks.combiner(op, len(a.values), a.types)
    if outer:
        return total.with_values(combine(seed, total.values))
    got = a.spark.range(1).select().join(total.df.withColumn("has_", F.lit(True)), F.lit(True), "left")  # one row, also of an empty vector
    both = combine(seed, [F.col(v) for v in a.names])
    missing = F.col("has_").isNull()
    return Arr.of(got.select(*[F.when(missing, s).otherwise(b).alias(v) for s, b, v in zip(seed, both, a.names)]), (), len(a.values))


def fold1(op: Any, a: Arr) -> Arr:
    """As ``fold`` without a seed; an empty row is an error."""
    if a.known[-1] == 0:
        raise ValueError("fold1 of empty rows")
    return _total(a, op)


def fold_all(op: Any, z: Any, a: Arr) -> Arr:
    return fold(op, z, flatten(a) if a.rank > 1 else a)


def fold1_all(op: Any, a: Arr) -> Arr:
    return fold1(op, flatten(a) if a.rank > 1 else a)


def sum(a: Arr) -> Arr:  # noqa: A001
    return fold("sum", tuple(0 for _ in a.values), a)


def product(a: Arr) -> Arr:
    return fold("prod", tuple(1 for _ in a.values), a)


def minimum(a: Arr) -> Arr:
    return fold1("min", a)


def maximum(a: Arr) -> Arr:
    return fold1("max", a)


def all(p: Callable[[Any], Column], a: Arr) -> Arr:  # noqa: A001
    return fold("and", True, amap(p, a))


def any(p: Callable[[Any], Column], a: Arr) -> Arr:  # noqa: A001
    return fold("or", False, amap(p, a))


def and_(a: Arr) -> Arr:
    return fold("and", True, a)


def or_(a: Arr) -> Arr:
    return fold("or", False, a)


def sfoldl(f: Callable[[Column, Column], Any], z: Any, arr: Column) -> Column:
    """Sequential left fold over an array column, within a scalar expression."""
    return F.aggregate(arr, as_column(z), f)


class Fold:
    """Several statistics in one pass: each is an operator over a function of the element; ``done`` combines them. Arithmetic on folds combines their results."""

    def __init__(self, parts: Sequence[tuple[str, Callable[[Any], Column]]], done: Callable[..., Column]) -> None:
        self.parts, self.done = list(parts), done

    @classmethod
    def of(cls, op: str, f: Callable[[Any], Column] = lambda x: x) -> Fold:
        return cls([(op, f)], lambda x: x)

    def map(self, f: Callable[[Column], Column]) -> Fold:
        return Fold(self.parts, lambda *xs: f(self.done(*xs)))

    def _with(self, other: Any, f: Callable[[Column, Column], Column]) -> Fold:
        o = other if isinstance(other, Fold) else Fold([], lambda: as_column(other))
        k = len(self.parts)
        return Fold([*self.parts, *o.parts], lambda *xs: f(self.done(*xs[:k]), o.done(*xs[k:])))

    def __add__(self, o: Any) -> Fold:
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o: Any) -> Fold:
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o: Any) -> Fold:
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o: Any) -> Fold:
        return self._with(o, lambda a, b: a / b)


def run_fold(g: Fold, a: Arr) -> Arr:
    """Every statistic of ``g`` in one aggregation of each innermost row."""
    many = a.with_values(tuple(f(a.value) for _, f in g.parts))
    total = _total(many, tuple(op for op, _ in g.parts) if len(g.parts) > 1 else g.parts[0][0])
    return total.with_values(g.done(*total.values))


# ---------------------------------------------------------------- segments


def offsets(seg: Arr) -> DataFrame:
    """(seg, start, end) from a vector of lengths: a prefix sum."""
    d = seg.df.select("i0", F.col("v").cast("long").alias("v"))
    s = blocks.scan(d.withColumn("len_", F.col("v")), [], "i0", ["v"], "sum", ["long"], seg.known[0])
    return s.select(F.col("i0").alias("seg"), (F.col("v") - F.col("len_")).alias("start"), F.col("v").alias("end"))


def head_flags(seg: Arr, n: int) -> Arr:
    """A vector of n flags: how many segments begin at each position (over 1 where empty ones do)."""
    starts = offsets(seg).where(F.col("start") < n).groupBy(F.col("start").alias("i0")).agg(F.count("*").alias("v"))
    frame = seg.spark.range(n).select(F.col("id").alias("i0"))
    return Arr.of(frame.join(starts, "i0", "left").select("i0", F.coalesce("v", F.lit(0).cast("long")).alias("v")), (n,), 1)


def tail_flags(seg: Arr, n: int) -> Arr:
    """How many segments end at each position."""
    ends = offsets(seg).where((F.col("end") > 0) & (F.col("end") <= n)).groupBy((F.col("end") - 1).alias("i0")).agg(F.count("*").alias("v"))
    frame = seg.spark.range(n).select(F.col("id").alias("i0"))
    return Arr.of(frame.join(ends, "i0", "left").select("i0", F.coalesce("v", F.lit(0).cast("long")).alias("v")), (n,), 1)


def from_offsets(off: Arr) -> DataFrame:
    """(seg, start, end) from n + 1 offsets."""
    d = off.df.select(F.col("i0"), F.col("v").cast("long").alias("v"))
    ends = d.select((F.col("i0") - 1).alias("seg"), F.col("v").alias("end"))
    out = d.select(F.col("i0").alias("seg"), F.col("v").alias("start")).join(ends, "seg")
    return out.withColumn("end", F.when(F.col("end") < F.col("start"), F.raise_error(F.lit("segment ends before it starts"))).otherwise(F.col("end")))


def with_segments(a: Arr, segs: DataFrame) -> DataFrame:
    """The rows of ``a`` with their segment and the place in it (seg, start, place); rows beyond the last segment go.

    The segment at a position is the last that starts there or before: a running maximum over positions and starts
    together, in blocks, so no range join and no skew.
    """
    inner, outer = a.ix[-1], a.ix[:-1]
    n = a.known[-1]
    full = segs.where(F.col("end") > F.col("start"))
    # positions are doubled: a start comes just before the element at its position
    width = 2 * n if n is not None else None
    marks = full.select((2 * F.col("start")).alias("p_"), F.struct("seg", "start", "end").alias("s_"))
    if outer:  # segments are those of every row
        rows = a.df.select(*outer).distinct()
        marks = rows.join(marks, F.lit(True))
    els = a.df.select(*outer, (2 * F.col(inner) + 1).alias("p_"), F.lit(None).cast(marks.schema["s_"].dataType).alias("s_"), *a.names)
    both = els.unionByName(marks, allowMissingColumns=True).withColumn("is_", F.col("p_") % 2 == 1)
    run = blocks.scan(both, outer, "p_", ["s_"], "max", [marks.schema["s_"].dataType], width + 1 if width is not None else None)
    at = F.floor(F.col("p_") / 2).cast("long")
    out = run.where("is_").select(*outer, at.alias(inner), *a.names, "s_.seg", "s_.start", "s_.end")
    return out.where(F.col(inner) < F.col("end")).withColumn("place", F.col(inner) - F.col("start"))


def _fold_seg(op: Any, z: Any, a: Arr, segs: DataFrame, n_seg: int | None) -> Arr:
    inner, outer = a.ix[-1], a.ix[:-1]
    rows = with_segments(a, segs)
    got = blocks.fold(rows, [*outer, "seg"], "place", a.names, op, a.types, a.known[-1])
    got = got.withColumnRenamed("seg", inner)
    extent = (*a.known[:-1], n_seg)
    if z is None:
        return Arr.of(got, extent, len(a.values))
    seed = [as_column(x).cast(t) for x, t in zip(as_tuple(z), a.types)]
    combine = blocks.combiner(op, len(a.values), a.types)
    every = segs.select(F.col("seg").alias(inner))
    if outer:
        frame = fill(a.spark, a.extent[:-1], 0).df.select(*outer)
        every = frame.join(every, F.lit(True))
    met = every.join(got.withColumn("has_", F.lit(True)), [*outer, inner], "left")
    both = combine(seed, [F.col(v) for v in a.names])
    out = met.select(*outer, inner, *[F.when(F.col("has_"), b).otherwise(s).alias(v) for b, s, v in zip(both, seed, a.names)])
    return Arr.of(out, extent, len(a.values))


def fold_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    """Reduces the segments, given by lengths, of every innermost row; an empty segment gives the seed."""
    return _fold_seg(op, z, a, offsets(seg), seg.known[0])


def fold1_seg(op: Any, a: Arr, seg: Arr) -> Arr:
    """Without a seed; an empty segment is an error."""
    segs = offsets(seg)
    segs = segs.withColumn("end", F.when(F.col("end") <= F.col("start"), F.raise_error(F.lit("empty segment"))).otherwise(F.col("end")))
    return _fold_seg(op, None, a, segs, seg.known[0])


def fold_seg_offsets(op: Any, z: Any, a: Arr, off: Arr) -> Arr:
    """As ``fold_seg`` for n + 1 offsets."""
    n = off.known[0]
    return _fold_seg(op, z, a, from_offsets(off), None if n is None else n - 1)


def fold1_seg_offsets(op: Any, a: Arr, off: Arr) -> Arr:
    n = off.known[0]
    segs = from_offsets(off).withColumn("end", F.when(F.col("end") <= F.col("start"), F.raise_error(F.lit("empty segment"))).otherwise(F.col("end")))
    return _fold_seg(op, None, a, segs, None if n is None else n - 1)


def position(a: Arr) -> Column:
    return linear(a.index, a.extent)
