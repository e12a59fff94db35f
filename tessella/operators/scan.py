"""Prefix aggregates (scans) of the innermost dimension and of segments. Associative operators only, as for reductions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.arr import Arr, as_column, as_tuple
from ..sources.arrays import fill
from .reduce import offsets, with_segments


def _seed(z: Any, a: Arr) -> list:
    return [as_column(x).cast(t) for x, t in zip(as_tuple(z), a.types)]


def _inclusive(op: Any, a: Arr, right: bool) -> DataFrame:
    return blocks.scan(a.df, a.ix[:-1], a.ix[-1], a.names, op, a.types, a.known[-1], right)


def _applied(op: Any, a: Arr, df: DataFrame, seed: list, left: bool) -> list:
    """The seed combined with the scanned values, on its own side."""
    combine, vals = blocks.combiner(op, len(a.values), a.types), [F.col(v) for v in a.names]
    return combine(seed, vals) if left else combine(vals, seed)


def scanl1(op: Any, a: Arr) -> Arr:
    return Arr.of(_inclusive(op, a, False), a.known, len(a.values))


def scanr1(op: Any, a: Arr) -> Arr:
    return Arr.of(_inclusive(op, a, True), a.known, len(a.values))


def _outer(a: Arr) -> DataFrame:
    """One row for each outer index."""
    return fill(a.spark, a.extent[:-1], 0).df.select(*a.ix[:-1])


def _with_seed(op: Any, z: Any, a: Arr, right: bool) -> Arr:
    """n + 1 results: the seed first (last, from the right)."""
    seed, inner, outer = _seed(z, a), a.ix[-1], a.ix[:-1]
    n = a.extent[-1]
    df = _inclusive(op, a, right)
    vals = _applied(op, a, df, seed, not right)
    at = F.col(inner) + (0 if right else 1)
    rows = df.select(*outer, at.alias(inner), *[v.alias(c) for v, c in zip(vals, a.names)])
    ends = _outer(a).select(*outer, F.lit(n if right else 0).cast("long").alias(inner), *[s.alias(c) for s, c in zip(seed, a.names)])
    return Arr.of(rows.unionByName(ends), (*a.extent[:-1], n + 1), len(a.values))


def scanl(op: Any, z: Any, a: Arr) -> Arr:
    return _with_seed(op, z, a, False)


def scanr(op: Any, z: Any, a: Arr) -> Arr:
    return _with_seed(op, z, a, True)


def _prime(op: Any, z: Any, a: Arr, right: bool) -> tuple[Arr, Arr]:
    """The exclusive scan, and the totals."""
    every = _with_seed(op, z, a, right)
    n, inner, outer = a.extent[-1], a.ix[-1], a.ix[:-1]
    df = every.df
    if right:
        body, total = df.where(F.col(inner) > 0).withColumn(inner, F.col(inner) - 1), df.where(F.col(inner) == 0)
    else:
        body, total = df.where(F.col(inner) < n), df.where(F.col(inner) == n)
    return Arr.of(body, a.extent, len(a.values)), Arr.of(total.select(*outer, *a.names), a.extent[:-1], len(a.values))


def scanl_prime(op: Any, z: Any, a: Arr) -> tuple[Arr, Arr]:
    return _prime(op, z, a, False)


def scanr_prime(op: Any, z: Any, a: Arr) -> tuple[Arr, Arr]:
    return _prime(op, z, a, True)


def prescanl(op: Any, z: Any, a: Arr) -> Arr:
    return scanl_prime(op, z, a)[0]


def prescanr(op: Any, z: Any, a: Arr) -> Arr:
    return scanr_prime(op, z, a)[0]


def postscanl(op: Any, z: Any, a: Arr) -> Arr:
    """f(z, scanl1)."""
    s = scanl1(op, a)
    return s.with_values(_applied(op, a, s.df, _seed(z, a), True))


def postscanr(op: Any, z: Any, a: Arr) -> Arr:
    """f(scanr1, z): the seed is on the right."""
    s = scanr1(op, a)
    return s.with_values(_applied(op, a, s.df, _seed(z, a), False))


# ---------------------------------------------------------------- segmented


def _segmented(op: Any, a: Arr, segs: DataFrame, right: bool) -> DataFrame:
    """Rows with seg, start, place, and scanned values."""
    rows = with_segments(a, segs)
    return blocks.scan(rows, [*a.ix[:-1], "seg"], "place", a.names, op, a.types, a.known[-1], right)


def _back(a: Arr, df: DataFrame) -> Arr:
    """Elements at their old positions."""
    outer, inner = a.ix[:-1], a.ix[-1]
    return Arr.of(df.select(*outer, (F.col("start") + F.col("place")).alias(inner), *a.names), (*a.known[:-1], None if a.rank == 1 else a.known[-1]), len(a.values))


def scanl1_seg(op: Any, a: Arr, seg: Arr) -> Arr:
    return _back(a, _segmented(op, a, offsets(seg), False))


def scanr1_seg(op: Any, a: Arr, seg: Arr) -> Arr:
    return _back(a, _segmented(op, a, offsets(seg), True))


def _seg_with_seed(op: Any, z: Any, a: Arr, seg: Arr, right: bool) -> DataFrame:
    """(outer..., seg, start, end, k, values): k from 0 to the length of the segment, the seed included."""
    segs, outer, seed = offsets(seg), a.ix[:-1], _seed(z, a)
    df = _segmented(op, a, segs, right)
    vals = _applied(op, a, df, seed, not right)
    rows = df.select(*outer, "seg", "start", "end", (F.col("place") + (0 if right else 1)).alias("k"), *[v.alias(c) for v, c in zip(vals, a.names)])
    ends = segs.select("seg", "start", "end", (F.col("end") - F.col("start") if right else F.lit(0).cast("long")).alias("k"), *[s.alias(c) for s, c in zip(seed, a.names)])
    if outer:
        ends = _outer(a).join(ends, F.lit(True))
    return rows.unionByName(ends)


def _grown(a: Arr, df: DataFrame) -> Arr:
    outer, inner = a.ix[:-1], a.ix[-1]
    return Arr.of(df.select(*outer, (F.col("start") + F.col("seg") + F.col("k")).alias(inner), *a.names), (*a.known[:-1], None), len(a.values))


def scanl_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    """Each segment grows by its seed."""
    return _grown(a, _seg_with_seed(op, z, a, seg, False))


def scanr_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    return _grown(a, _seg_with_seed(op, z, a, seg, True))


def _seg_prime(op: Any, z: Any, a: Arr, seg: Arr, right: bool) -> tuple[Arr, Arr]:
    df = _seg_with_seed(op, z, a, seg, right)
    outer, inner = a.ix[:-1], a.ix[-1]
    whole = F.lit(0) if right else F.col("end") - F.col("start")
    body = df.where(F.col("k") != whole).select(*outer, (F.col("start") + F.col("k") - (1 if right else 0)).alias(inner), *a.names)
    total = df.where(F.col("k") == whole).select(*outer, F.col("seg").alias(inner), *a.names)
    return Arr.of(body, (*a.known[:-1], None if a.rank == 1 else a.known[-1]), len(a.values)), Arr.of(total, (*a.known[:-1], seg.known[0]), len(a.values))


def scanl_prime_seg(op: Any, z: Any, a: Arr, seg: Arr) -> tuple[Arr, Arr]:
    return _seg_prime(op, z, a, seg, False)


def scanr_prime_seg(op: Any, z: Any, a: Arr, seg: Arr) -> tuple[Arr, Arr]:
    return _seg_prime(op, z, a, seg, True)


def prescanl_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    return scanl_prime_seg(op, z, a, seg)[0]


def prescanr_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    return scanr_prime_seg(op, z, a, seg)[0]


def postscanl_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    s = scanl1_seg(op, a, seg)
    return s.with_values(_applied(op, a, s.df, _seed(z, a), True))


def postscanr_seg(op: Any, z: Any, a: Arr, seg: Arr) -> Arr:
    """f(z, scanr1): unlike ``postscanr`` the seed is on the left."""
    s = scanr1_seg(op, a, seg)
    return s.with_values(_applied(op, a, s.df, _seed(z, a), True))
