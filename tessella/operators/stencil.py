"""Stencils: functions of each element's neighbourhood, with a rule for what lies outside.

The array is extended by the radius on every side: clamp, mirror and wrap copy a few border rows, ``function`` makes the
cells outside. On the extended array the innermost neighbours are lag and lead within blocks (rows near a block's edge go to
both blocks), and outer neighbours are equi-joins, one for each outer offset.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.arr import Arr, as_column, as_tuple, div, names
from ..sources.arrays import generate
from .elementwise import zip_with

BLOCK = 1 << 16


@dataclass(frozen=True)
class Boundary:
    kind: str
    f: Callable[..., Any] | None = None


clamp, mirror, wrap = Boundary("clamp"), Boundary("mirror"), Boundary("wrap")


def function(f: Callable[..., Any]) -> Boundary:
    """``f`` of the index outside (one column per dimension)."""
    return Boundary("function", f)


def constant(value: Any) -> Boundary:
    return Boundary("function", lambda *ix: value)


def box(*radii: int) -> list[tuple[int, ...]]:
    """All offsets up to the radii, row-major: box(1) is a 3-point stencil, box(1, 1) a 3x3 one."""
    return list(product(*[range(-r, r + 1) for r in radii]))


def _copies(i: Column, n: int, r: int, kind: str) -> Column:
    """The extended positions at which position i stands."""
    out = [i]
    for e in [*range(-r, 0), *range(n, n + r)]:
        if kind == "clamp":
            j = min(max(e, 0), n - 1)
        elif kind == "mirror":
            j = -e if e < 0 else n - (e - n + 2)
        else:
            j = e + n if e < 0 else e - n
        if not 0 <= j < n:
            raise ValueError(f"a {kind} boundary of radius {r} is wider than the array of {n}")
        out.append(F.when(i == j, F.lit(e).cast("long")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _extended(a: Arr, radii: Sequence[int], b: Boundary) -> DataFrame:
    df = a.df
    if b.kind != "function":
        for k, r in enumerate(radii):
            if r:
                df = df.withColumn(f"i{k}", F.explode(_copies(F.col(f"i{k}"), a.extent[k], r, b.kind)))
        return df
    wide = [n + 2 * r for n, r in zip(a.extent, radii)]
    # border cells only: for each dimension the slabs before and after, over the interior of earlier dimensions
    frames = [df]
    for k, r in enumerate(radii):
        if r:
            ext = [a.extent[j] if j < k else wide[j] if j > k else 2 * r for j in range(a.rank)]
            slab = generate(a.spark, ext, lambda *ix: F.lit(0)).df
            at = [F.col(f"i{j}") if j < k else F.col(f"i{j}") - radii[j] if j > k else F.when(F.col(f"i{j}") < r, F.col(f"i{j}") - r).otherwise(F.col(f"i{j}") - r + a.extent[k]) for j in range(a.rank)]
            slab = slab.select(*[c.alias(f"i{j}") for j, c in enumerate(at)])
            vals = [as_column(v).cast(t) for v, t in zip(as_tuple(b.f(*[F.col(f"i{j}") for j in range(a.rank)])), a.types)]
            frames.append(slab.select("*", *[v.alias(n) for v, n in zip(vals, a.names)]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _neighbours(a: Arr, offsets: Sequence[tuple[int, ...]], b: Boundary) -> DataFrame:
    """a's index, and a column n{k} (a struct where elements are tuples) for each offset."""
    radii = [max((abs(o[k]) for o in offsets), default=0) for k in range(a.rank)]
    element = F.col("v") if len(a.values) == 1 else F.struct(*a.names)
    ext = _extended(a, radii, b).select(*a.ix, element.alias("e_"))
    inner, r, n = a.ix[-1], radii[-1], a.extent[-1]
    shifts = sorted({o[-1] for o in offsets})
    if r == 0:
        rows = ext.select(*a.ix, F.col("e_").alias("s0_"))
        shift_name = {0: "s0_"}
    else:
        # position in the extended row, from 0; a row near a block's edge goes to both blocks
        at = F.col(inner) + r
        block = div(at, BLOCK)
        if n + 2 * r <= BLOCK:
            ext = ext.withColumn("block_", F.lit(0).cast("long"))
        else:
            ext = ext.withColumn("block_", F.explode(F.array_distinct(F.array(block, div(F.greatest(at - r, F.lit(0).cast("long")), BLOCK), div(at + r, BLOCK)))))
        w = W.partitionBy(*a.ix[:-1], "block_").orderBy(inner)
        shift_name = {s: f"s{k}_" for k, s in enumerate(shifts)}
        cols = [(F.col("e_") if s == 0 else F.lead("e_", s).over(w) if s > 0 else F.lag("e_", -s).over(w)).alias(shift_name[s]) for s in shifts]
        rows = ext.select(*a.ix, "block_", *cols)
        rows = rows.where((F.col("block_") == (div(F.col(inner) + r, BLOCK) if n + 2 * r > BLOCK else F.lit(0))) & F.col(inner).between(0, n - 1)).drop("block_")
    outer_offsets = sorted({o[:-1] for o in offsets})
    out = None
    for j, o in enumerate(outer_offsets):
        need = [k for k, x in enumerate(offsets) if x[:-1] == o]
        part = rows.select(*[(F.col(c) - d).alias(c) for c, d in zip(a.ix[:-1], o)], inner, *[F.col(shift_name[offsets[k][-1]]).alias(f"n{k}") for k in need])
        for c, m, rad in zip(a.ix[:-1], a.extent[:-1], radii[:-1]):
            if rad:
                part = part.where(F.col(c).between(0, m - 1))
        out = part if out is None else out.join(part, a.ix)
    return out


def _elements(a: Arr, offsets: Sequence[tuple[int, ...]]) -> list[Any]:
    cols = [F.col(f"n{k}") for k in range(len(offsets))]
    return cols if len(a.values) == 1 else [tuple(c[n] for n in a.names) for c in cols]


def stencil(f: Callable[..., Any], offsets: Sequence[tuple[int, ...]], b: Boundary, a: Arr) -> Arr:
    """``f`` of the elements at the offsets (in their order) from each position."""
    df = _neighbours(a, offsets, b)
    out = [as_column(v) for v in as_tuple(f(*_elements(a, offsets)))]
    return Arr.of(df.select(*a.ix, *[v.alias(n) for v, n in zip(out, names(len(out)))]), a.known, len(out))


def stencil2(f: Callable[..., Any], offs1: Sequence[tuple[int, ...]], b1: Boundary, x: Arr, offs2: Sequence[tuple[int, ...]], b2: Boundary, y: Arr) -> Arr:
    """``f`` of two lists: the neighbourhoods in both arrays, over the intersection of the extents."""
    frames = []
    for a, offs, b in ((x, offs1, b1), (y, offs2, b2)):
        df = _neighbours(a, offs, b)
        frames.append(Arr.of(df.select(*a.ix, *[F.col(f"n{k}").alias(n) for k, n in enumerate(names(len(offs)))]), a.known, len(offs)))
    return zip_with(lambda p, q: f(list(as_tuple(p)), list(as_tuple(q))), *frames)
