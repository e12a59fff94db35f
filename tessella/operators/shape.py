"""Shape manipulation. Everything here but replicate and concatenation is a projection and a filter on the index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.arr import Arr, Dim, size_of, unlinear

#: Keeps a dimension in a slice or replicate specification.
All = slice(None)

_1, _2, _3 = -1, -2, -3


def reshape(a: Arr, extent: Sequence[int]) -> Arr:
    """The same elements, row-major, under another extent of the same size."""
    ext = tuple(int(n) for n in extent)
    if size_of(ext) != a.size:
        raise ValueError(f"{a.extent} can't be reshaped to {ext}")
    if ext == a.extent:
        return a
    lin, old = a.linear(), tuple((d.key, d.sign, d.offset) for d in a.dims)
    dims = [Dim(("reshape", old, a.extent, ext, k), c) for k, c in enumerate(unlinear(lin, ext))]
    return a.with_dims(dims, ext)


def flatten(a: Arr) -> Arr:
    return a if a.rank == 1 else reshape(a, (a.size,))


def _spelled(spec: Sequence[Any], rank: int, keeps: bool) -> list[Any]:
    """``...`` in front stands for all leading dimensions; ``keeps`` says that only All takes up a dimension of the array."""
    spec = list(spec)
    if spec and spec[0] is ...:
        rest = spec[1:]
        spec = [All] * (rank - (sum(isinstance(s, slice) for s in rest) if keeps else len(rest))) + rest
    return spec


def replicate(spec: Sequence[Any], a: Arr) -> Arr:
    """``spec`` lists the dimensions of the result: a number of copies, or All for the next dimension of ``a``; ``...`` in front for all leading ones."""
    spec = _spelled(spec, a.rank, True)
    if sum(isinstance(s, slice) for s in spec) != a.rank:
        raise ValueError("one All for each dimension of the array")
    df, ext, order, k = a.df, [], [], 0
    for j, s in enumerate(spec):
        if isinstance(s, slice):
            order.append(f"i{k}")
            ext.append(a.extent[k])
            k += 1
        else:
            new = f"r{j}"  # as many copies as the result asks for; no pairs of rows are compared
            df = df.withColumn(new, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long")))) if s > 0 else df.withColumn(new, F.lit(0).cast("long")).where(F.lit(False))
            order.append(new)
            ext.append(s)
    return Arr.of(df.select(*[F.col(c).alias(f"i{n}") for n, c in enumerate(order)], *a.names), tuple(ext), len(a.values))


def aslice(a: Arr, spec: Sequence[Any]) -> Arr:
    """``spec`` has a position, or All, for each dimension; dimensions with a position go. ``...`` in front stands for all leading ones."""
    spec = _spelled(spec, a.rank, False)
    dims, ext, where = [], [], []
    for d, n, s in zip(a.dims, a.known, spec, strict=True):
        if isinstance(s, slice):
            dims.append(d)
            ext.append(n)
        else:
            if n is not None and not 0 <= s < n:
                raise IndexError(f"{s} outside 0..{n - 1}")
            where.append(d.column == s)
    return a.with_dims(dims, ext, where)


def _on(a: Arr, dim: int, d: Dim, n: int, *where: Any) -> Arr:
    k = dim % a.rank
    return a.with_dims([*a.dims[:k], d, *a.dims[k + 1 :]], (*a.known[:k], n, *a.known[k + 1 :]), where)


def slit_on(a: Arr, dim: int, start: int, n: int) -> Arr:
    """``n`` positions from ``start`` along a dimension; both are clamped to what there is."""
    k = dim % a.rank
    m, d = a.extent[k], a.dims[dim % a.rank]
    lo = min(max(start, 0), m)
    hi = min(lo + max(n, 0), m)
    if (lo, hi) == (0, m):
        return a
    where = ([d.column >= lo] if lo else []) + ([d.column < hi] if hi < m else [])
    return _on(a, dim, d.mapped(1, -lo), hi - lo, *where)


def take_on(a: Arr, dim: int, n: int) -> Arr:
    return slit_on(a, dim, 0, n)


def drop_on(a: Arr, dim: int, n: int) -> Arr:
    return slit_on(a, dim, n, a.extent[dim % a.rank])


def init_on(a: Arr, dim: int) -> Arr:
    return slit_on(a, dim, 0, a.extent[dim % a.rank] - 1)


def tail_on(a: Arr, dim: int) -> Arr:
    return drop_on(a, dim, 1)


def take(a: Arr, n: int) -> Arr:
    return take_on(a, -1, n)


def drop(a: Arr, n: int) -> Arr:
    return drop_on(a, -1, n)


def init(a: Arr) -> Arr:
    return init_on(a, -1)


def tail(a: Arr) -> Arr:
    return tail_on(a, -1)


def slit(a: Arr, start: int, n: int) -> Arr:
    return slit_on(a, -1, start, n)


def concat_on(dim: int, a: Arr, b: Arr) -> Arr:
    """``b`` after ``a`` along a dimension; other extents are intersected."""
    k = dim % a.rank
    for j in range(a.rank):
        if j != k:
            n = min(a.extent[j], b.extent[j])
            a, b = take_on(a, j, n), take_on(b, j, n)
    m = a.extent[k]
    ix = [F.col(c) + (m if j == k else 0) if j == k else F.col(c) for j, c in enumerate(b.ix)]
    df: DataFrame = a.df.unionByName(b.df.select(*[c.alias(n) for c, n in zip(ix, b.ix)], *b.names))
    return Arr.of(df, (*a.extent[:k], m + b.extent[k], *a.extent[k + 1 :]), len(a.values))


def append(a: Arr, *others: Arr) -> Arr:
    """Concatenation along the innermost dimension."""
    return reduce(lambda x, y: concat_on(-1, x, y), others, a)


def reverse_on(a: Arr, dim: int) -> Arr:
    k = dim % a.rank
    return _on(a, dim, a.dims[k].mapped(-1, a.extent[k] - 1), a.extent[k])


def reverse(a: Arr) -> Arr:
    return reverse_on(a, -1)


def transpose_on(a: Arr, x: int, y: int) -> Arr:
    order = [*range(a.rank)]
    i, j = x % a.rank, y % a.rank
    order[i], order[j] = order[j], order[i]
    return a.with_dims([a.dims[k] for k in order], [a.known[k] for k in order])


def transpose(a: Arr) -> Arr:
    return transpose_on(a, -1, -2)


def shape(a: Arr) -> tuple[int, ...]:
    return a.extent


def size(a: Arr) -> int:
    return a.size


def shape_size(extent: Sequence[int]) -> int:
    return size_of(tuple(extent))


def length(a: Arr) -> int:
    return a.extent[0]


def null(a: Arr) -> bool:
    return a.size == 0


def index1(i: Any) -> tuple:
    """A rank-1 index."""
    return (i,)


def index_head(ix: Sequence[Any]) -> Any:
    return ix[-1]


def index_tail(ix: Sequence[Any]) -> tuple:
    return tuple(ix[:-1])


def intersect(x: Sequence[int], y: Sequence[int]) -> tuple[int, ...]:
    return tuple(map(min, x, y))


def union(x: Sequence[int], y: Sequence[int]) -> tuple[int, ...]:
    return tuple(map(max, x, y))
