"""Maps, zips and unzips. Two views of one base with the same index map are zipped by a projection; others by an equi-join on the index."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..plans.arr import Arr, as_column, as_tuple, names


def amap(f: Callable[..., Any], a: Arr) -> Arr:
    return a.with_values(f(a.value))


def imap(f: Callable[..., Any], a: Arr) -> Arr:
    """``f(index, value)``; the index is a tuple of columns."""
    return a.with_values(f(a.index, a.value))


def indexed(a: Arr) -> Arr:
    """Each element with its index, as struct and value."""
    return a.with_values((F.struct(*[c.alias(n) for c, n in zip(a.index, a.ix)]), *a.values))


def _aligned(arrs: tuple[Arr, ...]) -> tuple[Arr, list[Any]]:
    """The arrays over their common extent, on one base: the result so far and what each contributes."""
    first = arrs[0]
    if any(a.rank != first.rank for a in arrs):
        raise ValueError("arrays of different rank")
    extent = tuple(None if None in ns else min(ns) for ns in zip(*[a.known for a in arrs]))
    if all(a.base is first.base and a.dims == first.dims for a in arrs):
        where: list = []
        for a in arrs:
            where += [c for c in a.where if not any(c is w for w in where)]
        return Arr(first.base, first.dims, extent, first.values, where), [a.value for a in arrs]
    frames, cols = [], []
    for k, a in enumerate(arrs):
        own = [f"z{k}_{n}" for n in a.names]
        frames.append(a.df.select(*a.ix, *[F.col(n).alias(o) for n, o in zip(a.names, own)]))
        cols.append([F.col(o) for o in own])
    df = frames[0]
    for g, a in zip(frames[1:], arrs[1:]):
        df = df.join(g, first.ix) if first.rank else df.crossJoin(F.broadcast(g))  # rank 0: one row
    out = Arr.of(df, extent, 0)
    return out, [c[0] if len(c) == 1 else tuple(c) for c in cols]


def zip_with(f: Callable[..., Any], *arrs: Arr) -> Arr:
    """``f`` of 2 to 9 elements at each index of the intersection of the extents."""
    both, values = _aligned(arrs)
    return both.with_values(f(*values))


def izip_with(f: Callable[..., Any], *arrs: Arr) -> Arr:
    both, values = _aligned(arrs)
    return both.with_values(f(both.index, *values))


def azip(*arrs: Arr) -> Arr:
    """Tuples of the elements of 2 to 9 arrays."""
    return zip_with(lambda *xs: tuple(c for x in xs for c in as_tuple(x)), *arrs)


def unzip(a: Arr) -> tuple[Arr, ...]:
    """One array per value; they share their base, so only the columns that are used are read."""
    return tuple(a.with_values(v) for v in a.values)


zip_with3 = zip_with4 = zip_with5 = zip_with6 = zip_with7 = zip_with8 = zip_with9 = zip_with
izip_with3 = izip_with4 = izip_with5 = izip_with6 = izip_with7 = izip_with8 = izip_with9 = izip_with
zip3 = zip4 = zip5 = zip6 = zip7 = zip8 = zip9 = azip
unzip3 = unzip4 = unzip5 = unzip6 = unzip7 = unzip8 = unzip9 = unzip

__all__ = [n for n in dir() if n[0] != "_"]
