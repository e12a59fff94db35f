"""Arrays as DataFrames.

An ``Arr`` is a view of a base DataFrame: index columns, value columns and row conditions, all ``Column`` expressions
over the base, plus an extent that the rows can't tell (an array of extent (4, 0) has none). Index maps that are
affine in one base index each (reverse, transpose, shift, slice) stay expressions, so they cost a projection and not a
join; and two views of one base with the same index map are zipped without a join. Catalyst sees one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Extent = tuple[int | None, ...]


@dataclass(frozen=True)
class Dim:
    """One index: sign * inner + offset, where inner is an expression over the base that ``key`` names."""

    key: Any
    inner: Column = field(compare=False)
    sign: int = 1
    offset: int = 0

    @property
    def column(self) -> Column:
        c = self.inner if self.sign == 1 else -self.inner
        return c + F.lit(self.offset).cast("long") if self.offset else c

    def mapped(self, sign: int, offset: int) -> Dim:
        return Dim(self.key, self.inner, sign * self.sign, sign * self.offset + offset)


class Base:
    """A DataFrame that views share; its identity says that rows coincide."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df


def names(n: int) -> list[str]:
    return ["v"] if n == 1 else [f"v_{k + 1}" for k in range(n)]


def as_tuple(x: Any) -> tuple:
    return tuple(x) if isinstance(x, (tuple, list)) else (x,)


def as_column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def size_of(extent: Extent) -> int:
    return reduce(lambda a, b: a * b, extent, 1)


class Arr:
    """A dense array. ``extent`` has one entry per dimension, outermost first; None is only found by counting (after filter or expand)."""

    def __init__(self, base: Base, dims: Sequence[Dim], extent: Extent, values: Sequence[Column], where: Sequence[Column] = ()) -> None:
        self.base, self.dims, self._extent, self.values, self.where = base, tuple(dims), tuple(extent), tuple(values), tuple(where)

    # ------------------------------------------------------------ making

    @classmethod
    def of(cls, df: DataFrame, extent: Extent, values: int | None = None) -> Arr:
        """From a frame with columns i0, i1, ... and v, or v_1, v_2, ..."""
        n = values if values is not None else sum(c == "v" or c.startswith("v_") for c in df.columns)
        dims = [Dim(("base", k), F.col(f"i{k}")) for k in range(len(extent))]
        return cls(Base(df), dims, extent, [F.col(c) for c in names(n)])

    # ------------------------------------------------------------ asking

    @property
    def spark(self) -> SparkSession:
        return self.base.df.sparkSession

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def names(self) -> list[str]:
        return names(len(self.values))

    @property
    def ix(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def extent(self) -> tuple[int, ...]:
        """The extent; one that depends on the data is counted once."""
        if None in self._extent:
            assert self.rank == 1, "only a vector's length depends on its data"
            self._extent = (self.df.count(),)
        return self._extent  # type: ignore[return-value]

    @property
    def known(self) -> Extent:
        return self._extent

    @property
    def size(self) -> int:
        return size_of(self.extent)

    @property
    def df(self) -> DataFrame:
        """Columns i0, ... and v, or v_1, ..."""
        rows = reduce(lambda d, c: d.where(c), self.where, self.base.df)
        return rows.select(*[d.column.alias(n) for d, n in zip(self.dims, self.ix)], *[v.alias(n) for v, n in zip(self.values, self.names)])

    @property
    def types(self) -> list[T.DataType]:
        return [self.df.schema[n].dataType for n in self.names]

    @property
    def index(self) -> tuple[Column, ...]:
        return tuple(d.column for d in self.dims)

    @property
    def value(self) -> Any:
        """What element functions get: one Column, or a tuple of them."""
        return self.values[0] if len(self.values) == 1 else self.values

    # ------------------------------------------------------------ deriving

    def with_values(self, values: Any) -> Arr:
        return Arr(self.base, self.dims, self._extent, [as_column(v) for v in as_tuple(values)], self.where)

    def with_dims(self, dims: Sequence[Dim], extent: Extent, where: Sequence[Column] = ()) -> Arr:
        return Arr(self.base, dims, extent, self.values, self.where + tuple(where))

    def rebased(self) -> Arr:
        """The same array on a base of its own: columns i0, ... and v, ..."""
        return Arr.of(self.df, self._extent, len(self.values))

    def linear(self) -> Column:
        """Row-major position."""
        return linear(self.index, self.extent)

    def __repr__(self) -> str:
        return f"Arr(extent={self._extent}, values={len(self.values)})"


def linear(index: Sequence[Column], extent: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, (i, n) in enumerate(zip(index, extent)):
        out = i if k == 0 else out * F.lit(n).cast("long") + i
    return out


def div(a: Column, n: int) -> Column:
    """Whole division of a non-negative long, exact at any size."""
    return a if n == 1 else F.call_function("div", a, F.lit(n).cast("long"))


def unlinear(lin: Column, extent: Sequence[int]) -> list[Column]:
    """Index columns of a row-major position."""
    out: list[Column] = []
    for n in reversed(extent[1:]):
        out.insert(0, F.pmod(lin, F.lit(max(n, 1)).cast("long")))
        lin = div(lin, max(n, 1))
    return [lin, *out] if extent else []


def element_function(f: Callable[..., Any]) -> Callable[..., tuple[Column, ...]]:
    return lambda *args: tuple(as_column(x) for x in as_tuple(f(*args)))
