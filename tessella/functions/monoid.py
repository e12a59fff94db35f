"""Semigroups and monoids: an associative operator, with its neutral element where there is one.

``op`` is what folds and scans take, so ``fold(m.op, m.empty, arr)`` reduces with a monoid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.arr import Arr, as_tuple


@dataclass(frozen=True)
class Monoid:
    append: Callable[[Any, Any], Any]
    empty: Any = None
    op: Any = None  # the built-in operator, where there is one

    def __post_init__(self) -> None:
        if self.op is None:
            object.__setattr__(self, "op", self.append)

    def mconcat(self, *xs: Any) -> Any:
        return reduce(self.append, xs) if self.empty is None else reduce(self.append, xs, self.empty)

    def stimes(self, n: int, x: Any) -> Any:
        """x combined with itself, n times in all; n is at least 1, or 0 for a monoid."""
        return self.mconcat(*[x] * n)


Sum = Monoid(lambda a, b: a + b, 0, "sum")
Product = Monoid(lambda a, b: a * b, 1, "prod")
Min = Monoid(F.least, None, "min")
Max = Monoid(F.greatest, None, "max")
All = Monoid(lambda a, b: a & b, True, "and")
Any_ = Monoid(lambda a, b: a | b, False, "or")
#: Comparison results (0 less, 1 equal, 2 greater): the first that isn't equal.
Ordering = Monoid(lambda a, b: F.when(a == 1, b).otherwise(a), 1)


def maybe(m: Monoid) -> Monoid:
    """Missing values are neutral."""
    return Monoid(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(m.append(a, b)), F.lit(None))


def product_of(*ms: Monoid) -> Monoid:
    """Tuples, component by component (2 to 5 or more)."""
    ops = tuple(m.op for m in ms)
    known = ops if all(isinstance(o, str) and o != "prod" for o in ops) else None
    empty = None if any(m.empty is None for m in ms) else tuple(m.empty for m in ms)
    return Monoid(lambda a, b: tuple(m.append(x, y) for m, x, y in zip(ms, a, b)), empty, known)


def fold_map(m: Monoid, f: Callable[[Any], Column], a: Arr) -> Arr:
    """Maps every element of each innermost row into a monoid and combines the results."""
    from ..operators.elementwise import amap
    from ..operators.reduce import fold, fold1

    mapped = amap(f, a)
    return fold1(m.op, mapped) if m.empty is None else fold(m.op, as_tuple(m.empty), mapped)
