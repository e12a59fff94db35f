"""Control flow, evaluation and foreign functions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.arr import Arr
from ..plans.session import materialise
from ..sources.arrays import to_list

log = logging.getLogger("tessella")


def compute(a: Any) -> Any:
    """Evaluates an array (or a tuple of them) once, into the shared folder."""
    if isinstance(a, (tuple, list)):
        return tuple(compute(x) for x in a)
    return Arr.of(materialise(a.df), a.known, len(a.values))


def pipe(f: Callable[[Any], Any], g: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """``f``, fully evaluated, then ``g``."""
    return lambda x: g(compute(f(x)))


def truth(c: Any) -> bool:
    """A condition: a Python value, or a rank-0 array, whose one row is read."""
    return bool(to_list(c)[0]) if isinstance(c, Arr) else bool(c)


def acond(c: Any, yes: Any, no: Any) -> Any:
    """One of two arrays; the other isn't evaluated. Either may be given as a function of no arguments."""
    out = yes if truth(c) else no
    return out() if callable(out) else out


def awhile(test: Callable[[Any], Any], step: Callable[[Any], Any], a: Any) -> Any:
    """Steps while the test (a rank-0 array) holds. Each round is cut by a table in the shared folder."""
    while truth(test(a)):
        a = compute(step(a))
    return a


def aiterate(n: int, step: Callable[[Any], Any], a: Any) -> Any:
    for _ in range(n):
        a = compute(step(a))
    return a


def iterate(n: int | Column, f: Callable[[Column], Column], x: Column) -> Column:
    """``f`` n times on a scalar; a count that is a column is a loop within the expression."""
    if isinstance(n, Column):
        rounds = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(rounds, x, lambda acc, _: f(acc))
    for _ in range(n):
        x = f(x)
    return x


def while_(test: Callable[[Column], Column], step: Callable[[Column], Column], x: Column, most: int) -> Column:
    """A scalar loop of at most ``most`` rounds; one that still runs then is an error."""
    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), x, lambda acc, _: F.when(test(acc), step(acc)).otherwise(acc))
    return F.when(test(out), F.raise_error(F.lit(f"still running after {most} rounds"))).otherwise(out)


def case(tag: Column, branches: dict[int, Column], default: Column | None = None) -> Column:
    """A switch on a tag."""
    out: Any = F
    for t, v in branches.items():
        out = out.when(tag == t, v)
    return out.otherwise(default) if default is not None else out


def foreign_acc(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None, fallback: Callable[[Arr], Arr], a: Arr, schema: str | None = None) -> Arr:
    """An Arrow function over the rows (index and values) of an array, or the fallback where there is none."""
    if f is None:
        return fallback(a)
    df = a.df
    return Arr.of(df.mapInArrow(f, schema or df.schema), a.known)


def foreign_exp(f: Callable[..., Any] | None, fallback: Callable[..., Column], *args: Column, dtype: str = "double") -> Column:
    """A vectorised scalar function of Arrow arrays, or the fallback where there is none."""
    return fallback(*args) if f is None else F.arrow_udf(_untyped(f), dtype)(*args)


def _untyped(f: Callable[..., Any]) -> Callable[..., Any]:
    """Without annotations, which Spark would take as the kind of function."""
    return lambda *xs: f(*xs)


def atrace(message: str, a: Arr) -> Arr:
    log.info(message)
    return a


def atrace_array(message: str, shown: Arr, a: Arr) -> Arr:
    log.info("%s %s", message, to_list(shown))
    return a


def atrace_id(message: str, a: Arr) -> Arr:
    return atrace_array(message, a, a)


def atrace_exp(message: str, value: Arr, a: Arr) -> Arr:
    return atrace_array(message, value, a)


def run(a: Arr) -> list[Any]:
    """Evaluates to a list, row-major."""
    return to_list(a)


def run1(f: Callable[[Arr], Arr]) -> Callable[[Arr], list[Any]]:
    return lambda a: to_list(f(a))


def run_n(f: Callable[..., Arr]) -> Callable[..., list[Any]]:
    return lambda *args: to_list(f(*args))


def explain(a: Arr) -> str:
    """The physical plan."""
    df: DataFrame = a.df
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def afst(pair: tuple[Any, Any]) -> Any:
    return pair[0]


def asnd(pair: tuple[Any, Any]) -> Any:
    return pair[1]
