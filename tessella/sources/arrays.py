"""Sources and sinks of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.arr import Arr, as_column, as_tuple, linear, names, size_of, unlinear


def generate(spark: SparkSession, extent: Sequence[int], f: Callable[..., Any]) -> Arr:
    """``f`` at every index: it gets the index columns and returns a Column, or a tuple of them."""
    ext = tuple(int(n) for n in extent)
    ids = spark.range(size_of(ext))
    frame = ids.select(*[c.alias(f"i{k}") for k, c in enumerate(unlinear(F.col("id"), ext))]) if ext else ids.select()
    out = [as_column(v) for v in as_tuple(f(*[F.col(f"i{k}") for k in range(len(ext))]))]
    return Arr.of(frame.select("*", *[v.alias(n) for v, n in zip(out, names(len(out)))]), ext, len(out))


def fill(spark: SparkSession, extent: Sequence[int], value: Any) -> Arr:
    return generate(spark, extent, lambda *ix: value)


def enum_from_n(spark: SparkSession, extent: Sequence[int], start: Any, dtype: str = "long") -> Arr:
    return enum_from_step_n(spark, extent, start, 1, dtype)


def enum_from_step_n(spark: SparkSession, extent: Sequence[int], start: Any, step: Any, dtype: str = "long") -> Arr:
    """start + position * step, row-major."""
    return generate(spark, extent, lambda *ix: (F.lit(start) + linear(ix, extent) * F.lit(step)).cast(dtype))


def empty_array(spark: SparkSession, rank: int, dtype: str = "double") -> Arr:
    return generate(spark, (0,) * rank if rank else (), lambda *ix: F.lit(None).cast(dtype))


def unit(spark: SparkSession, value: Any) -> Arr:
    """A rank-0 array."""
    return generate(spark, (), lambda: value)


def use(df: DataFrame, index: Sequence[str], values: Sequence[str | Column], extent: Sequence[int | None]) -> Arr:
    """An array from a table with dense index columns. Nothing is read here; filters on the index reach the scan."""
    vals = [F.col(v) if isinstance(v, str) else v for v in values]
    return Arr.of(df.select(*[F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(index)], *[v.alias(n) for v, n in zip(vals, names(len(vals)))]), tuple(extent), len(vals))


def use_packed(df: DataFrame, index: str, values: str, extent: Sequence[int]) -> Arr:
    """A matrix from rows that hold their innermost dimension as an array column."""
    return Arr.of(df.select(F.col(index).cast("long").alias("i0"), F.posexplode(values)).select("i0", F.col("pos").cast("long").alias("i1"), F.col("col").alias("v")), tuple(extent), 1)


def packed(a: Arr) -> DataFrame:
    """Rows i0, ... of the outer dimensions with the innermost as an array ``a``."""
    inner = a.ix[-1]
    value = F.col("v") if len(a.values) == 1 else F.struct(*a.names)
    return a.df.groupBy(*a.ix[:-1]).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(inner).alias("p"), value.alias("e")))), lambda x: x["e"]).alias("a"))


def from_list(spark: SparkSession, extent: Sequence[int], items: Sequence[Any], dtype: str | T.DataType | Sequence[str]) -> Arr:
    """A literal array, row-major; too few items are an error, more are ignored. Tuples give several values."""
    ext = tuple(int(n) for n in extent)
    n = size_of(ext)
    if len(items) < n:
        raise ValueError(f"{len(items)} items for an array of {n}")
    types = list(dtype) if isinstance(dtype, (list, tuple)) else [dtype]
    fields = [T.StructField("lin", T.LongType(), False)]
    fields += [T.StructField(c, T._parse_datatype_string(t) if isinstance(t, str) else t) for c, t in zip(names(len(types)), types)]
    rows = [(k, *(as_tuple(x) if len(types) > 1 else (x,))) for k, x in enumerate(items[:n])]
    df = spark.createDataFrame(rows, T.StructType(fields))
    return Arr.of(df.select(*[c.alias(f"i{k}") for k, c in enumerate(unlinear(F.col("lin"), ext))], *names(len(types))), ext, len(types))


def from_function(spark: SparkSession, extent: Sequence[int], f: Callable[..., Any]) -> Arr:
    return generate(spark, extent, f)


def from_function_m(spark: SparkSession, extent: Sequence[int], f: Callable[..., Any], dtype: str) -> Arr:
    """As ``from_function`` for a Python function of plain integers, run in Arrow batches."""
    ext = tuple(int(n) for n in extent)
    base = generate(spark, ext, lambda *ix: F.lit(0)).df.select(*[f"i{k}" for k in range(len(ext))])
    schema = T.StructType([*base.schema.fields, T.StructField("v", T._parse_datatype_string(dtype))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["v"].dataType)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f(*ix) for ix in zip(*cols)], kind)], names=[*b.schema.names, "v"])

    return Arr.of(base.mapInArrow(run, schema), ext, 1)


def from_string(spark: SparkSession, text: str) -> Arr:
    """The code points of a text."""
    return from_list(spark, (len(text),), [ord(c) for c in text], "int")


def to_list(a: Arr) -> list[Any]:
    """All elements, row-major, on the driver: for results that are known to be small."""
    rows = a.df.orderBy(*a.ix).select(*a.names).collect() if a.rank else a.df.select(*a.names).collect()
    return [r[0] for r in rows] if len(a.values) == 1 else [tuple(r) for r in rows]


def write(a: Arr, path: str, mode: str = "error") -> None:
    a.df.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, extent: Sequence[int | None]) -> Arr:
    return Arr.of(spark.read.parquet(path), tuple(extent))


def concat_vectors(vectors: Sequence[Arr]) -> Arr:
    at, frames = 0, []
    for v in vectors:
        frames.append(v.df.select((F.col("i0") + at).alias("i0"), *v.names))
        at += v.size
    return Arr.of(reduce(DataFrame.unionByName, frames), (at,), len(vectors[0].values))


def index_array(a: Arr, *ix: int) -> Any:
    """The element at an index; the filter on it reaches the scan."""
    if len(ix) != a.rank or any(not 0 <= i < n for i, n in zip(ix, a.extent)):
        raise IndexError(f"{ix} in an array of extent {a.extent}")
    row = a.df.where(reduce(lambda p, q: p & q, [F.col(c) == i for c, i in zip(a.ix, ix)], F.lit(True))).select(*a.names).first()
    return row[0] if len(a.values) == 1 else tuple(row)


def linear_index_array(a: Arr, k: int) -> Any:
    ix = []
    for n in reversed(a.extent):
        ix.insert(0, k % n)
        k //= n
    return index_array(a, *ix)


def array_rank(a: Arr) -> int:
    return a.rank


def array_shape(a: Arr) -> tuple[int, ...]:
    return a.extent


def array_size(a: Arr) -> int:
    return a.size


def allocate_array(spark: SparkSession, extent: Sequence[int], dtype: str = "double") -> Arr:
    """Unspecified contents; here zeros."""
    return fill(spark, extent, F.lit(0).cast(dtype))
