"""Sequences of arrays, chunk by chunk, and their Structured Streaming forms.

``Seq`` is a lazy sequence of arrays on the driver: each chunk is a view (a filter on an index that reaches the scan),
so a sequence is as cheap as its chunks are. The ``*_stream`` functions do the same on unbounded tables, where a
micro-batch is the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import control, elementwise, shape
from ..plans.arr import Arr
from ..sources import arrays as src


class Seq:
    """A sequence of arrays; it can be run again."""

    def __init__(self, make: Callable[[], Iterator[Arr]]) -> None:
        self.make = make

    def __iter__(self) -> Iterator[Arr]:
        return self.make()


def stream_in(arrays: Iterable[Arr]) -> Seq:
    items = list(arrays)
    return Seq(lambda: iter(items))


def to_seq(a: Arr, dim: int, chunk: int = 1) -> Seq:
    """Sub-arrays of ``chunk`` positions along a dimension; of one position the dimension is gone."""
    k = dim % a.rank
    n = a.extent[k]
    if chunk == 1:
        return Seq(lambda: (shape.aslice(a, [i if j == k else shape.All for j in range(a.rank)]) for i in range(n)))
    return Seq(lambda: (shape.slit_on(a, k, i, chunk) for i in range(0, n, chunk)))


def to_seq_inner(a: Arr) -> Seq:
    return to_seq(a, -1)


def to_seq_outer2(a: Arr) -> Seq:
    return to_seq(a, 0)


to_seq_outer3 = to_seq_outer2


def generate_seq(spark: SparkSession, n: int, f: Callable[[Column], Any]) -> Seq:
    return Seq(lambda: (src.unit(spark, f(F.lit(i).cast("long"))) for i in range(n)))


def map_seq(f: Callable[[Arr], Arr], s: Seq) -> Seq:
    return Seq(lambda: (f(a) for a in s))


def zip_with_seq(f: Callable[[Arr, Arr], Arr], s: Seq, t: Seq) -> Seq:
    """As long as the shorter one."""
    return Seq(lambda: (f(a, b) for a, b in zip(s, t)))


def scan_seq(f: Callable[[Any, Any], Any], z: Any, s: Seq) -> Seq:
    """Running combination of scalars: the seed first. Each state is evaluated once."""

    def run() -> Iterator[Arr]:
        acc = None
        for a in s:
            if acc is None:
                acc = control.compute(src.unit(a.spark, z))
                yield acc
            acc = control.compute(elementwise.zip_with(f, acc, a))
            yield acc

    return Seq(run)


def fold_seq(f: Callable[[Any, Any], Any], z: Any, s: Seq) -> Arr | None:
    """The last state of ``scan_seq``; None for an empty sequence, which has no session to make a seed in."""
    out = None
    for a in scan_seq(f, z, s):
        out = a
    return out


def fold_seq_flatten(f: Callable[[Any, list[tuple[int, ...]], Arr], Any], acc: Any, s: Seq, chunk: int = 16) -> Any:
    """Folds runs of ``chunk`` arrays: ``f`` gets the state, the extents and the elements of a run as one vector."""
    held: list[Arr] = []

    def flush(state: Any) -> Any:
        return control.compute(f(state, [a.extent for a in held], src.concat_vectors([shape.flatten(a) if a.rank != 1 else a for a in held])))

    for a in s:
        held.append(a)
        if len(held) == chunk:
            acc, held = flush(acc), []
    return flush(acc) if held else acc


def collect(s: Seq) -> list[Arr]:
    return [control.compute(a) for a in s]


def from_seq_elems(s: Seq) -> Arr:
    """All elements, as one vector."""
    return src.concat_vectors([shape.reshape(a, (a.size,)) if a.rank != 1 else a for a in s])


def from_seq_shapes(s: Seq) -> list[tuple[int, ...]]:
    return [a.extent for a in s]


def from_seq(s: Seq) -> tuple[list[tuple[int, ...]], Arr]:
    return from_seq_shapes(s), from_seq_elems(s)


# ---------------------------------------------------------------- unbounded tables


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive; a micro-batch of files is a chunk."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def map_stream(f: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """A stateless step."""
    return f(df)


def fold_stream(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Running totals, kept in the state store; write them in complete or update mode."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()])


def scan_stream(df: DataFrame, key: str, order: str, value: str, f: Callable[[float, float], float], z: float) -> DataFrame:
    """(key, order, value) with the running combination per key, in the order of arrival and, within a micro-batch, of ``order``."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(order, df.schema[order].dataType), T.StructField(value, T.DoubleType())])

    def step(k: tuple, frames: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        acc = state.get[0] if state.exists else z
        for rows in [pd.concat(list(frames)).sort_values(order)]:
            out = []
            for x in rows[value]:
                acc = f(acc, x)
                out.append(acc)
            yield pd.DataFrame({key: rows[key], order: rows[order], value: out})
        state.update((acc,))

    return df.groupBy(key).applyInPandasWithState(step, schema, "acc double", "append", "NoTimeout")


def collect_stream(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table in memory."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream's rows to Parquet, each once."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
