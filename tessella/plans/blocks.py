"""Blocked aggregation: dense order, folds and prefix aggregates that no task does alone.

A dimension is cut into blocks. Within a block rows are ordered by a window, or packed into an array for functions that
Spark has no aggregate for; block totals are combined in the same way, block by block, until one is left. Only
associativity is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arr import as_column, as_tuple, div

#: Rows of a block under a window, and elements of a packed block.
WINDOW_BLOCK, PACKED_BLOCK = 1 << 16, 1 << 8

#: Operators that Spark aggregates: aggregate, and the combination of two partial results.
BUILT_IN: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "and": (F.bool_and, lambda a, b: a & b),
    "or": (F.bool_or, lambda a, b: a | b),
}

Op = Any


def built_in(op: Op, n: int) -> list[str] | None:
    """The built-in operator of each value; None for a Python function."""
    if op == "prod":
        return None
    if isinstance(op, str):
        return [op] * n
    if isinstance(op, (tuple, list)) and all(isinstance(x, str) for x in op):
        return list(op)
    return None


def combiner(op: Op, n: int, types: Sequence) -> Callable[[Sequence[Column], Sequence[Column]], list[Column]]:
    """Two elements (a column per value) to one, cast to the element types."""
    ops = built_in(op, n)
    if ops:
        return lambda a, b: [BUILT_IN[o][1](x, y).cast(t) for o, x, y, t in zip(ops, a, b, types)]
    f = (lambda a, b: a * b) if op == "prod" else op

    def combine(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        out = f(a[0], b[0]) if n == 1 else f(tuple(a), tuple(b))
        return [as_column(x).cast(t) for x, t in zip(as_tuple(out), types)]

    return combine


def _struct(cols: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"e{k}") for k, c in enumerate(cols)])


def _parts(e: Column, n: int) -> list[Column]:
    return [e[f"e{k}"] for k in range(n)]


def fold(df: DataFrame, part: list[str], pos: str, vals: list[str], op: Op, types: Sequence, extent: int | None) -> DataFrame:
    """One row (part..., vals...) for each part that has rows; elements are combined in the order of ``pos`` (a long)."""
    ops = built_in(op, len(vals))
    if ops:
        total = df.groupBy(*part).agg(*[BUILT_IN[o][0](v).cast(t).alias(v) for o, v, t in zip(ops, vals, types)], *([] if part else [F.count("*").alias("n_")]))
        return total if part else total.where("n_ > 0").drop("n_")
    n, combine = len(vals), combiner(op, len(vals), types)
    while True:
        one = extent is not None and extent <= PACKED_BLOCK
        block = F.lit(0).cast("long") if one else div(F.col(pos), PACKED_BLOCK)
        packed = df.groupBy(*part, block.alias("block_")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), _struct([F.col(v) for v in vals]).alias("e")))).alias("a_"))
        first, rest = F.element_at("a_", 1)["e"], F.slice("a_", 2, F.greatest(F.size("a_") - 1, F.lit(0)))
        total = F.aggregate(rest, first, lambda acc, x: _struct(combine(_parts(acc, n), _parts(x["e"], n))))
        df = packed.select(*part, F.col("block_").alias(pos), total.alias("t_")).select(*part, pos, *[F.col(f"t_.e{k}").alias(v) for k, v in enumerate(vals)])
        if one:
            return df.select(*part, *vals)
        if extent is None:
            extent = (df.agg(F.max(pos)).first()[0] or 0) + 1
        else:
            extent = -(-extent // PACKED_BLOCK)
        if extent == 1:
            return df.select(*part, *vals)


def _extend(combine: Callable, n: int, right: bool) -> Callable[[Column, Column], Column]:
    """One step of a packed scan: the next element, combined with the last result, goes to the end of the results. Results are copied at each step, which the size of a block bounds."""

    def extend(acc: Column, x: Column) -> Column:
        last, own = _parts(F.element_at(acc, -1)["e"], n), _parts(x["e"], n)
        e = _struct(combine(own, last) if right else combine(last, own))
        return F.concat(acc, F.array(F.struct(x["p"].alias("p"), x["r"].alias("r"), e.alias("e"))))

    return extend


def scan(df: DataFrame, part: list[str], pos: str, vals: list[str], op: Op, types: Sequence, extent: int | None, right: bool = False) -> DataFrame:
    """``df`` with each value replaced by the inclusive prefix (or suffix) aggregate in its part; other columns stay."""
    n, ops = len(vals), built_in(op, len(vals))
    combine = combiner(op, n, types)
    width = WINDOW_BLOCK if ops else PACKED_BLOCK
    if extent is None:
        extent = (df.agg(F.max(pos)).first()[0] or 0) + 1
    one = extent <= width
    blk = f"{pos}b_"  # blocks of blocks have names of their own
    df = df.withColumn(blk, F.lit(0).cast("long") if one else div(F.col(pos), width))
    keys = [*part, blk]
    rest = [c for c in df.columns if c not in (*keys, pos, *vals)]
    if ops:
        w = W.partitionBy(*keys).orderBy(F.col(pos).desc() if right else F.col(pos)).rowsBetween(W.unboundedPreceding, 0)
        local = df.select(*keys, pos, *rest, *[BUILT_IN[o][0](v).over(w).cast(t).alias(v) for o, v, t in zip(ops, vals, types)])
        totals = df.groupBy(*keys).agg(*[BUILT_IN[o][0](v).cast(t).alias(v) for o, v, t in zip(ops, vals, types)])
    else:
        packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.struct(F.lit(0), *rest).alias("r"), _struct([F.col(v) for v in vals]).alias("e")))).alias("a_"))
        if right:
            packed = packed.withColumn("a_", F.reverse("a_"))
        first, rest_ = F.slice("a_", 1, 1), F.slice("a_", 2, F.greatest(F.size("a_") - 1, F.lit(0)))
        packed = packed.withColumn("a_", F.aggregate(rest_, first, _extend(combine, n, right)))
        end = F.element_at("a_", -1)["e"]
        totals = packed.select(*keys, *[end[f"e{k}"].alias(v) for k, v in enumerate(vals)])
        local = packed.select(*keys, F.explode("a_").alias("x_")).select(*keys, F.col("x_.p").alias(pos), *[F.col(f"x_.r.{c}").alias(c) for c in rest], *[F.col(f"x_.e.e{k}").alias(v) for k, v in enumerate(vals)])
    if one:
        return local.drop(blk)
    # the carry into a block is the inclusive scan of the totals of the block before it (after it)
    blocks = -(-extent // width)
    carried = scan(totals, part, blk, vals, op, types, blocks, right)
    carry = carried.select(*[F.col(c).alias(f"{c}_k") for c in part], (F.col(blk) + (-1 if right else 1)).alias("block_k"), *[F.col(v).alias(f"{v}_k") for v in vals], F.lit(True).alias("has_k"))
    on = F.col(blk) == F.col("block_k")
    for c in part:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    met = local.join(carry, on, "left")
    a, b = [F.col(f"{v}_k") for v in vals], [F.col(v) for v in vals]
    both = combine(b, a) if right else combine(a, b)
    return met.select(*part, pos, *rest, *[F.when(F.col("has_k"), x).otherwise(F.col(v)).alias(v) for x, v in zip(both, vals)])


def dense(df: DataFrame, pos: str, extent: int, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``pos``, distinct longs below ``extent``. Ranks are counts of the key ranges before, and places in the range."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-extent // (1 << 18)))
    width = max(1, -(-extent // ranges))
    df = df.withColumn("range_", div(F.col(pos), width))
    counts = df.groupBy("range_").agg(F.count("*").alias("n_"))
    # there may be as many ranges as rows, so their counts are summed in groups of WINDOW_BLOCK ranges, some of them missing;
    # one task sums the groups: extent / 2^34 rows
    counts = counts.withColumn("group_", div(F.col("range_"), WINDOW_BLOCK))
    past = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("group_").agg(F.sum("n_").alias("n_")).select(F.col("group_").alias("group_k"), past(W.orderBy("group_")).alias("past_"))
    inner = counts.select("range_", "group_", past(W.partitionBy("group_").orderBy("range_")).alias("in_"))
    before = inner.join(groups, F.col("group_") == F.col("group_k")).select(F.col("range_").alias("range_k"), (F.col("in_") + F.col("past_")).alias("before_"))
    place = F.row_number().over(W.partitionBy("range_").orderBy(pos)) - 1
    return df.withColumn("place_", place).join(before, F.col("range_") == F.col("range_k")).withColumn(name, F.col("place_") + F.coalesce("before_", F.lit(0))).drop("range_", "range_k", "place_", "before_")
