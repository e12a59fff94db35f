"""Gather, scatter, filters and irregular expansion: joins by index."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.arr import Arr, Dim, as_column, as_tuple, div, unlinear
from ..plans.arr import names as names_of
from ..sources.arrays import fill, generate
from .elementwise import zip_with
from .shape import flatten


class Affine:
    """An index that a backpermute's function may shift and flip; anything else it does is not affine."""

    def __init__(self, dim: int, sign: int = 1, offset: int = 0) -> None:
        self.dim, self.sign, self.offset = dim, sign, offset

    def __add__(self, n: int) -> Affine:
        if not isinstance(n, int):
            raise TypeError
        return Affine(self.dim, self.sign, self.offset + n)

    __radd__ = __add__

    def __sub__(self, n: int) -> Affine:
        return self + -n

    def __neg__(self) -> Affine:
        return Affine(self.dim, -self.sign, -self.offset)

    def __rsub__(self, n: int) -> Affine:
        return -self + n


#: Elements that ``expand`` makes from one row before the row is cut into pieces that go to tasks of their own.
PIECE = 1 << 16


def _read(met: DataFrame, values: Sequence[str], asked: Column | None = None) -> list[Column]:
    """The joined values; where nothing met (and something was ``asked`` for), the index lies outside the array: an error."""
    outside = F.col("has_").isNull() if asked is None else F.col("has_").isNull() & asked
    wrong = F.raise_error(F.lit("index outside the array"))
    return [F.when(outside, wrong.cast(met.schema[v].dataType)).otherwise(F.col(v)).alias(v) for v in values]


def backpermute(extent: Sequence[int], p: Callable[..., Any], a: Arr) -> Arr:
    """out[ix] = a[p(ix)]; an index outside ``a`` is an error. An affine one-to-one ``p`` is inverted into a projection; any other is an equi-join on the index."""
    ext = tuple(int(n) for n in extent)
    try:
        src = as_tuple(p(*[Affine(k) for k in range(len(ext))]))
        one_to_one = all(isinstance(s, Affine) for s in src) and sorted(s.dim for s in src) == [*range(len(ext))]
    except Exception:  # noqa: BLE001 - p wants columns
        one_to_one = False
    if one_to_one and len(src) == a.rank:
        # a's index k is sign * i_dim + offset, so i_dim is sign * (index - offset)
        dims: list[Dim] = [None] * len(ext)  # type: ignore[list-item]
        where = []
        for k, s in enumerate(src):
            reach = sorted((s.offset, s.sign * (ext[s.dim] - 1) + s.offset)) if ext[s.dim] else (0, 0)
            if reach[0] < 0 or reach[1] >= a.extent[k] > 0:
                raise IndexError(f"dimension {k} is read outside 0..{a.extent[k] - 1}")
            d = a.dims[k].mapped(s.sign, -s.sign * s.offset)
            dims[s.dim] = d
            if ext[s.dim] < a.extent[k]:
                where.append(d.column.between(0, ext[s.dim] - 1))
        return a.with_dims(dims, ext, where)
    frame = generate(a.spark, ext, lambda *ix: tuple(as_column(c).cast("long") for c in as_tuple(p(*ix))))
    want = frame.df.select(*frame.ix, *[F.col(n).alias(f"j{k}") for k, n in enumerate(frame.names)])
    have = a.df.select(*[F.col(c).alias(f"j{k}") for k, c in enumerate(a.ix)], *a.names)
    if not a.rank:
        return Arr.of(want.crossJoin(F.broadcast(have)).select(*frame.ix, *a.names), ext, len(a.values))  # one row
    met = want.join(have.withColumn("has_", F.lit(True)), [f"j{k}" for k in range(a.rank)], "left")
    return Arr.of(met.select(*frame.ix, *_read(met, a.names)), ext, len(a.values))


def gather(indices: Arr, source: Arr) -> Arr:
    """The source's elements at the given positions; a position outside it is an error."""
    want = indices.df.select(*indices.ix, F.col("v").cast("long").alias("at_"))
    have = source.df.select(F.col("i0").alias("at_"), *source.names)
    met = want.join(have.withColumn("has_", F.lit(True)), "at_", "left")
    return Arr.of(met.select(*indices.ix, *_read(met, source.names)), indices.known, len(source.values))


def gather_if(indices: Arr, mask: Arr, pred: Callable[[Any], Column], defaults: Arr, source: Arr) -> Arr:
    """Gathers where the mask holds, else takes the default. A position that the mask holds at must lie in the source."""
    outside = F.lit(-1).cast("long")  # a missing position reads nothing, which is an error as well
    want = zip_with(lambda i, m, d: (F.when(pred(m), F.coalesce(i.cast("long"), outside)), *as_tuple(d)), indices, mask, defaults)
    df = want.df.toDF("i0", "at_", *[f"d{k}" for k in range(len(defaults.values))])
    have = source.df.select(F.col("i0").alias("at_"), *source.names)
    met = df.join(have.withColumn("has_", F.lit(True)), "at_", "left")
    asked = F.col("at_").isNotNull()
    got = _read(met, source.names, asked)
    return Arr.of(met.select("i0", *[F.when(asked, g).otherwise(F.col(f"d{k}")).alias(n) for k, (g, n) in enumerate(zip(got, source.names))]), want.known, len(source.values))


def permute(op: Any, defaults: Arr, to: Callable[..., Any], a: Arr) -> Arr:
    """Scatters ``a`` over ``defaults``: elements that ``to`` (index, value) sends to one place are combined, then with the default as f(new, old). A null target drops the element; one outside is an error.

    ``op`` is an associative, commutative operator, or "const": the last element in row-major order wins.
    """
    n, r = len(a.values), defaults.rank
    target = [as_column(c).cast("long") for c in as_tuple(to(a.index, a.value))]
    lin = a.linear()
    rows = Arr(a.base, a.dims, a.known, [*a.values, lin, *target], a.where)
    names = [*a.names, "lin_", *[f"i{k}" for k in range(r)]]
    src = rows.df.select(*[F.col(x).alias(y) for x, y in zip(rows.names, names)]).where(F.col("i0").isNotNull()) if r else rows.df.select(*[F.col(x).alias(y) for x, y in zip(rows.names, names)])
    out_of = F.lit(False)
    for k, m in enumerate(defaults.extent):
        out_of = out_of | (F.col(f"i{k}") < 0) | (F.col(f"i{k}") >= m)
    if r:
        src = src.withColumn("i0", F.when(out_of, F.raise_error(F.lit("target outside the array")).cast("long")).otherwise(F.col("i0")))
    if op == "const":
        got = src.groupBy(*defaults.ix).agg(F.max_by(F.struct(*a.names), "lin_").alias("e_")).select(*defaults.ix, *[F.col(f"e_.{v}").alias(f"new_{v}") for v in a.names])
    else:
        got = blocks.fold(src, defaults.ix, "lin_", a.names, op, a.types, a.size).select(*defaults.ix, *[F.col(v).alias(f"new_{v}") for v in a.names])
    met = defaults.df.join(got.withColumn("has_", F.lit(True)), defaults.ix, "left") if r else defaults.df.crossJoin(got.withColumn("has_", F.lit(True)))
    new, old = [F.col(f"new_{v}") for v in a.names], [F.col(v) for v in a.names]
    both = [x.cast(t) for x, t in zip(new, defaults.types)] if op == "const" else blocks.combiner(op, n, defaults.types)(new, old)
    return Arr.of(met.select(*defaults.ix, *[F.when(F.col("has_"), b).otherwise(o).alias(v) for b, o, v in zip(both, old, a.names)]), defaults.known, n)


def scatter(to: Arr, defaults: Arr, a: Arr) -> Arr:
    """Writes elements at the given positions; the last one to a position wins. The lengths are intersected."""
    both = zip_with(lambda t, v: (t, *as_tuple(v)), to, a)
    return _scatter(both, defaults)


def _scatter(both: Arr, defaults: Arr) -> Arr:
    target, values = both.values[0], both.values[1:]
    src = Arr(both.base, both.dims, both.known, values, both.where)
    return permute("const", defaults, lambda ix, v: target, src)


def scatter_if(to: Arr, mask: Arr, pred: Callable[[Any], Column], defaults: Arr, a: Arr) -> Arr:
    both = zip_with(lambda t, m, v: (F.when(pred(m), t), *as_tuple(v)), to, mask, a)
    return _scatter(both, defaults)


def _compacted(a: Arr, keep: Column) -> tuple[Arr, Arr]:
    """The kept elements as a vector in row-major order, and the count of each innermost row."""
    df = a.with_values((*a.values, keep, a.linear())).df
    vals = a.names
    cols = names_of(len(vals) + 2)
    kept = df.select(*[F.col(c).alias(v) for c, v in zip(cols, vals)], F.col(cols[-2]).alias("keep_"), F.col(cols[-1]).alias("lin_"))
    packed = blocks.dense(kept.where("keep_").drop("keep_"), "lin_", max(a.size, 1), "i0")
    vector = Arr.of(packed.select("i0", *vals), (None,), len(vals))
    outer = a.ix[:-1]
    counted = df.groupBy(*outer).agg(F.count_if(F.col(cols[-2])).cast("long").alias("v"))
    if a.extent[-1] == 0 and outer:
        return vector, fill(a.spark, a.extent[:-1], F.lit(0).cast("long"))
    return vector, Arr.of(counted, a.known[:-1], 1)


def filter(p: Callable[[Any], Column], a: Arr) -> tuple[Arr, Arr]:  # noqa: A001
    return _compacted(a, F.coalesce(p(a.value), F.lit(False)))


def compact(flags: Arr, a: Arr) -> tuple[Arr, Arr]:
    """As ``filter`` with flags of their own."""
    both = zip_with(lambda f, v: (f, *as_tuple(v)), flags, a)
    keep = both.values[0]
    src = Arr(both.base, both.dims, both.known, both.values[1:], both.where)
    return _compacted(src, keep)


def expand(size: Callable[[Any], Column], get: Callable[[Any, Column], Any], a: Arr) -> Arr:
    """Each element x yields get(x, 0) to get(x, size(x) - 1), in order.

    The places come from a prefix sum of the sizes, so nothing is sorted as a whole. An element that yields more than
    PIECE is cut into pieces, which are spread over the tasks; no array holds more than PIECE numbers.
    """
    a = flatten(a) if a.rank > 1 else a
    sz = F.greatest(as_column(size(a.value)).cast("long"), F.lit(0).cast("long"))
    df = a.with_values((*a.values, sz)).df.toDF("i0", *a.names, "n_").withColumn("to_", F.col("n_"))
    run = blocks.scan(df, [], "i0", ["to_"], "sum", ["long"], a.known[0])
    zero = F.lit(0).cast("long")
    small = run.where(F.col("n_").between(1, PIECE)).withColumn("k_", F.explode(F.sequence(zero, F.col("n_") - 1)))
    pieces = run.where(F.col("n_") > PIECE).withColumn("piece_", F.explode(F.sequence(zero, div(F.col("n_") - 1, PIECE))))
    first = F.col("piece_") * PIECE
    inner = F.sequence(first, F.least(first + PIECE, F.col("n_")) - 1)
    each = small.unionByName(pieces.repartition("i0", "piece_").withColumn("k_", F.explode(inner)).drop("piece_"))
    vals = [F.col(v) for v in a.names]
    out = [as_column(x) for x in as_tuple(get(vals[0] if len(vals) == 1 else tuple(vals), F.col("k_")))]
    return Arr.of(each.select((F.col("to_") - F.col("n_") + F.col("k_")).alias("i0"), *[x.alias(n) for x, n in zip(out, names_of(len(out)))]), (None,), len(out))


def at(a: Arr, ix: Sequence[Column], b: Arr, f: Callable[[Any, Any], Any]) -> Arr:
    """``f(value of b, a[ix])`` where ``ix`` are columns of b: array indexing within a scalar expression, as a join. An index outside ``a`` is an error."""
    keys = [f"k{k}_" for k in range(a.rank)]
    left = b.with_values((*b.values, *[c.cast("long") for c in ix])).df.toDF(*b.ix, *b.names, *keys)
    right = a.df.toDF(*keys, *[f"a{k}_" for k in range(len(a.values))])
    if keys:
        met = left.join(right.withColumn("has_", F.lit(True)), keys, "left")
        own = _read(met, [f"a{k}_" for k in range(len(a.values))])
        met = met.select(*b.ix, *b.names, *own)
    else:
        met = left.crossJoin(F.broadcast(right))  # one row
    va, vb = [F.col(f"a{k}_") for k in range(len(a.values))], [F.col(v) for v in b.names]
    out = [as_column(x) for x in as_tuple(f(vb[0] if len(vb) == 1 else tuple(vb), va[0] if len(va) == 1 else tuple(va)))]
    return Arr.of(met.select(*b.ix, *[x.alias(n) for x, n in zip(out, names_of(len(out)))]), b.known, len(out))


def at_linear(a: Arr, k: Column, b: Arr, f: Callable[[Any, Any], Any]) -> Arr:
    return at(a, unlinear(k.cast("long"), a.extent), b, f)


def the(a: Arr, b: Arr, f: Callable[[Any, Any], Any]) -> Arr:
    """``f(value of b, the element of the rank-0 array a)``."""
    return at(a, (), b, f)


def histogram(n: int, bins: Callable[[Any], Column], a: Arr) -> Arr:
    ones = a.with_values(F.lit(1).cast("long"))
    return permute("sum", fill(a.spark, (n,), F.lit(0).cast("long")), lambda ix, v: bins(a.value), ones)


__all__ = [n for n in dir() if n[0] != "_"]
