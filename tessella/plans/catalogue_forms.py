"""Registered queries: zips of every width, host access, flags, monoids, evaluation forms and sequences."""

from __future__ import annotations

from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import monoid as fm
from ..operators import control as c
from ..operators import elementwise as e
from ..operators import reduce as r
from ..operators import shape as s
from ..sources import arrays as src
from ..streaming import seq
from .catalogue import EV, INSEG, MAT, NO, NV, ORD, PART, SEG, Tables, query

All = s.All

# ---------------------------------------------------------------- zips of every width: orders, events and parts in turn

NAMES = ("a", "b", "d")
ZIPPED = f"{ORD} a JOIN {EV} b USING (i0) JOIN {PART} d USING (i0)"


def _arrays(t: Tables, n: int) -> list[Any]:
    three = [t.orders, t.events, t.parts]
    return [three[k % 3] for k in range(n)]


def _weighted(*xs: Column) -> Column:
    total = xs[0]
    for k, x in enumerate(xs[1:], 2):
        total = total + x * k
    return total


def _weights(n: int) -> str:
    return " + ".join(f"{NAMES[k % 3]}.v * {k + 1}" for k in range(n))


def _zip_with(n: int, t: Tables) -> Any:
    return getattr(e, f"zip_with{n}")(_weighted, *_arrays(t, n))


def _izip_with(n: int, t: Tables) -> Any:
    return getattr(e, f"izip_with{n}")(lambda ix, *xs: _weighted(*xs) + ix[0], *_arrays(t, n))


def _zip(n: int, t: Tables) -> Any:
    return getattr(e, f"zip{n}")(*_arrays(t, n))


def _unzip(n: int, t: Tables) -> Any:
    parts = getattr(e, f"unzip{n}")(_zip(n, t))
    return e.zip_with(lambda x, y: x - y, parts[-1], parts[1])


for _n in range(3, 10):
    if 4 <= _n <= 8:
        query(f"zip_with{_n}", f"SELECT i0, {_weights(_n)} AS v FROM {ZIPPED}")(partial(_zip_with, _n))
    query(f"izip_with{_n}", f"SELECT i0, {_weights(_n)} + i0 AS v FROM {ZIPPED}")(partial(_izip_with, _n))
    if _n >= 4:
        _columns = ", ".join(f"{NAMES[k % 3]}.v AS v_{k + 1}" for k in range(_n))
        query(f"zip{_n}", f"SELECT i0, {_columns} FROM {ZIPPED}")(partial(_zip, _n))
    query(f"unzip{_n}", f"SELECT i0, {NAMES[(_n - 1) % 3]}.v - b.v AS v FROM {ZIPPED}")(partial(_unzip, _n))

# ---------------------------------------------------------------- sources and access from the host


def _rows(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


@query("from_function", "SELECT range // 20 AS i0, range % 20 AS i1, (range // 20) * (range % 20) AS v FROM range(600)")
def _(t: Tables) -> Any:
    return src.from_function(t.spark, (30, 20), lambda i, j: i * j)


@query("to_list", f"SELECT i0, v FROM {ORD} WHERE i0 < 100")
def _(t: Tables) -> Any:
    return _rows(t, list(enumerate(src.to_list(s.take(t.orders, 100)))), "i0 long, v long")


@query("string_literal", "SELECT range AS i0, unicode(substr('naïve text', range + 1, 1)) AS v FROM range(10)")
def _(t: Tables) -> Any:
    return src.from_string(t.spark, "naïve text")


@query("index_array", f"SELECT i0 AS k, v FROM {ORD} WHERE i0 IN (0, 17, {NO} - 1)")
def _(t: Tables) -> Any:
    o = t.orders
    return _rows(t, [(k, src.index_array(o, k)) for k in (0, 17, o.extent[0] - 1)], "k long, v long")


@query("linear_index_array", f"SELECT i0 * 64 + i1 AS k, v FROM {MAT} WHERE i0 * 64 + i1 IN (3, 64, 7000)")
def _(t: Tables) -> Any:
    return _rows(t, [(k, src.linear_index_array(t.matrix, k)) for k in (3, 64, 7000)], "k long, v long")


@query("array_properties", f"SELECT 2::BIGINT AS dims, {NV} AS n0, 64::BIGINT AS n1, {NV} * 64 AS size, {NV} * 4 AS n0_after")
def _(t: Tables) -> Any:
    m = t.matrix
    after = s.reshape(m, (m.extent[0] * 4, 16))
    return _rows(t, [(src.array_rank(m), *src.array_shape(m), src.array_size(m), src.array_shape(after)[0])], "dims long, n0 long, n1 long, size long, n0_after long")


query("allocate_array", "SELECT range AS i0, 0::DOUBLE AS v FROM range(100)")(lambda t: src.allocate_array(t.spark, (100,)))
query("empty_array", "SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, 0::DOUBLE AS v WHERE false")(lambda t: src.empty_array(t.spark, 2))

# ---------------------------------------------------------------- extents and indices

query("lens_1", f"SELECT i0, i1, v FROM {MAT} WHERE i1 < 63")(lambda t: s.init_on(t.matrix, s._1))
query("lens_3", f"SELECT i0 - 5 AS i0, i1 // 8 AS i1, i1 % 8 AS i2, v FROM {MAT} WHERE i0 >= 5")(lambda t: (lambda m: s.drop_on(s.reshape(m, (m.extent[0], 8, 8)), s._3, 5))(t.matrix))


@query("extents", f"SELECT {NO} AS n, false AS empty, true AS taken_empty, {NV} * 64 AS size, 12::BIGINT AS other")
def _(t: Tables) -> Any:
    o, m = t.orders, t.matrix
    return _rows(t, [(s.length(o), s.null(o), s.null(s.take(o, 0)), s.shape_size(s.shape(m)), s.shape_size((3, 4)))], "n long, empty boolean, taken_empty boolean, size long, other long")


@query("index_parts", f"SELECT i0, i1, i1 AS v_1, i0 AS v_2, i0 + 1 AS v_3 FROM {MAT}")
def _(t: Tables) -> Any:
    return e.imap(lambda ix, v: (s.index_head(ix), s.index_tail(ix)[0], s.index1(ix[0] + 1)[0]), t.matrix)


# ---------------------------------------------------------------- segments and monoids


@query("fold1_seg_offsets", f"SELECT g.seg AS i0, max(o.v) AS v FROM (SELECT range AS seg FROM range({NO} // 10)) g JOIN {ORD} o ON o.i0 // 10 = g.seg GROUP BY 1")
def _(t: Tables) -> Any:
    o = t.orders
    n = o.extent[0] // 10
    return r.fold1_seg_offsets("max", s.take(o, n * 10), src.enum_from_step_n(t.spark, (n + 1,), 0, 10))


@query("head_flags", f"SELECT range AS i0, count(g.seg) AS v FROM range({NO}) LEFT JOIN {SEG} g ON g.lo = range GROUP BY 1")
def _(t: Tables) -> Any:
    n = t.orders.extent[0]
    return r.head_flags(t.segments(n), n)


@query("tail_flags", f"SELECT range AS i0, count(g.seg) AS v FROM range({NO}) LEFT JOIN {SEG} g ON g.hi = range + 1 GROUP BY 1")
def _(t: Tables) -> Any:
    n = t.orders.extent[0]
    return r.tail_flags(t.segments(n), n)


@query("monoid_tuple", f"SELECT i0, CAST(sum(v) AS BIGINT) AS v_1, max(v) AS v_2, min(v) AS v_3 FROM {MAT} GROUP BY i0")
def _(t: Tables) -> Any:
    return fm.fold_map(fm.product_of(fm.Sum, fm.Max, fm.Min), lambda v: (v, v, v), t.matrix)


@query("monoid_maybe", f"SELECT i0, min(v) FILTER (v % 3 = 0) AS v FROM {MAT} GROUP BY i0")
def _(t: Tables) -> Any:
    m = fm.maybe(fm.Min)
    return fm.fold_map(m, lambda v: F.when(v % 3 == 0, v), t.matrix)


@query("monoid_ordering", f"SELECT i0, coalesce(arg_min(sign(v) + 1, i1) FILTER (v <> 0), 1)::BIGINT AS v FROM {MAT} GROUP BY i0")
def _(t: Tables) -> Any:
    three_way = lambda v: F.when(v < 0, 0).when(v > 0, 2).otherwise(1).cast("long")
    return r.fold(fm.Ordering.op, F.lit(1).cast("long"), e.amap(three_way, t.matrix))


@query("monoid_flags", f"SELECT i0, bool_and(v > -5000) AS v_1, bool_or(v > 2500) AS v_2, CAST(3 * min(v) AS BIGINT) AS v_3 FROM {MAT} GROUP BY i0")
def _(t: Tables) -> Any:
    flags = fm.fold_map(fm.product_of(fm.All, fm.Any_), lambda v: (v > -5000, v > 2500), t.matrix)
    return e.zip_with(lambda f, v: (*f, fm.Sum.stimes(3, v)), flags, r.minimum(t.matrix))


# ---------------------------------------------------------------- evaluation


@query("run", f"SELECT i0, v + 1 AS v FROM {ORD} WHERE i0 < 50")
def _(t: Tables) -> Any:
    return _rows(t, list(enumerate(c.run(e.amap(lambda v: v + 1, s.take(t.orders, 50))))), "i0 long, v long")


@query("run1", f"SELECT i0, v * 2 AS v FROM {ORD} WHERE i0 < 50")
def _(t: Tables) -> Any:
    return _rows(t, list(enumerate(c.run1(lambda a: e.amap(lambda v: v * 2, a))(s.take(t.orders, 50)))), "i0 long, v long")


@query("run_n", f"SELECT i0, a.v - b.v AS v FROM {ORD} a JOIN {EV} b USING (i0) WHERE i0 < 50")
def _(t: Tables) -> Any:
    f = c.run_n(lambda a, b: e.zip_with(lambda x, y: x - y, a, b))
    return _rows(t, list(enumerate(f(s.take(t.orders, 50), s.take(t.events, 50)))), "i0 long, v long")


@query("trace", f"SELECT i0, v + (SELECT count(*) FROM part) AS v FROM {ORD}")
def _(t: Tables) -> Any:
    few = s.take(t.parts, 3)
    o = c.atrace("orders", c.atrace_array("parts", few, t.orders))
    shown = c.atrace_exp("first", few, c.atrace_id("three parts", few))
    return e.amap(lambda v: v + t.parts.extent[0] + shown.extent[0] - 3, o)


query("pair_first", f"SELECT i0, v FROM {ORD}")(lambda t: c.afst((t.orders, t.parts)))
query("pair_second", f"SELECT i0, v FROM {PART}")(lambda t: c.asnd((t.orders, t.parts)))
query("iterate_counted", f"SELECT i0, v * CAST(pow(2, i0 % 5) AS BIGINT) AS v FROM {ORD}")(lambda t: e.imap(lambda ix, v: c.iterate(ix[0] % 5, lambda x: x * 2, v), t.orders))

# ---------------------------------------------------------------- sequences: four chunks of a table, or its columns


def _chunks(t: Tables) -> seq.Seq:
    o = t.orders
    return seq.to_seq(o, 0, o.extent[0] // 4 + 1)


def _columns_of(t: Tables) -> Any:
    """Eight columns of the matrix."""
    return s.take(t.matrix, 8)


ALL_OF = f"SELECT i0, v AS v FROM {ORD}"

query("stream_in", f"SELECT i0, v FROM {PART} UNION ALL SELECT i0 + (SELECT count(*) FROM part), v FROM {ORD}")(lambda t: seq.from_seq_elems(seq.stream_in([t.parts, t.orders])))
query("to_seq", ALL_OF)(lambda t: seq.from_seq_elems(_chunks(t)))
query("map_seq", f"SELECT i0, v * 3 AS v FROM {ORD}")(lambda t: seq.from_seq_elems(seq.map_seq(lambda a: e.amap(lambda v: v * 3, a), _chunks(t))))
query("zip_with_seq", f"SELECT i0, v + v AS v FROM {ORD}")(lambda t: seq.from_seq_elems(seq.zip_with_seq(lambda a, b: e.zip_with(lambda x, y: x + y, a, b), _chunks(t), _chunks(t))))
query("fold_seq", f"SELECT CAST(5 + sum(v) AS BIGINT) AS v FROM {ORD}")(lambda t: seq.fold_seq(lambda acc, x: acc + x, F.lit(5).cast("long"), seq.map_seq(r.sum, _chunks(t))))
query("fold_seq_flatten", f"SELECT CAST(sum(v) AS BIGINT) AS v FROM {ORD}")(
    lambda t: seq.fold_seq_flatten(lambda acc, shapes, a: e.zip_with(lambda x, y: x + y, acc, r.sum(a)), src.unit(t.spark, F.lit(0).cast("long")), _chunks(t), 2)
)
query("to_seq_inner", f"SELECT i0 + i1 * {NV} AS i0, v FROM {MAT} WHERE i1 < 8")(lambda t: seq.from_seq_elems(seq.to_seq_inner(_columns_of(t))))
query("to_seq_outer2", f"SELECT i1 * {NV} + i0 AS i0, v FROM {MAT} WHERE i1 < 8")(lambda t: seq.from_seq_elems(seq.to_seq_outer2(s.transpose(_columns_of(t)))))
query("to_seq_outer3", f"SELECT (i1 % 2) * ({NV} * 4) + i0 * 4 + i1 // 2 AS i0, v FROM {MAT} WHERE i1 < 8")(
    lambda t: (lambda m: seq.from_seq_elems(seq.to_seq_outer3(s.transpose_on(s.transpose_on(s.reshape(s.flatten(m), (m.extent[0], 4, 2)), 0, 2), 1, 2))))(_columns_of(t))
)
query("generate_seq", "SELECT range AS i0, range * range AS v FROM range(6)")(
    lambda t: seq.from_seq_elems(seq.map_seq(lambda a: s.reshape(a, (1,)), seq.generate_seq(t.spark, 6, lambda i: i * i)))
)
query("collect_seq", ALL_OF)(lambda t: src.concat_vectors(seq.collect(_chunks(t))))


@query("scan_seq", f"WITH c AS (SELECT i0 // ({NO} // 4 + 1) AS k, sum(v) AS s FROM {ORD} GROUP BY 1) SELECT 0::BIGINT AS i0, 0::BIGINT AS v UNION ALL SELECT k + 1, CAST(sum(s) OVER (ORDER BY k) AS BIGINT) FROM c")
def _(t: Tables) -> Any:
    states = seq.scan_seq(lambda acc, x: acc + x, F.lit(0).cast("long"), seq.map_seq(r.sum, _chunks(t)))
    return src.concat_vectors([s.reshape(a, (1,)) for a in states])


@query("from_seq", f"SELECT range AS k, least({NO} // 4 + 1, {NO} - range * ({NO} // 4 + 1)) AS n, (SELECT CAST(sum(v) AS BIGINT) FROM {ORD}) AS total FROM range(4)")
def _(t: Tables) -> Any:
    shapes, elements = seq.from_seq(_chunks(t))
    (total,) = src.to_list(r.sum(elements))
    assert shapes == seq.from_seq_shapes(_chunks(t))
    return _rows(t, [(k, n[0], total) for k, n in enumerate(shapes)], "k long, n long, total long")
