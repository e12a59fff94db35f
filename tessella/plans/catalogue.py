"""Registered queries and the DuckDB SQL they are held against.

Integer cents and thousandths keep sums exact, so results don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import data as fd
from ..functions import scalar as fs
from ..operators import control as c
from ..operators import elementwise as e
from ..operators import permute as p
from ..operators import reduce as r
from ..operators import scan as sc
from ..operators import shape as s
from ..operators import stencil as st
from ..sources import arrays as src
from . import programs
from .arr import Arr
from .session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

All = s.All


class Tables:
    """The arrays that the queries read."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vector(self, table: str, key: str, *values: Any) -> Arr:
        df = self.table(table)
        n = df.count()  # from the file footers
        return src.use(df, [key], values, [n])

    @property
    def orders(self) -> Arr:
        """Prices in cents by order key."""
        return self.vector("orders", "o_orderkey", _cents("o_totalprice"))

    @property
    def customers(self) -> Arr:
        """Customer keys by order key."""
        return self.vector("orders", "o_orderkey", F.col("o_custkey").cast("long"))

    @property
    def events(self) -> Arr:
        return self.vector("events", "event_id", _cents("value"))

    @property
    def parts(self) -> Arr:
        return self.vector("part", "p_partkey", _cents("p_retailprice"))

    @property
    def matrix(self) -> Arr:
        """Embeddings in thousandths, vectors x 64."""
        df = self.table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("x"))
        return src.use_packed(df, "vec_id", "x", (df.count(), 64))

    def segments(self, n: int) -> Arr:
        """Lengths 0, 2, 4, 1, 3, ... that sum to n or a little less."""
        return src.generate(self.spark, (n // 10 * 5,), lambda i: (i * 7) % 5)


def _cents(name: str) -> Any:
    return F.round(F.col(name) * 100).cast("long")


ORD = "(SELECT o_orderkey AS i0, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
CUST = "(SELECT o_orderkey AS i0, CAST(o_custkey AS BIGINT) AS v FROM orders)"
EV = "(SELECT event_id AS i0, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
PART = "(SELECT p_partkey AS i0, CAST(round(p_retailprice * 100) AS BIGINT) AS v FROM part)"
MAT = "(SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"
NO = "(SELECT count(*) FROM orders)"
NE = "(SELECT count(*) FROM events)"
NV = "(SELECT count(*) FROM embeddings)"


def _seg(n: str) -> str:
    return f"(SELECT seg, len, CAST(sum(len) OVER (ORDER BY seg) - len AS BIGINT) AS lo, CAST(sum(len) OVER (ORDER BY seg) AS BIGINT) AS hi FROM (SELECT range AS seg, (range * 7) % 5 AS len FROM range({n} // 10 * 5)))"


SEG = _seg(NO)
#: Orders with their segment.
INSEG = f"(SELECT o.i0, o.v, g.seg, g.lo, g.hi FROM {ORD} o JOIN {SEG} g ON o.i0 >= g.lo AND o.i0 < g.hi)"


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[Tables], Any]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Arr) else out

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---------------------------------------------------------------- sources

query("generate", "SELECT range // 5 AS i0, range % 5 AS i1, (range // 5) * 10 + range % 5 AS v FROM range(500)")(lambda t: src.generate(t.spark, (100, 5), lambda i, j: i * 10 + j))
query("fill", "SELECT range AS i0, CAST(7 AS BIGINT) AS v FROM range(1000)")(lambda t: src.fill(t.spark, (1000,), F.lit(7).cast("long")))
query("enum_from_n", "SELECT range // 4 AS i0, range % 4 AS i1, range + 3 AS v FROM range(400)")(lambda t: src.enum_from_n(t.spark, (100, 4), 3))
query("enum_from_step_n", "SELECT range AS i0, 5 + range * 3 AS v FROM range(1000)")(lambda t: src.enum_from_step_n(t.spark, (1000,), 5, 3))
query("unit", "SELECT CAST(42 AS BIGINT) AS v")(lambda t: src.unit(t.spark, F.lit(42).cast("long")))
query("use", f"SELECT i0, v FROM {ORD}")(lambda t: t.orders)
query("from_list", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(3 AS BIGINT)), (1, 1), (2, 4)) t(i0, v)")(lambda t: src.from_list(t.spark, (3,), [3, 1, 4], "long"))
query("from_function_m", "SELECT range AS i0, range * range AS v FROM range(200)")(lambda t: src.from_function_m(t.spark, (200,), lambda i: i * i, "long"))
query("concat_vectors", f"SELECT i0, v FROM {PART} UNION ALL SELECT i0 + (SELECT count(*) FROM part), v FROM {PART}")(lambda t: src.concat_vectors([t.parts, t.parts]))
query("packed", f"SELECT i0, sum(v) AS v FROM (SELECT i0, CAST(v AS BIGINT) AS v FROM {MAT}) GROUP BY i0".replace("sum(v)", "CAST(sum(v) AS BIGINT)"))(lambda t: src.packed(t.matrix).select("i0", r.sfoldl(lambda a, x: a + x, F.lit(0).cast("long"), F.col("a")).alias("v")))

# ---------------------------------------------------------------- element-wise

query("map", f"SELECT i0, v * 2 + 1 AS v FROM {ORD}")(lambda t: e.amap(lambda v: v * 2 + 1, t.orders))
query("imap", f"SELECT i0, v - i0 AS v FROM {ORD}")(lambda t: e.imap(lambda ix, v: v - ix[0], t.orders))
query("indexed", f"SELECT i0, i0 AS v_1, v AS v_2 FROM {ORD}")(lambda t: e.amap(lambda v: (v[0]["i0"], v[1]), e.indexed(t.orders)))
query("zip_with", f"SELECT i0, a.v * b.v AS v FROM {ORD} a JOIN {EV} b USING (i0)")(lambda t: e.zip_with(lambda a, b: a * b, t.orders, t.events))
query("zip_with3", f"SELECT i0, a.v + b.v * d.v AS v FROM {ORD} a JOIN {EV} b USING (i0) JOIN {PART} d USING (i0)")(lambda t: e.zip_with3(lambda a, b, d: a + b * d, t.orders, t.events, t.parts))
query("zip_with9", f"SELECT i0, v * 9 AS v FROM {ORD}")(lambda t: (lambda o: e.zip_with9(lambda *xs: sum(xs[1:], xs[0]), *[o] * 9))(t.orders))
query("izip_with", f"SELECT i0, a.v + b.v + i0 AS v FROM {ORD} a JOIN {PART} b USING (i0)")(lambda t: e.izip_with(lambda ix, a, b: a + b + ix[0], t.orders, t.parts))
query("zip3", f"SELECT i0, a.v AS v_1, b.v AS v_2, d.v AS v_3 FROM {ORD} a JOIN {EV} b USING (i0) JOIN {PART} d USING (i0)")(lambda t: e.zip3(t.orders, t.events, t.parts))
query("unzip", f"SELECT i0, b.v FROM {ORD} a JOIN {EV} b USING (i0)")(lambda t: e.unzip(e.azip(t.orders, t.events))[1])
query("zip_same_base", f"SELECT i0, v * (v + 1) AS v FROM {ORD}")(lambda t: (lambda o: e.zip_with(lambda a, b: a * b, o, e.amap(lambda v: v + 1, o)))(t.orders))

# ---------------------------------------------------------------- shapes

query("reshape", f"SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, v FROM {MAT}")(lambda t: (lambda m: s.reshape(m, (m.extent[0] * 2, 32)))(t.matrix))
query("flatten", f"SELECT i0 * 64 + i1 AS i0, v FROM {MAT}")(lambda t: s.flatten(t.matrix))
query("replicate", f"SELECT i0, range AS i1, v FROM {PART}, range(3)")(lambda t: s.replicate([All, 3], t.parts))
query("slice", f"SELECT i0, v FROM {MAT} WHERE i1 = 7")(lambda t: s.aslice(t.matrix, [All, 7]))
query("take", f"SELECT i0, i1, v FROM {MAT} WHERE i1 < 5")(lambda t: s.take(t.matrix, 5))
query("drop", f"SELECT i0, i1 - 60 AS i1, v FROM {MAT} WHERE i1 >= 60")(lambda t: s.drop(t.matrix, 60))
query("init", f"SELECT i0, v FROM {ORD} WHERE i0 < {NO} - 1")(lambda t: s.init(t.orders))
query("tail", f"SELECT i0 - 1 AS i0, v FROM {ORD} WHERE i0 > 0")(lambda t: s.tail(t.orders))
query("slit", f"SELECT i0 - 10 AS i0, v FROM {ORD} WHERE i0 BETWEEN 10 AND 29")(lambda t: s.slit(t.orders, 10, 20))
query("take_on", f"SELECT i0, i1, v FROM {MAT} WHERE i0 < 9")(lambda t: s.take_on(t.matrix, -2, 9))
query("drop_on", f"SELECT i0 - 9 AS i0, i1, v FROM {MAT} WHERE i0 >= 9")(lambda t: s.drop_on(t.matrix, s._2, 9))
query("init_on", f"SELECT i0, i1, v FROM {MAT} WHERE i0 < {NV} - 1")(lambda t: s.init_on(t.matrix, 0))
query("tail_on", f"SELECT i0 - 1 AS i0, i1, v FROM {MAT} WHERE i0 > 0")(lambda t: s.tail_on(t.matrix, 0))
query("slit_on", f"SELECT i0 - 3 AS i0, i1, v FROM {MAT} WHERE i0 BETWEEN 3 AND 7")(lambda t: s.slit_on(t.matrix, 0, 3, 5))
query("append", f"SELECT i0, v FROM {PART} UNION ALL SELECT i0 + (SELECT count(*) FROM part), v FROM {ORD}")(lambda t: s.append(t.parts, t.orders))
query("concat_on", f"SELECT i0, i1, v FROM {MAT} UNION ALL SELECT i0 + {NV}, i1, v FROM {MAT}")(lambda t: s.concat_on(0, t.matrix, t.matrix))
query("reverse", f"SELECT {NO} - 1 - i0 AS i0, v FROM {ORD}")(lambda t: s.reverse(t.orders))
query("reverse_on", f"SELECT i0, 63 - i1 AS i1, v FROM {MAT}")(lambda t: s.reverse_on(t.matrix, -1))
query("transpose", f"SELECT i1 AS i0, i0 AS i1, v FROM {MAT}")(lambda t: s.transpose(t.matrix))
query("transpose_on", f"SELECT i1 // 8 AS i0, i1 % 8 AS i1, i0 AS i2, v FROM {MAT}")(lambda t: (lambda m: s.transpose_on(s.transpose_on(s.reshape(m, (m.extent[0], 8, 8)), 0, 1), 1, 2))(t.matrix))
query("shape", f"SELECT {NV} AS n0, CAST(64 AS BIGINT) AS n1, {NV} * 64 AS size")(lambda t: (lambda m: t.spark.createDataFrame([(*s.shape(m), s.size(m))], "n0 long, n1 long, size long"))(t.matrix))

# ---------------------------------------------------------------- gather, scatter, filter

query("backpermute", f"SELECT range AS i0, v FROM range({NO} // 3) JOIN {ORD} o ON o.i0 = range * 3")(lambda t: (lambda o: p.backpermute((o.extent[0] // 3,), lambda i: i * F.lit(3), o))(t.orders))
query("backpermute_affine", f"SELECT {NO} - 1 - i0 AS i0, v FROM {ORD} WHERE i0 >= 3")(lambda t: (lambda o: p.backpermute((o.extent[0] - 3,), lambda i: o.extent[0] - 1 - i, o))(t.orders))
query("gather", f"SELECT o.i0, b.v FROM {ORD} o JOIN {EV} b ON b.i0 = o.v % {NE}")(lambda t: (lambda ev: p.gather(e.amap(lambda v: v % ev.extent[0], t.orders), ev))(t.events))
query("gather_if", f"SELECT o.i0, CASE WHEN o.v % 2 = 0 THEN b.v ELSE -1 END AS v FROM {ORD} o JOIN {EV} b ON b.i0 = o.v % {NE}")(
    lambda t: (lambda o, ev: p.gather_if(e.amap(lambda v: v % ev.extent[0], o), o, fs.even, e.amap(lambda v: F.lit(-1).cast("long"), o), ev))(t.orders, t.events)
)
query("permute_hist", f"SELECT range AS i0, count(b.v) AS v FROM range(20) LEFT JOIN {EV} b ON b.v % 20 = range GROUP BY range")(lambda t: p.histogram(20, lambda v: v % 20, t.events))
query("permute_2d", f"SELECT a.range AS i0, b.range AS i1, CAST(100 + coalesce(sum(o.v), 0) AS BIGINT) AS v FROM range(4) a CROSS JOIN range(5) b LEFT JOIN {ORD} o ON o.v % 4 = a.range AND o.i0 % 5 = b.range GROUP BY 1, 2")(
    lambda t: p.permute("sum", src.fill(t.spark, (4, 5), F.lit(100).cast("long")), lambda ix, v: (v % 4, ix[0] % 5), t.orders)
)
query("permute_max_maybe", f"SELECT range AS i0, coalesce(max(o.v), -1) AS v FROM range(50) LEFT JOIN {ORD} o ON o.v % 60 = range GROUP BY range")(
    lambda t: p.permute("max", src.fill(t.spark, (50,), F.lit(-1).cast("long")), lambda ix, v: F.when(v % 60 < 50, v % 60), t.orders)
)
query("scatter", f"SELECT range AS i0, coalesce(arg_max(o.v, o.i0), -1) AS v FROM range(100) LEFT JOIN {ORD} o ON o.v % 100 = range GROUP BY range")(
    lambda t: (lambda o: p.scatter(e.amap(lambda v: v % 100, o), src.fill(t.spark, (100,), F.lit(-1).cast("long")), o))(t.orders)
)
query("scatter_if", f"SELECT range AS i0, coalesce(arg_max(o.v, o.i0), -1) AS v FROM range(100) LEFT JOIN {ORD} o ON o.v % 100 = range AND o.v % 3 = 0 GROUP BY range")(
    lambda t: (lambda o: p.scatter_if(e.amap(lambda v: v % 100, o), o, lambda v: v % 3 == 0, src.fill(t.spark, (100,), F.lit(-1).cast("long")), o))(t.orders)
)
query("filter", f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM {ORD} WHERE v % 2 = 0")(lambda t: p.filter(fs.even, t.orders)[0])
query("filter_counts", f"SELECT i0, count(*) FILTER (v > 0) AS v FROM {MAT} GROUP BY i0")(lambda t: p.filter(lambda v: v > 0, t.matrix)[1])
query("filter_2d", f"SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, v FROM {MAT} WHERE v > 0")(lambda t: p.filter(lambda v: v > 0, t.matrix)[0])
query("compact", f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, a.v FROM {ORD} a JOIN {EV} b USING (i0) WHERE b.v % 3 = 0")(lambda t: p.compact(e.amap(lambda v: v % 3 == 0, t.events), t.orders)[0])
query("expand", f"SELECT row_number() OVER (ORDER BY i0, k) - 1 AS i0, v * 10 + k AS v FROM (SELECT i0, v, unnest(range(v % 4)) AS k FROM {EV})")(lambda t: p.expand(lambda v: v % 4, lambda v, k: v * 10 + k, t.events))
query("index", f"SELECT i0, a.v - b.v AS v FROM {ORD} a JOIN (SELECT i0 AS j, v FROM {PART}) b ON b.j = a.v % (SELECT count(*) FROM part)")(lambda t: (lambda pt, o: p.at(pt, [o.value % pt.extent[0]], o, lambda v, x: v - x))(t.parts, t.orders))
query("index_linear", f"SELECT o.i0, o.v + m.v AS v FROM {ORD} o JOIN (SELECT i0 * 64 + i1 AS k, v FROM {MAT}) m ON m.k = o.i0 % ({NV} * 64)")(lambda t: (lambda m, o: p.at_linear(m, o.dims[0].column % m.size, o, lambda v, x: v + x))(t.matrix, t.orders))
query("the", f"SELECT i0, v - (SELECT min(v) FROM {ORD}) AS v FROM {ORD}")(lambda t: (lambda o: p.the(r.minimum(o), o, lambda v, x: v - x))(t.orders))

# ---------------------------------------------------------------- reductions

query("fold", f"SELECT i0, CAST(42 + sum(v) AS BIGINT) AS v FROM {MAT} GROUP BY i0")(lambda t: r.fold("sum", 42, t.matrix))
query("fold1", f"SELECT i0, max(v) AS v FROM {MAT} GROUP BY i0")(lambda t: r.fold1("max", t.matrix))
query("fold_all", f"SELECT CAST(sum(v) AS BIGINT) AS v FROM {MAT}")(lambda t: r.fold_all("sum", 0, t.matrix))
query("fold1_all", f"SELECT min(v) AS v FROM {MAT}")(lambda t: r.fold1_all("min", t.matrix))
query("sum", f"SELECT CAST(sum(v) AS BIGINT) AS v FROM {ORD}")(lambda t: r.sum(t.orders))
query("product", f"SELECT i0, CAST(product(CASE WHEN v % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS v FROM {MAT} GROUP BY i0")(lambda t: r.product(e.amap(lambda v: F.when(v % 3 == 0, F.lit(2).cast("long")).otherwise(F.lit(1).cast("long")), t.matrix)))
query("minimum", f"SELECT i0, min(v) AS v FROM {MAT} GROUP BY i0")(lambda t: r.minimum(t.matrix))
query("maximum", f"SELECT max(v) AS v FROM {ORD}")(lambda t: r.maximum(t.orders))
query("all", f"SELECT i0, bool_and(v < 200) AS v FROM {MAT} GROUP BY i0")(lambda t: r.all(lambda v: v < 200, t.matrix))
query("any", f"SELECT i0, bool_or(v > 200) AS v FROM {MAT} GROUP BY i0")(lambda t: r.any(lambda v: v > 200, t.matrix))
query("and_or", f"SELECT i0, bool_and(v <> 0) OR bool_or(v > 300) AS v FROM {MAT} GROUP BY i0")(lambda t: (lambda m: e.zip_with(lambda a, b: a | b, r.and_(e.amap(lambda v: v != 0, m)), r.or_(e.amap(lambda v: v > 300, m))))(t.matrix))
query("fold_generic", f"SELECT i0, CAST(arg_min(v, i1) * 1000 + arg_max(v, i1) AS BIGINT) AS v FROM {MAT} GROUP BY i0")(
    # first and last of each row: associative, not commutative
    lambda t: (lambda f: f.with_values(f.values[0] * 1000 + f.values[1]))(r.fold1(lambda a, b: (a[0], b[1]), e.amap(lambda v: (v, v), t.matrix)))
)
query("fold_mss", f"SELECT i0, greatest(0, max(pre - least(0, low))) AS v FROM (SELECT i0, pre, coalesce(min(pre) OVER (PARTITION BY i0 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM (SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS BIGINT) AS pre FROM {MAT})) GROUP BY i0")(
    lambda t: programs.max_segment_sum(t.matrix)
)
query("run_fold", f"SELECT i0, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS v FROM {MAT} GROUP BY i0")(
    lambda t: e.amap(lambda v: F.round(v, 6), r.run_fold(r.Fold.of("sum").map(lambda x: x.cast("double")) / r.Fold.of("sum", lambda v: F.lit(1).cast("long")), t.matrix))
)
query("fold_seg", f"SELECT g.seg AS i0, CAST(42 + coalesce(sum(o.v), 0) AS BIGINT) AS v FROM {SEG} g LEFT JOIN {ORD} o ON o.i0 >= g.lo AND o.i0 < g.hi GROUP BY g.seg")(lambda t: (lambda o: r.fold_seg("sum", 42, o, t.segments(o.extent[0])))(t.orders))
query("fold1_seg", f"SELECT i0 // 4 AS i0, max(v) AS v FROM {ORD} WHERE i0 < {NO} // 4 * 4 GROUP BY 1")(lambda t: (lambda o: r.fold1_seg("max", o, src.fill(t.spark, (o.extent[0] // 4,), F.lit(4).cast("long"))))(t.orders))
query("fold_seg_offsets", f"SELECT i0 // 3 AS i0, CAST(sum(v) AS BIGINT) AS v FROM {ORD} WHERE i0 < {NO} // 3 * 3 GROUP BY 1")(lambda t: (lambda o: r.fold_seg_offsets("sum", 0, o, src.enum_from_step_n(t.spark, (o.extent[0] // 3 + 1,), 0, 3)))(t.orders))
query("fold_seg_2d", f"SELECT i0, i1 // 16 AS i1, CAST(sum(v) AS BIGINT) AS v FROM {MAT} GROUP BY 1, 2")(lambda t: r.fold_seg("sum", 0, t.matrix, src.fill(t.spark, (4,), F.lit(16).cast("long"))))

# ---------------------------------------------------------------- scans

query("scanl", f"SELECT CAST(0 AS BIGINT) AS i0, CAST(10 AS BIGINT) AS v UNION ALL SELECT i0 + 1, CAST(10 + sum(v) OVER (ORDER BY i0) AS BIGINT) FROM {ORD}")(lambda t: sc.scanl("sum", 10, t.orders))
query("scanl1", f"SELECT i0, CAST(sum(v) OVER (ORDER BY i0) AS BIGINT) AS v FROM {ORD}")(lambda t: sc.scanl1("sum", t.orders))
query("scanl1_2d", f"SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS BIGINT) AS v FROM {MAT}")(lambda t: sc.scanl1("sum", t.matrix))
query("scanl_prime", f"SELECT i0, CAST(coalesce(sum(v) OVER (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS BIGINT) AS v FROM {ORD}")(lambda t: sc.scanl_prime("sum", 5, t.orders)[0])
query("scanl_prime_total", f"SELECT i0, CAST(sum(v) + 5 AS BIGINT) AS v FROM {MAT} GROUP BY i0")(lambda t: sc.scanl_prime("sum", 5, t.matrix)[1])
query("scanr", f"SELECT {NO} AS i0, CAST(10 AS BIGINT) AS v UNION ALL SELECT i0, CAST(10 + sum(v) OVER (ORDER BY i0 DESC) AS BIGINT) FROM {ORD}")(lambda t: sc.scanr("sum", 10, t.orders))
query("scanr1", f"SELECT i0, max(v) OVER (ORDER BY i0 DESC) AS v FROM {ORD}")(lambda t: sc.scanr1("max", t.orders))
query("scanr_prime", f"SELECT i0, CAST(coalesce(sum(v) OVER (ORDER BY i0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS BIGINT) AS v FROM {ORD}")(lambda t: sc.scanr_prime("sum", 5, t.orders)[0])
query("scanr_prime_total", f"SELECT i0, CAST(sum(v) + 5 AS BIGINT) AS v FROM {MAT} GROUP BY i0")(lambda t: sc.scanr_prime("sum", 5, t.matrix)[1])
query("prescanl", f"SELECT i0, greatest(coalesce(max(v) OVER (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 7), 7) AS v FROM {ORD}")(lambda t: sc.prescanl("max", 7, t.orders))
query("postscanl", f"SELECT i0, CAST(7 + sum(v) OVER (ORDER BY i0) AS BIGINT) AS v FROM {ORD}")(lambda t: sc.postscanl("sum", 7, t.orders))
query("prescanr", f"SELECT i0, greatest(coalesce(max(v) OVER (ORDER BY i0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 7), 7) AS v FROM {ORD}")(lambda t: sc.prescanr("max", 7, t.orders))
query("postscanr", f"SELECT i0, CAST(7 + sum(v) OVER (ORDER BY i0 DESC) AS BIGINT) AS v FROM {ORD}")(lambda t: sc.postscanr("sum", 7, t.orders))
query("scan_generic", f"SELECT i0, CAST(v - first_value(v) OVER (ORDER BY i0) AS BIGINT) AS v FROM {ORD}")(
    # (first, last) of every prefix
    lambda t: (lambda f: f.with_values(f.values[1] - f.values[0]))(sc.scanl1(lambda a, b: (a[0], b[1]), e.amap(lambda v: (v, v), t.orders)))
)
query("scanl_seg", f"SELECT g.lo + g.seg AS i0, CAST(3 AS BIGINT) AS v FROM {SEG} g UNION ALL SELECT i0 + seg + 1, CAST(3 + sum(v) OVER (PARTITION BY seg ORDER BY i0) AS BIGINT) FROM {INSEG}")(lambda t: (lambda o: sc.scanl_seg("sum", 3, o, t.segments(o.extent[0])))(t.orders))
query("scanl1_seg", f"SELECT i0, CAST(sum(v) OVER (PARTITION BY seg ORDER BY i0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.scanl1_seg("sum", o, t.segments(o.extent[0])))(t.orders))
query("scanl_prime_seg", f"SELECT i0, CAST(3 + coalesce(sum(v) OVER (PARTITION BY seg ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.scanl_prime_seg("sum", 3, o, t.segments(o.extent[0]))[0])(t.orders))
query("scanl_prime_seg_total", f"SELECT g.seg AS i0, CAST(3 + coalesce(sum(o.v), 0) AS BIGINT) AS v FROM {SEG} g LEFT JOIN {ORD} o ON o.i0 >= g.lo AND o.i0 < g.hi GROUP BY g.seg")(lambda t: (lambda o: sc.scanl_prime_seg("sum", 3, o, t.segments(o.extent[0]))[1])(t.orders))
query("prescanl_seg", f"SELECT i0, CAST(coalesce(sum(v) OVER (PARTITION BY seg ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.prescanl_seg("sum", 0, o, t.segments(o.extent[0])))(t.orders))
query("postscanl_seg", f"SELECT i0, CAST(9 + sum(v) OVER (PARTITION BY seg ORDER BY i0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.postscanl_seg("sum", 9, o, t.segments(o.extent[0])))(t.orders))
query("scanr_seg", f"SELECT g.hi + g.seg AS i0, CAST(3 AS BIGINT) AS v FROM {SEG} g UNION ALL SELECT i0 + seg, CAST(3 + sum(v) OVER (PARTITION BY seg ORDER BY i0 DESC) AS BIGINT) FROM {INSEG}")(lambda t: (lambda o: sc.scanr_seg("sum", 3, o, t.segments(o.extent[0])))(t.orders))
query("scanr1_seg", f"SELECT i0, max(v) OVER (PARTITION BY seg ORDER BY i0 DESC) AS v FROM {INSEG}")(lambda t: (lambda o: sc.scanr1_seg("max", o, t.segments(o.extent[0])))(t.orders))
query("scanr_prime_seg", f"SELECT i0, CAST(3 + coalesce(sum(v) OVER (PARTITION BY seg ORDER BY i0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.scanr_prime_seg("sum", 3, o, t.segments(o.extent[0]))[0])(t.orders))
query("prescanr_seg", f"SELECT i0, CAST(coalesce(sum(v) OVER (PARTITION BY seg ORDER BY i0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.prescanr_seg("sum", 0, o, t.segments(o.extent[0])))(t.orders))
query("postscanr_seg", f"SELECT i0, CAST(9 + sum(v) OVER (PARTITION BY seg ORDER BY i0 DESC) AS BIGINT) AS v FROM {INSEG}")(lambda t: (lambda o: sc.postscanr_seg("sum", 9, o, t.segments(o.extent[0])))(t.orders))

# ---------------------------------------------------------------- stencils


def _taps(bound: str, n: str, radius: int) -> str:
    return " UNION ALL ".join(f"SELECT i0, {d + 5} * (SELECT 1) AS w, {bound.format(j=f'(i0 + {d})', n=n)} AS j FROM {EV}" for d in range(-radius, radius + 1))


def _stencil_sql(bound: str, radius: int) -> str:
    return f"SELECT t.i0, CAST(sum(t.w * b.v) AS BIGINT) AS v FROM ({_taps(bound, NE, radius)}) t JOIN {EV} b ON b.i0 = t.j GROUP BY t.i0"


def _weighted(radius: int) -> Callable:
    return lambda *xs: sum(((d + 5) * x for d, x in zip(range(-radius, radius + 1), xs)), F.lit(0).cast("long"))


CLAMP = "greatest(0, least({n} - 1, {j}))"
MIRROR = "CASE WHEN {j} < 0 THEN -{j} WHEN {j} >= {n} THEN {n} - ({j} - {n} + 2) ELSE {j} END"
WRAP = "CASE WHEN {j} < 0 THEN {n} + {j} WHEN {j} >= {n} THEN {j} - {n} ELSE {j} END"

query("stencil3_clamp", _stencil_sql(CLAMP, 1))(lambda t: st.stencil(_weighted(1), st.box(1), st.clamp, t.events))
query("stencil5_mirror", _stencil_sql(MIRROR, 2))(lambda t: st.stencil(_weighted(2), st.box(2), st.mirror, t.events))
query("stencil7_wrap", _stencil_sql(WRAP, 3))(lambda t: st.stencil(_weighted(3), st.box(3), st.wrap, t.events))
query("stencil9_function", f"SELECT t.i0, CAST(sum(t.w * coalesce(b.v, t.j * 3)) AS BIGINT) AS v FROM ({_taps('{j}', NE, 4)}) t LEFT JOIN {EV} b ON b.i0 = t.j GROUP BY t.i0")(lambda t: st.stencil(_weighted(4), st.box(4), st.function(lambda i: i * 3), t.events))
query("stencil3x3", f"SELECT t.i0, t.i1, CAST(sum(b.v) AS BIGINT) AS v FROM (SELECT i0, i1, greatest(0, least({NV} - 1, i0 + y.d)) AS j0, greatest(0, least(63, i1 + x.d)) AS j1 FROM {MAT}, (VALUES (-1), (0), (1)) y(d), (VALUES (-1), (0), (1)) x(d)) t JOIN {MAT} b ON b.i0 = t.j0 AND b.i1 = t.j1 GROUP BY 1, 2")(
    lambda t: st.stencil(lambda *xs: sum(xs, F.lit(0).cast("long")), st.box(1, 1), st.clamp, t.matrix)
)
query("stencil2", f"SELECT a.i0, a.v * b.v - d.v AS v FROM (SELECT i0 + 1 AS i0, v FROM {EV} WHERE i0 + 1 < {NE} UNION ALL SELECT 0, v FROM {EV} WHERE i0 = {NE} - 1) a JOIN (SELECT greatest(0, i0 - 1) AS i0, v FROM {ORD} WHERE i0 > 0 UNION ALL SELECT i0, v FROM {ORD} WHERE i0 = {NO} - 1) b USING (i0) JOIN {ORD} d USING (i0)")(
    lambda t: st.stencil2(lambda x, y: x[0] * y[1] - y[0], [(-1,)], st.wrap, t.events, [(0,), (1,)], st.clamp, t.orders)
)

# ---------------------------------------------------------------- control

query("acond", f"SELECT i0, v FROM {ORD}")(lambda t: (lambda o: c.acond(r.any(lambda v: v > 100, o), lambda: o, lambda: s.take(o, 0)))(t.orders))
query("awhile", "SELECT range AS i0, (1000 + range) // 16 AS v FROM range(20)")(lambda t: c.awhile(lambda a: r.any(lambda v: v > 100, a), lambda a: e.amap(lambda v: F.shiftright(v, 1), a), src.enum_from_n(t.spark, (20,), 1000)))
query("aiterate", "SELECT range AS i0, range + 3 AS v FROM range(10)")(lambda t: c.aiterate(3, lambda a: e.amap(lambda v: v + 1, a), src.enum_from_n(t.spark, (10,), 0)))
query("iterate", f"SELECT i0, v + 5 AS v FROM {ORD}")(lambda t: e.amap(lambda v: c.iterate(5, lambda x: x + 1, v), t.orders))
query("while", "WITH RECURSIVE w(i0, v) AS (SELECT range, range + 1 FROM range(50) UNION ALL SELECT i0, v * 2 FROM w WHERE v < 100) SELECT i0, max(v) AS v FROM w GROUP BY i0")(lambda t: e.amap(lambda v: c.while_(lambda x: x < 100, lambda x: x * 2, v, 64), src.enum_from_n(t.spark, (50,), 1)))
query("case", f"SELECT i0, CASE v % 3 WHEN 0 THEN v WHEN 1 THEN -v ELSE 0 END AS v FROM {ORD}")(lambda t: e.amap(lambda v: c.case(v % 3, {0: v, 1: -v}, F.lit(0).cast("long")), t.orders))
query("compute_pipe", f"SELECT CAST(sum(v + 1) AS BIGINT) AS v FROM {ORD}")(lambda t: c.pipe(lambda a: e.amap(lambda v: v + 1, a), r.sum)(t.orders))
query("foreign_exp", f"SELECT i0, v + 1 AS v FROM {ORD}")(lambda t: e.amap(lambda v: c.foreign_exp(_plus_one, lambda x: x + 1, v, dtype="long"), t.orders))
query("foreign_acc", f"SELECT i0, v + 1 AS v FROM {ORD}")(lambda t: c.foreign_acc(None, lambda a: e.amap(lambda v: v + 1, a), t.orders))


def _plus_one(x: Any) -> Any:
    import pyarrow.compute as pc

    return pc.add(x, 1)


# ---------------------------------------------------------------- programs

query("dotp", "SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem")(
    lambda t: (lambda li: r.fold("sum", 0, e.zip_with(lambda a, b: a * b, *e.unzip(li))))(Arr.of(t.table("lineitem").select(F.col("l_orderkey").cast("long").alias("i0"), _cents("l_extendedprice").alias("v_1"), F.round((1 - F.col("l_discount")) * 100).cast("long").alias("v_2")), (None,), 2))
)
query("saxpy", f"SELECT i0, 7 * a.v + b.v AS v FROM {ORD} a JOIN {EV} b USING (i0)")(lambda t: programs.saxpy(7, t.orders, t.events))
query("sasum", f"SELECT CAST(sum(abs(v - 15000000)) AS BIGINT) AS v FROM {ORD}")(lambda t: programs.sasum(e.amap(lambda v: v - 15000000, t.orders)))
query("smvm", f"SELECT o.o_orderkey AS i0, CAST(coalesce(sum(l.q * b.v), 0) AS BIGINT) AS v FROM orders o LEFT JOIN (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) l ON l.l_orderkey = o.o_orderkey LEFT JOIN {PART} b ON b.i0 = l.l_partkey GROUP BY 1")(
    lambda t: programs.smvm(t.table("orders").count(), t.table("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val")), t.parts)
)
query("smvm_segments", f"SELECT g.seg AS i0, CAST(coalesce(sum(o.v * b.v), 0) AS BIGINT) AS v FROM {SEG} g LEFT JOIN {ORD} o ON o.i0 >= g.lo AND o.i0 < g.hi LEFT JOIN {PART} b ON b.i0 = o.v % (SELECT count(*) FROM part) GROUP BY g.seg")(
    lambda t: (lambda o, x: programs.smvm_segments(t.segments(o.extent[0]), e.amap(lambda v: v % x.extent[0], o), o, x))(t.orders, t.parts)
)
def _cnd(d: str) -> str:
    k = f"(1.0 / (1.0 + 0.2316419::DOUBLE * abs({d})))"
    poly = f"{k} * (0.31938153::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE))))"
    tail = f"(0.39894228040143267794::DOUBLE * exp(-0.5::DOUBLE * {d} * {d}) * {poly})"
    return f"CASE WHEN {d} > 0 THEN 1.0 - {tail} ELSE {tail} END"


_BS = f"""WITH o AS (SELECT i0, CAST(5 + v % 26 AS DOUBLE) AS s, CAST(1 + i0 % 100 AS DOUBLE) AS x, CAST(1 + v % 40 AS DOUBLE) / 4 AS t FROM {ORD}),
d AS (SELECT *, 0.30::DOUBLE * sqrt(t) AS root, (ln(s / x) + (0.02::DOUBLE + 0.5::DOUBLE * 0.30::DOUBLE * 0.30::DOUBLE) * t) / (0.30::DOUBLE * sqrt(t)) AS d1 FROM o),
f AS (SELECT *, d1 - root AS d2, exp(-0.02::DOUBLE * t) AS disc FROM d),
c AS (SELECT *, {_cnd("d1")} AS a, {_cnd("d2")} AS b FROM f)
SELECT i0, round(s * a - x * disc * b, 6) AS v_1, round(x * disc * (1.0 - b) - s * (1.0 - a), 6) AS v_2 FROM c"""

query("blackscholes", _BS)(lambda t: e.amap(lambda v: (F.round(v[0], 6), F.round(v[1], 6)), programs.black_scholes(e.imap(lambda ix, v: (5 + v % 26, 1 + ix[0] % 100, (1 + v % 40) / 4), t.orders))))
query("radixsort", f"SELECT row_number() OVER (ORDER BY c.v, i0) - 1 AS i0, c.v AS v_1, i0 AS v_2 FROM {CUST} c")(lambda t: programs.radix_sort_by(lambda v: v[0], e.imap(lambda ix, v: (v, ix[0]), t.customers)))
query("sort_by", f"SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, v FROM {ORD}")(lambda t: programs.sort_by(t.orders, F.col("v")))

# ---------------------------------------------------------------- scalar functions

query("intdiv", "SELECT i0, a // b AS v_1, a % b AS v_2, CAST(floor(a / b) AS BIGINT) AS v_3, a - b * CAST(floor(a / b) AS BIGINT) AS v_4 FROM (SELECT i0, v % 1000 - 500 AS a, CASE WHEN i0 % 7 - 3 = 0 THEN 5 ELSE i0 % 7 - 3 END AS b FROM " + ORD + ")")(
    lambda t: e.imap(lambda ix, v: (lambda a, b: (fs.quot(a, b), fs.rem(a, b), fs.div(a, b), fs.mod(a, b)))(v % 1000 - 500, F.when(ix[0] % 7 - 3 == 0, F.lit(5).cast("long")).otherwise(ix[0] % 7 - 3)), t.orders)
)
query("bits", f"SELECT i0, v & 255 AS v_1, v | 255 AS v_2, xor(v, 255) AS v_3, v << 3 AS v_4, v >> 3 AS v_5, CAST(bit_count(v) AS INTEGER) AS v_6, ~v AS v_7 FROM {ORD}")(
    lambda t: e.amap(lambda v: (fs.band(v, 255), fs.bor(v, 255), fs.xor(v, 255), fs.shift_l(v, 3), fs.shift_r(v, 3), fs.pop_count(v).cast("int"), fs.complement(v)), t.orders)
)
query("single_bits", f"SELECT i0, v | 16 AS v_1, v & ~16 AS v_2, xor(v, 16) AS v_3, (v & 16) <> 0 AS v_4, CAST(64 - length(ltrim(bin(v), '0')) AS INTEGER) AS v_5, CAST(bit_count(xor(v, v - 1)) - 1 AS INTEGER) AS v_6 FROM {ORD}")(
    lambda t: e.amap(lambda v: (fs.set_bit(v, 4), fs.clear_bit(v, 4), fs.complement_bit(v, 4), fs.test_bit(v, 4), fs.count_leading_zeros(v).cast("int"), fs.count_trailing_zeros(v).cast("int")), t.orders)
)
query("rounding", f"SELECT i0, CAST(trunc(x) AS BIGINT) AS v_1, CAST(round_even(x, 0) AS BIGINT) AS v_2, CAST(floor(x) AS BIGINT) AS v_3, CAST(ceil(x) AS BIGINT) AS v_4 FROM (SELECT i0, (v % 1000 - 500) / 4.0 AS x FROM {ORD})")(
    lambda t: e.amap(lambda v: (lambda x: (fs.truncate(x), fs.round_(x), fs.floor(x), fs.ceiling(x)))((v % 1000 - 500) / F.lit(4.0)), t.orders)
)
query("trig", f"SELECT i0, round(sin(x), 6) AS v_1, round(cos(x), 6) AS v_2, round(atan(x), 6) AS v_3, round(tanh(x), 6) AS v_4, round(exp(x / 10), 6) AS v_5, round(sqrt(x), 6) AS v_6, round(ln(x + 1), 6) AS v_7, round(atan2(x, 2), 6) AS v_8 FROM (SELECT i0, (v % 1000) / 100.0 AS x FROM {ORD})".replace("100.0", "CAST(100 AS DOUBLE)"))(
    lambda t: e.amap(lambda v: (lambda x: tuple(F.round(y, 6) for y in (fs.sin(x), fs.cos(x), fs.atan(x), fs.tanh(x), fs.exp(x / 10), fs.sqrt(x), fs.log(x + 1), fs.atan2(x, F.lit(2.0)))))((v % 1000) / F.lit(100.0)), t.orders)
)
query("compare", f"SELECT i0, a.v < b.v AS v_1, a.v >= b.v AS v_2, least(a.v, b.v) AS v_3, greatest(a.v, b.v) AS v_4, CASE WHEN a.v = b.v THEN 1 WHEN a.v < b.v THEN 0 ELSE 2 END AS v_5 FROM {ORD} a JOIN {EV} b USING (i0)")(
    lambda t: e.zip_with(lambda a, b: (fs.lt(a, b), fs.ge(a, b), fs.min_(a, b), fs.max_(a, b), fs.compare(a, b)), t.orders, t.events)
)
query("gcd", f"SELECT i0, gcd(v, i0 + 12) AS v_1, lcm(v % 1000 + 1, i0 % 50 + 1) AS v_2 FROM {ORD}")(lambda t: e.imap(lambda ix, v: (fs.gcd(v, ix[0] + 12), fs.lcm(v % 1000 + 1, ix[0] % 50 + 1)), t.orders))
query("maybe", f"SELECT i0, CASE WHEN v % 3 = 0 THEN v ELSE -1 END AS v_1, CASE WHEN v % 3 = 0 AND i0 % 2 = 0 THEN v + i0 END AS v_2 FROM {ORD}")(
    lambda t: e.imap(lambda ix, v: (lambda m, k: (fd.from_maybe(-1, m), fd.lift_m(lambda a, b: a + b, m, k)))(F.when(v % 3 == 0, v), F.when(ix[0] % 2 == 0, ix[0])), t.orders)
)
query("justs", f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM {ORD} WHERE v % 3 = 0")(lambda t: fd.justs(e.amap(lambda v: F.when(v % 3 == 0, v), t.orders))[0])
query("either", f"SELECT i0, CASE WHEN v % 2 = 0 THEN v + 1 ELSE v - 1 END AS v FROM {ORD}")(lambda t: e.amap(lambda v: fd.either(lambda x: x + 1, lambda y: y - 1, F.when(v % 2 == 0, fd.left(v, "long")).otherwise(fd.right(v, "long"))), t.orders))
query("lefts", f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM {ORD} WHERE v % 2 = 0")(lambda t: fd.lefts(e.amap(lambda v: F.when(v % 2 == 0, fd.left(v, "long")).otherwise(fd.right(v, "long")), t.orders))[0])
query("complex", f"SELECT i0, round(a * x - b * y, 4) AS v_1, round(a * y + b * x, 4) AS v_2, round(sqrt(a * a + b * b), 4) AS v_3, round(atan2(b, a), 6) AS v_4 FROM (SELECT i0, CAST(v % 100 + 1 AS DOUBLE) AS a, CAST(i0 % 50 AS DOUBLE) AS b, CAST(3 AS DOUBLE) AS x, CAST(-2 AS DOUBLE) AS y FROM {ORD})")(
    lambda t: e.imap(lambda ix, v: (lambda z: (lambda q: (F.round(q["re"], 4), F.round(q["im"], 4), F.round(fd.magnitude(z), 4), F.round(fd.phase(z), 6)))(fd.cmul(z, fd.complex_(3.0, -2.0))))(fd.complex_(v % 100 + 1, ix[0] % 50)), t.orders)
)
query("ratio", f"SELECT i0, n // gcd(n, d) AS v_1, d // gcd(n, d) AS v_2 FROM (SELECT i0, (v % 100 + 1) * 7 + 3 * (i0 % 50 + 1) AS n, 7 * (i0 % 50 + 1) AS d FROM {ORD})")(
    lambda t: e.imap(lambda ix, v: (lambda q: (q["num"], q["den"]))(fd.radd(fd.ratio(v % 100 + 1, ix[0] % 50 + 1), fd.ratio(3, 7))), t.orders)
)

from . import catalogue_forms, catalogue_scalars  # noqa: E402, F401 - they register queries of their own
