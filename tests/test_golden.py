"""Worked examples: inputs and results in plain lists."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import control as c
from tessella.operators import elementwise as e
from tessella.operators import permute as p
from tessella.operators import reduce as r
from tessella.operators import scan as sc
from tessella.operators import shape as s
from tessella.operators import stencil as st
from tessella.plans import programs
from tessella.sources import arrays as a


def L(x):
    return a.to_list(x)


@pytest.fixture
def m(spark):
    return a.enum_from_n(spark, (5, 10), 0)


@pytest.fixture
def v(spark):
    return a.enum_from_n(spark, (10,), 0)


def test_folds(spark, m):
    assert L(r.fold("sum", 42, m)) == [87, 187, 287, 387, 487]
    assert L(r.fold_all("sum", 1, m)) == [1226]
    assert L(r.minimum(m)) == [0, 10, 20, 30, 40]
    assert L(r.fold(lambda x, y: x + y, 42, m)) == [87, 187, 287, 387, 487]
    assert L(r.product(a.enum_from_n(spark, (2, 3), 1))) == [6, 120]
    assert L(r.fold("sum", 7, a.empty_array(spark, 1, "long"))) == [7]
    assert L(r.fold("sum", F.lit(7).cast("long"), a.fill(spark, (4, 0), F.lit(0).cast("long")))) == [7] * 4
    assert L(r.all(lambda x: x < 45, m)) == [True] * 4 + [False]
    assert L(r.any(lambda x: x > 45, m)) == [False] * 4 + [True]
    mean = r.Fold.of("sum").map(lambda x: x.cast("double")) / r.Fold.of("sum", lambda x: F.lit(1).cast("long"))
    assert L(r.run_fold(mean, m)) == [4.5, 14.5, 24.5, 34.5, 44.5]


def test_max_segment_sum(spark):
    xs = a.from_list(spark, (10,), [-2, 1, -3, 4, -1, 2, 1, -5, 4, 0], "long")
    assert L(programs.max_segment_sum(xs)) == [6]


def test_scans(spark, v):
    assert L(sc.scanl("sum", 10, v)) == [10, 10, 11, 13, 16, 20, 25, 31, 38, 46, 55]
    body, total = sc.scanl_prime("sum", 0, v)
    assert L(body) == [0, 0, 1, 3, 6, 10, 15, 21, 28, 36] and L(total) == [45]
    assert L(sc.scanr("sum", 10, v)) == [55, 55, 54, 52, 49, 45, 40, 34, 27, 19, 10]
    body, total = sc.scanr_prime("sum", 0, v)
    assert L(body) == [45, 44, 42, 39, 35, 30, 24, 17, 9, 0] and L(total) == [45]
    assert L(sc.scanl1("max", v)) == list(range(10)) and L(sc.scanr1("max", v)) == [9] * 10
    assert L(sc.scanl1(lambda x, y: x + y, v)) == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]
    assert L(sc.scanl("sum", 3, a.empty_array(spark, 1, "long"))) == [3]
    # the seed's side: keep the left or the right operand
    keep = lambda x, y: x
    assert L(sc.postscanl(keep, 99, v)) == [99] * 10
    assert L(sc.postscanr(keep, 99, v)) == list(range(10))


def test_permute_histogram(spark):
    xs = a.from_list(spark, (20,), [0, 0, 1, 2, 1, 1, 2, 4, 8, 3, 4, 9, 8, 3, 2, 5, 5, 3, 1, 2], "long")
    assert L(p.histogram(10, lambda x: x, xs)) == [2, 4, 4, 3, 2, 2, 0, 0, 2, 1]


def test_segments(spark, m):
    seg = a.from_list(spark, (4,), [1, 4, 0, 3], "long")
    assert L(r.fold_seg("sum", 0, m, seg))[:4] == [0, 10, 0, 18]
    assert L(r.fold_seg_offsets("sum", 0, m, a.from_list(spark, (5,), [0, 1, 5, 5, 8], "long")))[:4] == [0, 10, 0, 18]
    assert L(sc.scanl_seg("sum", 0, m, seg))[:12] == [0, 0, 0, 1, 3, 6, 10, 0, 0, 5, 11, 18]
    assert L(sc.scanl1_seg("sum", m, seg))[:8] == [0, 1, 3, 6, 10, 5, 11, 18]
    body, total = sc.scanr_prime_seg("sum", 0, s.aslice(m, [0, s.All]), seg)
    assert L(body) == [0, 9, 7, 4, 0, 13, 7, 0] and L(total) == [0, 10, 0, 18]
    assert L(sc.postscanr_seg("sum", 100, s.aslice(m, [0, s.All]), seg)) == [100, 110, 109, 107, 104, 118, 113, 107]
    with pytest.raises(Exception, match="empty segment"):
        L(r.fold1_seg("sum", m, seg))


def test_filter_and_compact(spark):
    mat = a.from_list(spark, (4, 10), [*range(10), *([1] * 10 + [0, 0] * 5)[:10], *[1, 1, 1, 1, 1, 0, 0, 0, 0, 0], *[2] * 10], "long")
    got, counts = p.filter(lambda x: x % 2 == 1, mat)
    assert L(got) == [1, 3, 5, 7, 9] + [1] * 15 and L(counts) == [5, 10, 5, 0]
    flags = e.amap(lambda x: x > 7, mat)
    assert L(p.compact(flags, mat)[0]) == [8, 9]
    assert got.extent == (20,)


def test_gather_and_scatter(spark):
    src = a.from_list(spark, (9,), [1, 9, 6, 4, 4, 2, 0, 1, 2], "long")
    ix = a.from_list(spark, (6,), [1, 3, 7, 2, 5, 3], "long")
    assert L(p.gather(ix, src)) == [9, 4, 1, 6, 2, 4]
    to, vals = a.from_list(spark, (6,), [1, 3, 7, 2, 5, 8], "long"), a.from_list(spark, (7,), [1, 9, 6, 4, 4, 2, 5], "long")
    assert L(p.scatter(to, a.fill(spark, (9,), F.lit(0).cast("long")), vals)) == [0, 1, 4, 9, 0, 4, 0, 6, 2]
    mask = a.from_list(spark, (7,), [3, 4, 9, 2, 7, 5, 0], "long")
    assert L(p.scatter_if(to, mask, lambda x: x > 4, a.fill(spark, (10,), F.lit(0).cast("long")), vals)) == [0, 0, 0, 0, 0, 4, 0, 6, 2, 0]
    d = a.from_list(spark, (6,), [6, 6, 6, 6, 6, 6], "long")
    assert L(p.gather_if(ix, s.take(mask, 6), lambda x: x > 4, d, src)) == [6, 6, 1, 6, 2, 4]
    with pytest.raises(Exception, match="outside"):
        L(p.scatter(to, a.fill(spark, (3,), F.lit(0).cast("long")), vals))


def test_shapes(spark, m, v):
    assert L(s.transpose(s.slit(m, 2, 2))) == [2, 12, 22, 32, 42, 3, 13, 23, 33, 43]
    assert L(s.reverse(s.take(v, 4))) == [3, 2, 1, 0] and L(s.reverse(s.reverse(v))) == list(range(10))
    assert L(s.drop(v, -3)) == list(range(10)) and L(s.drop(v, 8)) == [8, 9] and L(s.init(s.tail(v))) == list(range(1, 9))
    assert s.take(v, 99).extent == (10,) and s.drop(v, 99).extent == (0,)
    assert L(s.aslice(m, [s.All, 3])) == [3, 13, 23, 33, 43]
    rep = s.replicate([2, s.All, 3], s.take(v, 2))
    assert rep.extent == (2, 2, 3) and L(rep) == [0, 0, 0, 1, 1, 1] * 2
    assert L(s.append(s.take(v, 2), s.drop(v, 8))) == [0, 1, 8, 9]
    assert L(s.reshape(m, (10, 5)))[:7] == list(range(7)) and s.reshape(m, (10, 5)).extent == (10, 5)
    assert L(s.take(s.reshape(m, (25, 2)), 1)) == list(range(0, 50, 2))
    with pytest.raises(ValueError):
        s.reshape(m, (7, 7))


def test_zips_need_no_join_on_one_base(spark, v):
    z = e.zip_with(lambda x, y: x * y, v, e.amap(lambda x: x + 1, v))
    assert "Join" not in z.df._jdf.queryExecution().executedPlan().toString()
    assert L(z) == [k * (k + 1) for k in range(10)]
    other = a.enum_from_n(spark, (7,), 100)
    assert L(e.zip_with(lambda x, y: y - x, v, other)) == [100] * 7
    x, y, w = e.unzip(e.azip(v, other, v))
    assert L(y) == list(range(100, 107)) and L(w) == list(range(7))
    assert L(e.izip_with(lambda ix, x, y: ix[0] + x, v, v)) == list(range(0, 20, 2))


def test_backpermute(spark, v, m):
    flip = p.backpermute((10,), lambda i: 9 - i, v)
    assert L(flip) == list(range(9, -1, -1)) and "Join" not in flip.df._jdf.queryExecution().executedPlan().toString()
    assert L(p.backpermute((5,), lambda i: i + 3, v)) == [3, 4, 5, 6, 7]
    assert L(p.backpermute((10, 5), lambda i, j: (j, i), m))[:5] == [0, 10, 20, 30, 40]
    assert L(p.backpermute((5,), lambda i: i * F.lit(2), v)) == [0, 2, 4, 6, 8]
    with pytest.raises(IndexError):
        p.backpermute((10,), lambda i: i + 1, v)


def ref_stencil(xs, r, kind):
    n = len(xs)

    def at(j):
        if 0 <= j < n:
            return xs[j]
        return xs[min(max(j, 0), n - 1) if kind == "clamp" else (-j if j < 0 else n - (j - n + 2)) if kind == "mirror" else j % n]

    return [sum((d + 5) * at(i + d) for d in range(-r, r + 1)) for i in range(n)]


@pytest.mark.parametrize("kind", ["clamp", "mirror", "wrap"])
@pytest.mark.parametrize("radius", [1, 3])
def test_stencil1(spark, kind, radius):
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    arr = a.from_list(spark, (8,), xs, "long")
    offs = st.box(radius)
    got = st.stencil(lambda *n: sum(((o[0] + 5) * x for o, x in zip(offs, n)), F.lit(0)), offs, getattr(st, kind), arr)
    assert L(got) == ref_stencil(xs, radius, kind)


def test_stencil2d_and_function(spark, m):
    offs = st.box(1, 1)
    got = L(st.stencil(lambda *n: sum(n, F.lit(0)), offs, st.constant(F.lit(0).cast("long")), m))
    g = [[y * 10 + x for x in range(10)] for y in range(5)]
    want = [sum(g[y + dy][x + dx] for dy, dx in offs if 0 <= y + dy < 5 and 0 <= x + dx < 10) for y in range(5) for x in range(10)]
    assert got == want
    got = L(st.stencil(lambda *n: sum(n, F.lit(0)), offs, st.function(lambda i, j: i * 100 + j), m))
    val = lambda y, x: g[y][x] if 0 <= y < 5 and 0 <= x < 10 else y * 100 + x
    assert got == [sum(val(y + dy, x + dx) for dy, dx in offs) for y in range(5) for x in range(10)]
    two = st.stencil2(lambda x, y: x[0] + y[1], [(0, -1)], st.wrap, m, [(0, 0), (1, 0)], st.clamp, m)
    assert L(two)[:3] == [9 + 10, 0 + 11, 1 + 12]


def test_expand_and_sieve(spark, v):
    got = p.expand(lambda x: x % 4, lambda x, k: x * 10 + k, v)
    assert L(got) == [x * 10 + k for x in range(10) for k in range(x % 4)]
    assert programs.sieve(spark, 100) == [q for q in range(2, 101) if all(q % d for d in range(2, q))]


def test_control(spark, v):
    small = c.awhile(lambda x: r.any(lambda y: y > 20, x), lambda x: e.amap(lambda y: F.floor(y / 2), x), e.amap(lambda x: x * 10, v))
    assert L(small) == [0, 1, 2, 3, 5, 6, 7, 8, 10, 11] or max(L(small)) <= 20
    assert c.acond(True, 1, 2) == 1 and L(c.acond(a.unit(spark, F.lit(False)), v, lambda: s.take(v, 1))) == [0]
    assert L(c.pipe(lambda x: e.amap(lambda y: y + 1, x), lambda x: r.sum(x))(v)) == [55]
    assert L(a.unit(spark, c.while_(lambda x: x < 100, lambda x: x * 2, F.lit(1).cast("long"), 64))) == [128]
    assert L(p.the(a.unit(spark, F.lit(5)), v, lambda x, t: x + t))[:2] == [5, 6]


def test_sources(spark, tmp_path):
    assert L(a.enum_from_step_n(spark, (4,), 1.5, 0.5, "double")) == [1.5, 2.0, 2.5, 3.0]
    assert L(a.from_string(spark, "hé")) == [104, 233]
    assert L(a.from_function_m(spark, (2, 2), lambda i, j: i * 10 + j, "long")) == [0, 1, 10, 11]
    with pytest.raises(ValueError):
        a.from_list(spark, (3,), [1, 2], "long")
    two = a.from_list(spark, (2, 2), [1, 2, 3, 4], "long")
    assert a.index_array(two, 1, 0) == 3 and a.linear_index_array(two, 3) == 4
    assert [r_["a"] for r_ in a.packed(two).orderBy("i0").collect()] == [[1, 2], [3, 4]]
    a.write(two, str(tmp_path / "m"))
    assert L(a.read(spark, str(tmp_path / "m"), (2, 2))) == [1, 2, 3, 4]
    assert L(a.concat_vectors([s.take(a.enum_from_n(spark, (3,), 0), 2), a.enum_from_n(spark, (2,), 7)])) == [0, 1, 7, 8]
    with pytest.raises(IndexError):
        a.index_array(two, 2, 0)


def test_sorts(spark):
    xs = [170, 45, 75, 90, 2, 802, 24, 66, 45]
    arr = e.imap(lambda ix, v: (v, ix[0]), a.from_list(spark, (9,), xs, "long"))
    want = sorted((x, k) for k, x in enumerate(xs))
    assert L(programs.radix_sort_by(lambda v: v[0], arr, bits=16)) == want
    assert L(programs.sort_by(arr, F.col("v_1"))) == want


def test_radix_sort_of_any_key(spark):
    for xs in ([65536 + 3, 5, 65536, 3, 1 << 40, 5], [-1, 7, -(1 << 63), (1 << 63) - 1, 0, -1], [0, 0]):
        arr = e.imap(lambda ix, v: (v, ix[0]), a.from_list(spark, (len(xs),), xs, "long"))
        assert L(programs.radix_sort_by(lambda v: v[0], arr)) == sorted((x, k) for k, x in enumerate(xs))
    for xs in ([65536, 1], [-1, 1]):
        with pytest.raises(ValueError, match="fit"):
            programs.radix_sort_by(lambda v: v, a.from_list(spark, (2,), xs, "long"), bits=16)


def test_reads_outside_are_errors(spark, v):
    two = a.from_list(spark, (2,), [5, 6], "long")
    where = a.from_list(spark, (3,), [0, 9, 1], "long")
    assert L(p.gather(a.from_list(spark, (3,), [1, 0, 1], "long"), two)) == [6, 5, 6]
    mask = a.from_list(spark, (3,), [1, 0, 1], "long")
    default = a.fill(spark, (3,), F.lit(-1).cast("long"))
    assert L(p.gather_if(where, mask, lambda m: m == 1, default, two)) == [5, -1, 6]
    for bad in (
        lambda: p.gather(where, two),
        lambda: p.gather_if(where, mask, lambda m: m >= 0, default, two),
        lambda: p.backpermute((3,), lambda i: i * F.lit(1), two),
        lambda: p.at(two, [where.value], where, lambda x, y: y),
        lambda: p.at_linear(two, where.value, where, lambda x, y: y),
    ):
        with pytest.raises(Exception, match="outside the array"):
            L(bad())


def test_expand_cuts_large_elements(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 4)
    xs = a.from_list(spark, (4,), [3, 11, 0, 4], "long")
    assert L(p.expand(lambda x: x, lambda x, k: x * 100 + k, xs)) == [x * 100 + k for x in (3, 11, 0, 4) for k in range(x)]


def test_places_from_many_ranges(spark, monkeypatch):
    from tessella.plans import blocks

    monkeypatch.setattr(blocks, "WINDOW_BLOCK", 8)
    at = [7, 3, 900, 41, 40, 1 << 40, (1 << 40) + 5]
    df = spark.createDataFrame([(x,) for x in at], "p long")
    assert {r["p"]: r["i"] for r in blocks.dense(df, "p", (1 << 40) + 6, "i").collect()} == {x: k for k, x in enumerate(sorted(at))}


def test_fold_of_nulls_and_of_nothing(spark):
    assert L(r.fold("max", 7, a.empty_array(spark, 1, "long"))) == [7]
    none = a.from_list(spark, (2,), [None, None], "long")
    first = lambda x, y: F.coalesce(x, y)
    assert L(r.fold(first, 7, none)) == [7] and L(r.fold(lambda x, y: y, 7, none)) == [None]
