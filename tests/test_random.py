"""Random arrays of rank 1 to 3, zero extents among them, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import monoid, types
from tessella.operators import permute as p
from tessella.operators import reduce as r
from tessella.operators import scan as sc
from tessella.operators import shape as s
from tessella.operators import stencil as st
from tessella.plans import blocks
from tessella.sources import arrays as a

EXTENTS = [(0,), (17,), (3, 0), (4, 9), (2, 3, 5)]


def make(spark, ext, seed=0):
    x = np.random.default_rng(seed).integers(-1000, 1000, ext)
    return x, a.from_list(spark, ext, x.reshape(-1).tolist(), "long")


def got(arr):
    return np.array(a.to_list(arr), np.int64).reshape(arr.extent)


@pytest.mark.parametrize("ext", EXTENTS)
def test_folds_and_scans(spark, ext):
    x, arr = make(spark, ext)
    assert (got(r.fold("sum", 42, arr)) == x.sum(axis=-1) + 42).all()
    pre = np.concatenate((np.full((*ext[:-1], 1), 7), 7 + np.cumsum(x, axis=-1)), axis=-1)
    assert (got(sc.scanl("sum", 7, arr)) == pre).all()
    post = np.concatenate((7 + np.cumsum(x[..., ::-1], axis=-1)[..., ::-1], np.full((*ext[:-1], 1), 7)), axis=-1)
    assert (got(sc.scanr("sum", 7, arr)) == post).all()
    assert (got(p.filter(lambda v: v > 0, arr)[0]) == x[x > 0]).all()


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WINDOW_BLOCK", 4)
    monkeypatch.setattr(blocks, "PACKED_BLOCK", 3)
    monkeypatch.setattr(st, "BLOCK", 8)
    x, arr = make(spark, (75,))
    cat = lambda u, v: (u[0], v[1])  # noqa: E731 - first of the left, second of the right: not commutative
    two = arr.with_values((arr.values[0], arr.values[0]))
    assert (got(sc.scanl1("sum", arr)) == np.cumsum(x)).all() and (got(sc.scanr1("sum", arr)) == np.cumsum(x[::-1])[::-1]).all()
    assert a.to_list(r.fold1(cat, two)) == [(x[0], x[-1])]
    assert a.to_list(sc.scanl1(cat, two)) == [(x[0], v) for v in x] and a.to_list(sc.scanr1(cat, two)) == [(v, x[-1]) for v in x]
    assert (got(st.stencil(lambda *n: n[0] - n[4], st.box(2), st.wrap, arr)) == np.roll(x, 2) - np.roll(x, -2)).all()
    seg = a.from_list(spark, (6,), [0, 20, 0, 1, 40, 9], "long")
    cut = np.split(x, np.cumsum([0, 20, 0, 1, 40]))[: 6]
    assert a.to_list(r.fold_seg("sum", 1, arr, seg)) == [int(c[:n].sum()) + 1 for c, n in zip(cut, [0, 20, 0, 1, 40, 9])]
    assert (got(sc.scanl1_seg("sum", arr, seg)) == np.concatenate([np.cumsum(c[:n]) for c, n in zip(cut, [0, 20, 0, 1, 40, 9])])).all()


@pytest.mark.parametrize("ext", [(9, 7), (3, 4, 5)])
def test_index_maps(spark, ext):
    x, arr = make(spark, ext, 1)
    assert (got(s.reverse_on(arr, 0)) == x[::-1]).all() and (got(s.transpose(arr)) == np.swapaxes(x, -1, -2)).all()
    assert (got(s.drop(s.reverse(s.take(arr, 4)), 1)) == x[..., :4][..., ::-1][..., 1:]).all()
    assert (got(s.aslice(arr, [..., 2])) == x[..., 2]).all() and got(s.replicate([..., 2], arr)).shape == (*ext, 2)
    assert (got(s.concat_on(0, arr, arr)) == np.concatenate((x, x))).all()
    pad = np.pad(x, 1, mode="edge")
    want = sum(pad[tuple(slice(1 + o, 1 + o + n) for o, n in zip(off, ext))] for off in st.box(*[1] * len(ext)))
    assert (got(st.stencil(lambda *n: sum(n, F.lit(0)), st.box(*[1] * len(ext)), st.clamp, arr)) == want).all()


def test_permute_with_a_function(spark):
    x, arr = make(spark, (60,), 2)
    to = lambda ix, v: F.when(v % 5 != 0, F.pmod(v, F.lit(10)))
    want = [max([100, *[int(v) for v in x if np.fmod(v, 5) != 0 and v % 10 == k]]) for k in range(10)]
    full = a.fill(spark, (10,), F.lit(100).cast("long"))
    assert a.to_list(p.permute("max", full, to, arr)) == want
    assert a.to_list(p.permute(lambda u, v: F.when(u > v, u).otherwise(v), full, to, arr)) == want


def test_monoids_and_flags(spark):
    x, arr = make(spark, (4, 6), 3)
    assert (got(monoid.fold_map(monoid.Sum, lambda v: v * 2, arr)) == 2 * x.sum(axis=1)).all()
    both = monoid.fold_map(monoid.product_of(monoid.Min, monoid.Max), lambda v: (v, v), arr)
    assert a.to_list(both) == [(int(m), int(n)) for m, n in zip(x.min(axis=1), x.max(axis=1))]
    first = monoid.fold_map(monoid.Ordering, lambda v: F.when(v > 900, 2).when(v < -900, 0).otherwise(1), arr)
    assert [int(v) for v in a.to_list(first)] == [next((2 if v > 900 else 0 for v in row if abs(v) > 900), 1) for row in x]
    some = a.to_list(monoid.fold_map(monoid.maybe(monoid.Sum), lambda v: F.when(v > 0, v), arr))
    assert some == [int(row[row > 0].sum()) if (row > 0).any() else None for row in x]
    seg = a.from_list(spark, (4,), [1, 0, 2, 3], "long")
    assert a.to_list(r.head_flags(seg, 6)) == [1, 2, 0, 1, 0, 0] and a.to_list(r.tail_flags(seg, 6)) == [2, 0, 1, 0, 0, 1]
    assert types.similar(1.0, 1.004) and not types.similar(1.0, 1.1) and types.similar(float("nan"), float("nan"))
