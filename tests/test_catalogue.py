"""Registered queries against their DuckDB SQL on the smallest tables. The driver runs them all; here one of each kind."""

import os

import duckdb
import pytest

from tessella.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = "generate imap zip_with reshape transpose backpermute gather permute_2d scatter filter_2d expand fold_mss run_fold fold_seg scanl scanr1_seg stencil5_mirror stencil3x3 smvm radixsort intdiv bits gcd complex zip_with5 izip_with9 unzip4 index_linear monoid_ordering scan_seq to_seq_outer3 iterate_counted float_division float_parts rotations to_rational maybe_monad polar".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def ansi(spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    yield
    spark.conf.set("spark.sql.ansi.enabled", old)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = db.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_all_have_sql():
    assert {*catalogue.QUERIES} == {*catalogue.ORACLE}
