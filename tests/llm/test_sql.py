"""Registered queries against their DuckDB SQL on a small table of odd texts."""

import random

import duckdb
import pytest
from tests.llm.conftest import prose

from tessella.llm import licenses
from tessella.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    texts = [*base, None, "", " \n\t", "one", "ü ß 漢字 😀 " * 9, "x" * 120, "ab" * 60, "Same line again\n" * 4 + "same line AGAIN ", base[0] + "\n" + base[1], base[2].upper(), base[3] + " end", base[4] * 2]
    texts += [licenses.TEXTS["MIT"][1], "Copyright (c) 2020 Me\n" + licenses.TEXTS["ISC"][0].replace("NO EVENT", "no event"), "text\n * Licensed under the MIT Licence.\nReleased under CC BY 4.0\n# SPDX-License-Identifier: GPL-2.0", "• o - “quoted” — licence: none"]
    texts += [" ".join(rng.choice(["a" * n for n in (1, 4, 9, 14, 33, 70)]) + rng.choice("xyzé") for _ in range(40)) for _ in range(8)]
    rows = [(k, t, "en", rng.choice(["src0", "src0", "src0", "src1", "src7", "other", None])) for k, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("sql")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(at / "documents.parquet"))
    urls = [None, "", "http://Example.COM/en/7?q", "x://a.net/de/", "http://b.example.net/de/8#f", "http://o.org/es/x", "http://my-casino.io/", "http://ads-1.io"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(at / "pages.parquet"))
    return at


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=repr)
