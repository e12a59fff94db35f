"""Rows that share a doc_id or have none, through near-duplicates."""

import random

import pytest
from tests.llm.conftest import prose

from tessella.llm import simhash

RNG = random.Random(21)
A = prose(RNG, 80)
NEAR = A.replace(A.split()[40], "edited", 1)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_empty_text_beside_a_link(table, order):
    rows = [(7, ""), (7, A), (8, NEAR)]
    got = simhash.near_duplicates(table([rows[k] for k in order])).collect()
    assert sorted(map(tuple, got)) == [(7, 7), (7, 7), (8, 7)]
    kept = simhash.one_of_each(table([rows[k] for k in order])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(7, ""), (7, A)]


def test_one_id_with_several_texts(table):
    other, third = prose(RNG, 60), prose(RNG, 70)
    rows = [(7, other), (7, A), (8, NEAR), (3, other + " end"), (9, third), (9, third), (None, A), (None, third + " end"), (None, None), (4, "  ")]
    got = sorted(simhash.near_duplicates(table(rows)).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(7, 3), (7, 7), (8, 7), (3, 3), (9, 9), (9, 9), (None, 7), (None, 9), (None, 4), (4, 4)], key=str)
    kept = simhash.one_of_each(table(rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(3, other + " end"), (7, A), (9, third), (4, "  ")])


def test_rows_without_ids(table):
    rows = [(None, A), (None, A), (None, NEAR), (None, ""), (None, None)]
    assert {r["class_id"] for r in simhash.near_duplicates(table(rows)).collect()} == {None}
    kept = [r["text"] for r in simhash.one_of_each(table(rows)).collect()]
    assert len(kept) == 2 and {bool(t) for t in kept} == {True, False}
