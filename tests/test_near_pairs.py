"""Pairs of near records: each of them, between copies and between different texts."""

import itertools

import pytest
from test_rules_and_dedupe import RECORD, greedy, records

from postflow.operators import dedupe
from postflow.queries import ORACLE, QUERIES


@pytest.mark.parametrize("tile", [16, 2048])
def test_every_pair_is_given(spark, tile):
    rows = records(120) + [(1000 + k, "acme|9", 7, 7, "US", None, None) for k in range(70)]
    near = lambda a, b: a[1] == b[1] and greedy([(0, *a[1:]), (1, *b[1:])])[1] == 0
    want = [(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if near(a, b)]
    got = dedupe.pairs(spark.createDataFrame(rows[::-1], RECORD).repartition(3), tile=tile)
    assert sorted((r["u"], r["v"]) for r in got.collect()) == sorted(want) and len(want) > 70 * 69 // 2


def test_no_records_no_pairs(spark):
    assert dedupe.pairs(spark.createDataFrame([], RECORD)).count() == 0


def test_the_query_gives_pairs(spark):
    assert QUERIES["j14_near_pairs"](spark, "/root/testdata/sf0.001").columns == ["u", "v"]
    assert ORACLE["j14_near_pairs"].endswith("SELECT u, v FROM edges")
