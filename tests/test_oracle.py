"""Every registered query against its SQL text, on the smallest scale."""

import re

import pytest
import __spark_entry__ as entry
from compare import connect, differences
from stockflow.plans.registry import COVERS, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(TEXTS) >= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_answer(spark, con, name):
    found, count = differences(spark, con, QUERIES[name], TEXTS[name], SF)
    assert not found, found[:3]
    assert count > 0


def test_entry(spark):
    answer = entry.entry(spark)
    assert answer.count() == 200
    assert "status" in answer.columns


def test_covers_are_inventory_ids():
    assert all(re.fullmatch(r"[A-K]\d+", i) for ids in COVERS.values() for i in ids)
    assert {i for ids in COVERS.values() for i in ids} >= {f"K{n}" for n in range(1, 41)}
