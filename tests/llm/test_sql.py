import duckdb
import pytest
from compare import differences
from small_tables import sf  # noqa: F401
from stockflow.llm.queries import QUERIES
from stockflow.llm.sql import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_answer(spark, con, sf, name):
    found, count = differences(spark, con, QUERIES[name], ORACLES[name], sf)
    assert not found, found[:3]
    assert count > 0


def test_all_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
