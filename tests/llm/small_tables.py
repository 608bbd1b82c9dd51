"""Fixtures with small tables, imported by the tests that use them."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    def build(rows, extra=()):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string")

    return build


@pytest.fixture(scope="session")
def sf():
    return SF
