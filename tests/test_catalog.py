"""Every query that SQL can express gives what an independent database gives."""

from __future__ import annotations

import pytest

from tests.compare import duck, rows
from weftline import catalog

catalog.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.fieldNames() == ["batch_id", "row_in_batch", "sample_id", "doc_id", "quality"]
