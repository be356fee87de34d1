"""Every ledger query against its DuckDB twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import duck, spark_rows  # noqa: E402

from ledgerwright.plans import ledger, sql  # noqa: E402

SQL = sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(ledger.QUERIES))
def test_same_rows_as_duckdb(spark, sf_dir, name):
    names, rows = spark_rows(ledger.queries()[name](spark, sf_dir))
    assert len(set(names)) == len(names)
    if name in SQL:
        want_names, want = duck(sf_dir, SQL[name])
        assert names == want_names
        assert rows == want


def test_entry_runs_without_the_optional_subpackage(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(sql.QUERIES) <= set(e.queries())
