"""Queries of this subpackage against their DuckDB twins."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import duck, spark_rows  # noqa: E402

from ledgerwright.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, sf_dir, name):
    names, rows = spark_rows(queries.queries()[name](spark, sf_dir))
    want_names, want = duck(sf_dir, queries.oracle_sql()[name])
    assert names == want_names
    assert rows == want
