"""The SQL twins of the corpus queries give the same rows on the smallest tables."""

import duckdb
import pytest

import check
from captrellis.llm.twins import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert check.compare(spark, sf_dir, name, con).startswith("OK")
