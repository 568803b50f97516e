"""Every registered query against its SQL twin, and the shape of its plan."""

import contextlib
import io

import duckdb
import pytest

from check import TABLES, compare

import __spark_entry__ as contract
from captrellis.queries import ORACLES as CORE_ORACLES
from captrellis.queries import QUERIES as CORE


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_matches_sql(spark, con, data_dir, name):
    line = compare(spark, data_dir, name, con)
    assert line.startswith("OK"), line


def test_every_query_has_a_twin():
    assert set(CORE) == set(CORE_ORACLES) and set(CORE) <= set(contract.queries())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["cider_items", "few_shot_messages", "patch_merge", "scatter_merge", "soft_assign", "encode_ids"])
def test_no_cross_join(spark, data_dir, name):
    text = plan(contract.queries()[name](spark, data_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sampling_is_a_filter_over_the_scan(spark, data_dir):
    text = plan(contract.queries()["exact_sample"](spark, data_dir))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["item_id", "n_refs", "cider"] and df.count() > 0
