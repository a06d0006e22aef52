"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from vellumgrid.plans import catalogue
from vellumgrid.plans import derived as D
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], spark, SF, con) > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "key", "rrf", "rank"] and df.count() > 0


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["recited_citations", "guarded_answers"])
def test_a_price_may_equal_the_made_up_sum(spark, con, name, tmp_path):
    for table in ("lineitem", "part"):
        price = "replace (case when (l_orderkey + l_linenumber) % 40 = 0 then 100999.99 else l_extendedprice end as l_extendedprice)" if table == "lineitem" else ""
        con.sql(f"copy (select * {price} from {table}) to '{tmp_path}/{table}.parquet' (format parquet)")
    assert compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], spark, str(tmp_path), connect(str(tmp_path))) > 0


def test_line_rows_are_those_of_the_sql(spark):
    expected, got = D.spark_rows(spark, SF, D.LINES), D.line_rows(spark, SF)
    assert got.dtypes == expected.dtypes and got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    # An item is not held against every kind of line.
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
