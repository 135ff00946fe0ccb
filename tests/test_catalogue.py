"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import catalogue, conversions, further, matches, more, parts, structures  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [plain(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    expected = [plain(tuple(r[names.index(c)] for c in sorted(names))) for r in got.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_range_joins_are_equi_joins(spark):
    plan = catalogue.QUERIES["contact_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["index_filter_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "PushedFilters" in plan
