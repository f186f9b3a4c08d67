"""Every registered query against its SQL, on the small tables."""

import os

import pytest

from oracle import ROOT, compare, duck
from pickwright.catalog import load

SF = os.environ.get("TEST_SF", "0.001")
SF_DIR = f"{ROOT}/sf{SF}"
CASES = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(CASES))
def test_case(name, spark, con):
    status, n, detail = compare(CASES[name], spark, con, SF_DIR)
    assert status in ("ok", "rows-only"), detail
    assert n > 0


def test_flagship(spark, con):
    import __spark_entry__ as entry

    got = [tuple(r) for r in entry.flagship(spark, SF_DIR).select("user_id", "rating", "percentile").collect()]
    want = con.execute(entry.FLAGSHIP_SQL).fetchall()
    assert sorted(got) == sorted(want)
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)


def test_every_oracle_names_the_query_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CASES) <= set(entry.oracle_sql())
