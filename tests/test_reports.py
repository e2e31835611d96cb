"""Every report against its SQL statement on the smallest tables.

By default every report of the areas A to H runs and one per operator of the
others; TOKENLOOM_ALL=1 runs every variant. Values are equal; doubles may differ
in the last bits, and a column that a report rounds by one unit of its last
place where ROUNDED says so.
"""

import os

import pytest

from tests.oracle import connect, difference, spark_rows, sql_rows
from tokenloom.plans.catalog import REPORTS

# reports that round sums of doubles: one unit of the last place they show
ROUNDED = {"l08_reserves_v2": 1.01e-4}

PATH = os.environ.get("TOKENLOOM_DATA", "/root/testdata/sf0.001")


def chosen():
    if os.environ.get("TOKENLOOM_ALL"):
        return list(REPORTS)
    first = {}
    for name in REPORTS:
        first.setdefault(name.split("_")[0], name)
    return [n for n in REPORTS if n[0] in "abcdefgh" or n in first.values()]


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", chosen())
def test_report(spark, con, name):
    rep = REPORTS[name]
    got = spark_rows(rep(spark, PATH))
    if rep.sql is None:
        assert got[1]
    else:
        assert difference(got, sql_rows(con, rep.sql), 1e-9, ROUNDED.get(name, 1e-9)) == ""


def test_every_area_is_registered():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert {n[0] for n in queries()} >= set("abcdefghijklmnop")
