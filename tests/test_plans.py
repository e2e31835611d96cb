"""Plan shape: what must not appear in the plans of large reports."""

import io
import re
from contextlib import redirect_stdout

import pytest

from tokenloom.plans.catalog import REPORTS

PATH = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        REPORTS[name](spark, PATH).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["i04_balance_daily", "i08_holder_count", "j25_trading_volume", "c12_asof_last", "k05_retention", "l13_price_impact_v3", "n03_flows_weekly"])
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text
    if name not in ("i08_holder_count",):  # its grid is a broadcast calendar
        assert "NestedLoop" not in text


def shape(spark, name):
    """Shuffles and table scans of a report's plan; rows written before it do not count."""
    out = io.StringIO()
    with redirect_stdout(out):
        REPORTS[name](spark, PATH).explain("simple")
    text = out.getvalue()
    return len(re.findall(r"[-+ ] Exchange ", text)), text.count("FileScan"), text


@pytest.mark.parametrize("name, exchanges, scans", [
    ("d08_median_exact", 3, 2), ("j11_median_trade_price", 7, 6), ("d17_describe", 4, 3), ("c12_asof_last", 4, 4), ("l09_reserves_v3", 9, 4), ("j30_pnl_cumulative", 12, 6), ("j25_trading_volume", 6, 3),
])
def test_plans_stay_small(spark, name, exchanges, scans):
    n, m, text = shape(spark, name)
    assert n <= exchanges and m <= scans, text
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["i04_balance_daily_bucketed", "i09_multi_product_bucketed"])
def test_a_bucketed_ledger_is_not_shuffled_by_holder(spark, name):
    _, _, text = shape(spark, name)
    assert "Bucketed: true" in text
    assert not re.findall(r"hashpartitioning\((token|holder)", text)


def test_scan_gets_filters_and_columns(spark):
    text = plan(spark, "a01_read_events")
    assert "GreaterThanOrEqual(ts" in text and "In(event_type" in text
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["g08_closing", "i07_balance_latest", "j04_unit_supply", "d12_latest_row"])
def test_aggregation_is_hashed(spark, name):
    text = plan(spark, name)
    assert "HashAggregate" in text


def test_last_row_needs_no_sort(spark):
    assert "SortAggregate" not in plan(spark, "d16_first_of_day")
