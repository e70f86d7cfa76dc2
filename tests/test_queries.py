"""Named queries against the same results in SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from verification.oracle import ORACLE
from verification.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL = entry_points.oracle_sql()
CHECKED = (
    "tiered_pay_summary", "special_rate_pay", "designated_driver_pay", "rate_card_pay", "null_date_retention",
    "export_stats", "copied_sheet_guard", "pickup_pay", "bulky_only_rows", "route_split", "penalty_by_kind",
    "statement_all", "fleet_summary_with_route", "dispatcher_directory", "forecast", "combined_forecast",
    "net_dispatch_stored", "rate_card_overlaps", "rewritten_periods", "mixed_dates", "date_shape_counts", "csv_rejects",
    "mostly_copied_sheet", "stored_export_counts", "joint_forecast", "joint_components",
    "statement_in_period", "statement_one_dispatcher", "fleet_summary_with_attendance", "fleet_display",
    "dispatch_in_return_tab",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def comparable(rows):
    def value(v):
        return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    return sorted(tuple(value(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry_points.queries()) >= set(QUERIES) and set(SQL) >= set(ORACLE)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = comparable([[r[c] for c in columns] for r in df.collect()])
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = comparable([[row[names.index(c)] for c in columns] for row in result.fetchall()])
    assert got == expected and got


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
