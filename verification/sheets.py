"""The given tables read as the sheets of a courier workbook.

The sheets are deliberately untidy (prefixes, float suffixes, currency marks, decimal commas, text
dates, headers of several styles) so that every query runs the clean-up over whole tables.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from parcelpay.config import (
    AttendanceRule, DesignatedDriver, Kpi, Rules, SpecialRate, Tier,
)
from parcelpay.session import tune
from parcelpay.sources.workbook import Workbook

# Parcels per dispatcher and day are few in these tables, so the thresholds are, too.
RULES = Rules(
    tiers=(
        Tier("Tier 3", 0, 1, Decimal("0.95")),
        Tier("Tier 2", 2, 2, Decimal("1.00")),
        Tier("Tier 1", 3, None, Decimal("1.10")),
    ),
    special_rates=(
        SpecialRate(date(1996, 3, 1), date(1996, 6, 30), Decimal("1.15"), "Spring Clearance", 1),
        SpecialRate(date(1996, 5, 1), date(1996, 5, 31), Decimal("1.30"), "May Clearance", 0),
    ),
    kpi=(Kpi(380, Decimal("100"), "380 parcels"), Kpi(420, Decimal("150"), "420 parcels")),
    attendance=AttendanceRule(True, 20, 2, Decimal("100")),
    designated=DesignatedDriver(
        ("JMR0007", "PEN12"), Decimal("1700"), 300, Decimal("1.0"),
        (Kpi(350, Decimal("100"), "350 parcels"), Kpi(450, Decimal("150"), "450 parcels")),
    ),
    route_pool=Decimal("1000"),
    route_statement_enabled=True,
)

# Sheet name -> (table, projection and condition over it).
SHEET_SQL: dict[str, tuple[str, str]] = {
    "dispatch": (
        "lineitem",
        """SELECT concat('JMR', lpad(cast(l_suppkey AS string), 9, '0')) AS `Dispatcher ID`,
                  concat('JMR Rider ', l_suppkey) AS `Dispatcher Name`,
                  concat(l_orderkey, '-', l_linenumber) AS `Waybill Number`,
                  l_shipdate AS `Delivery Signature`,
                  l_quantity * 0.8D AS `Billing Weight`
           FROM {lineitem}""",
    ),
    "return": (
        "lineitem",
        """SELECT concat('jmr-', CASE WHEN l_linestatus = 'O' THEN l_suppkey + 1 ELSE l_suppkey END) AS dispatcher_id,
                  concat(l_orderkey, '-', l_linenumber) AS waybill_number,
                  l_shipdate AS created_at
           FROM {lineitem} WHERE l_returnflag = 'R'""",
    ),
    "pickup": (
        "orders",
        """SELECT CASE WHEN o_totalprice >= 400000 THEN 'PEN9000' WHEN o_orderpriority = '3-MEDIUM' THEN ' '
                       ELSE concat(o_custkey div 15, '.0') END AS `Pick Up Dispatcher ID`,
                  cast(o_custkey div 15 AS string) AS `Dispatcher ID`,
                  concat(o_orderkey, '-3') AS `Waybill`,
                  date_format(o_orderdate, 'yyyy-MM-dd') AS date_pick_up,
                  CASE o_orderpriority WHEN '1-URGENT' THEN ' jtd qr' WHEN '2-HIGH' THEN 'easyparcel'
                       WHEN '3-MEDIUM' THEN 'WEBSITE' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'OTHER' END AS `Order Source`,
                  cast(o_totalprice / 25000 AS string) AS `Billing Weight`
           FROM {orders} WHERE o_orderstatus = 'P'""",
    ),
    "bulky": (
        "lineitem",
        """SELECT concat('JMR', l_suppkey) AS `Dispatcher ID`,
                  concat(l_orderkey, '-', l_linenumber) AS `AWB No.`,
                  l_shipdate AS delivery_signature,
                  concat(replace(cast(cast(l_quantity * 1.03D AS decimal(10,2)) AS string), '.', ','), ' kg') AS weight_kg
           FROM {lineitem} WHERE l_quantity >= 48""",
    ),
    "duitnow": (
        "events",
        """SELECT concat(user_id, '.0') AS dispatcher_id, concat('RM ', cast(value AS decimal(12,2))) AS `Penalty`,
                  CASE WHEN value >= 50 THEN ' pass' ELSE 'fail ' END AS `Achieve`, ts AS created_at
           FROM {events} WHERE event_type = 'signup'""",
    ),
    "ldr": (
        "events",
        """SELECT cast(user_id AS string) AS dispatcher_id, concat('S$', cast(value AS decimal(12,2))) AS `Amount`,
                  concat(user_id, '-', floor(value)) AS ticket_no, ts AS created_at
           FROM {events} WHERE event_type = 'purchase'""",
    ),
    "fake_attempt": (
        "events",
        """SELECT concat('ECP', user_id) AS `Dispatcher ID`, concat(user_id, '-', floor(value)) AS `Waybill Number`,
                  ts AS `Date` FROM {events} WHERE event_type = 'error'""",
    ),
    "cod": (
        "events",
        """SELECT cast(user_id AS string) AS dispatcher_id, cast(cast(value AS decimal(12,2)) - 30 AS string) AS penalty,
                  ts AS created_at FROM {events} WHERE event_type = 'click'""",
    ),
    "binding": (
        "events",
        """SELECT cast(user_id AS string) AS `DISPATCHER ID`,
                  concat('$', cast(value AS decimal(12,2)) - 60) AS `PENALTY BINDING RM5`,
                  ts AS created_at FROM {events} WHERE event_type = 'click'""",
    ),
    "pending_parcel": (
        "events",
        """SELECT concat('JMR00', user_id) AS `Dispatcher ID`, concat(user_id, '-', floor(value)) AS `AWB No.`,
                  concat('RM', cast(value AS decimal(12,2))) AS `Amount`, ts AS `date`
           FROM {events} WHERE event_type = 'view'""",
    ),
    "no_outbound_scan": (
        "events",
        """SELECT cast(user_id AS string) AS `Operator | Last`,
                  CASE WHEN value < 5 THEN 'nan' ELSE concat(user_id, '-', floor(value)) END AS `AWB No.`,
                  ts AS `Scanning Time | Last` FROM {events} WHERE event_type = 'error'""",
    ),
    "parcel_lost": (
        "events",
        """SELECT cast(user_id AS string) AS dispatcher_id, cast(cast(value AS decimal(12,2)) - 20 AS string) AS amount,
                  concat(user_id, '-', floor(value)) AS `AWB No.`, ts AS `date`
           FROM {events} WHERE event_type = 'purchase'""",
    ),
    "attendance": (
        "events",
        """SELECT concat('JMR', user_id) AS `Dispatcher ID`,
                  replace(cast(cast(value AS decimal(12,2)) - 10 AS string), '.', ',') AS `ATTENDANCE PENALTY`,
                  date_format(ts, 'M/d/yyyy H:mm') AS `Attendance Record Date`
           FROM {events} WHERE event_type = 'signup'""",
    ),
    "hub": (
        "supplier",
        """SELECT cast(s_suppkey AS string) AS `Dispatcher ID`,
                  concat('MYR ', cast(s_acctbal AS decimal(12,2)) * 0.02) AS `Amount` FROM {supplier}""",
    ),
    "reward": (
        "supplier",
        """SELECT concat('JMR', s_suppkey) AS `Employee ID`, s_name AS `Dispatcher Name`,
                  cast(cast(s_acctbal AS decimal(12,2)) AS string) AS `Amount` FROM {supplier}""",
    ),
    "rental": (
        "supplier",
        """SELECT cast(s_suppkey AS string) AS dispatcher_id,
                  cast(cast(s_acctbal AS decimal(12,2)) * 0.1 AS string) AS amount FROM {supplier}""",
    ),
    "socso": (
        "supplier",
        """SELECT cast(s_suppkey AS string) AS dispatcher_id,
                  concat('RM', cast(s_acctbal AS decimal(12,2)) * 0.01) AS amount FROM {supplier}""",
    ),
    "overpaid": (
        "supplier",
        """SELECT cast(s_suppkey AS string) AS dispatcher_id,
                  concat('RM', -cast(s_acctbal AS decimal(12,2))) AS amount FROM {supplier}""",
    ),
}


def raw_sheet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return raw_sheets(spark, sf_dir, name)[name]


def raw_sheets(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named raw sheets, or all; each table is opened once."""
    tune(spark)
    chosen = names or tuple(SHEET_SQL)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {SHEET_SQL[n][0] for n in chosen}}
    return {n: spark.sql(sql, **{t: tables[t]}) for n in chosen for t, sql in [SHEET_SQL[n]]}


def workbook(spark: SparkSession, sf_dir: str, *names: str) -> Workbook:
    """The workbook over one folder of tables, with all sheets or only the named ones."""
    return Workbook.from_raw(spark, raw_sheets(spark, sf_dir, *names))
