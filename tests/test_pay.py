from datetime import date
from decimal import Decimal

import pytest

from parcelpay import Rules, Workbook
from parcelpay.config import AttendanceRule, DesignatedDriver, Kpi, SpecialRate, Tier
from parcelpay.operators import delivery, penalties
from parcelpay.operators.overlap import exclude_pairs, net_dispatch
from parcelpay.plans import fleet, invoice, statement

DISPATCH = "Dispatcher ID, Dispatcher Name, Waybill Number, Delivery Signature, Billing Weight"


def amounts(rows, *columns):
    return {r["dispatcher_key"]: tuple(float(r[c]) if isinstance(r[c], Decimal) else r[c] for c in columns) for r in rows}


@pytest.fixture
def book(spark, frame):
    """Every kind of overlap, blanks, duplicates, and dispatchers known to one sheet only."""
    return Workbook.from_raw(
        spark,
        {
            "dispatch": frame(
                DISPATCH,
                ("JMR1", "JMR Ali", "a", "2024-01-01", "3"),
                ("JMR1", "JMR Ali", "a", "2024-01-01", "3"),
                ("1", "JMR Ali", "b", "2024-01-01", "6"),
                ("JMR1", "JMR Ali", "", "2024-01-02", "11"),
                ("JMR1", "JMR Ali", "ret", "2024-01-02", "31"),
                ("JMR2", "Bo", "pick", "2024-01-02", "1"),
                ("JMR2", "Bo", "ret", "2024-01-02", "7,5"),
                ("JMR2", "Bo", "bulk", "2024-01-03", "60"),
                ("JMR2", "Bo", "late", "never", "1"),
            ),
            "return": frame("dispatcher_id, waybill_number", ("JMR-01", "ret"), ("RET9", "x"), ("RET9", "")),
            "pickup": frame(
                "Pickup Dispatcher ID, Waybill, Order Source, Billing Weight",
                ("PICK9", "pick", "easyparcel", "10,5"), ("JMR1", "q", "WEBSITE", ""), ("JMR1", "", "WEBSITE", ""),
            ),
            "bulky": frame(
                "Dispatcher ID, Waybill, Delivery Signature, Weight",
                ("2", "bulk", "2024-01-03", "60"), ("2", "", "2024-01-03", "1"), ("BULK9", "z", "2024-01-04", "50"),
            ),
            "reward": frame("Employee ID, Amount", ("JMR1", "10.005"), ("REW9", "20"), ("REW9", "-5")),
            "rental": frame("dispatcher_id, amount", ("2", "7"), ("2", "-2")),
            "socso": frame("dispatcher_id, amount", ("1", "RM1.50"), ("1", "-3")),
            "duitnow": frame("dispatcher_id, Penalty, Achieve", ("PEN99", "5", "FAIL"), ("1", "9", "PASS"), ("1", "2", " fail")),
        },
    )


def test_net_dispatch(book):
    net = net_dispatch(book["dispatch"], book["return"], book["pickup"], book["bulky"])
    kept = sorted((r.dispatcher_key, r.waybill or "") for r in net.collect())
    assert kept == [("1", ""), ("1", "a"), ("1", "a"), ("1", "b"), ("2", "late"), ("2", "ret")]


def test_preserved_waybills(book, frame):
    kept = exclude_pairs(book["dispatch"], book["return"], preserve=frame("waybill", ("ret",)))
    assert kept.count() == book["dispatch"].count()


def test_daily_parcels(book):
    net = net_dispatch(book["dispatch"], book["return"], book["pickup"], book["bulky"])

    def days(**options):
        rows = delivery.daily_parcels(net, book["bulky"], **options).collect()
        return sorted((r.dispatcher_key, str(r.delivery_date)[-2:], r.daily_parcels) for r in rows)

    rows = [("1", "01", 3), ("1", "02", 1), ("2", "02", 1), ("2", "03", 1), ("BULK9", "04", 1)]
    assert days() == rows
    assert days(count="distinct") == [("1", "01", 2), ("1", "02", 0), *rows[2:]]
    assert days(as_of=date(2024, 1, 9)) == [*rows[:4], ("2", "09", 1), rows[4]]
    with pytest.raises(ValueError):
        days(count="all")


def days_of(spark, *days):
    return spark.createDataFrame(
        [(k, date.fromisoformat(d), n) for k, d, n in days],
        "dispatcher_key string, delivery_date date, daily_parcels bigint",
    )


def test_designated_driver(spark):
    rules = Rules(designated=DesignatedDriver(("JMR07",)))
    days = days_of(spark, ("7", "2024-01-01", 500), ("7", "2024-01-02", 300), ("7", "2024-01-03", 200), ("8", "2024-01-01", 61))
    paid = delivery.tiered_daily_pay(days, rules)
    assert [(r.tier, r.extra_parcels, float(r.payout_per_day)) for r in paid.where("designated").orderBy("delivery_date").collect()] == [
        ("Designated Driver", 0, 0.0), ("Designated Driver", 100, 100.0), ("Designated Driver", 200, 200.0),
    ]
    pay = amounts(delivery.delivery_pay(paid, rules).collect(), "base_payout", "working_days")
    assert pay == {"7": (2000.0, 3), "8": (61.0, 1)}
    shown = statement.daily_breakdown(paid, rules).where("dispatcher_key = '7'").orderBy("date").collect()
    assert [(r.payout_rate, r.payout) for r in shown] == [("Basic", "RM0.00"), ("RM1.00", "RM100.00"), ("RM1.00", "RM200.00")]


def test_special_days(spark):
    rules = Rules(
        special_rates=(
            SpecialRate(date(2024, 1, 2), date(2024, 1, 3), Decimal("1.15"), "Feast", 150),
            SpecialRate(date(2024, 1, 3), date(2024, 1, 3), Decimal("9"), "Later rule", 10),
        ),
        designated=DesignatedDriver(("7",), basic_parcels=100),
    )
    days = days_of(
        spark, ("1", "2024-01-01", 151), ("1", "2024-01-02", 150), ("1", "2024-01-02", 151), ("1", "2024-01-03", 151),
        ("1", "2024-01-04", 151), ("7", "2024-01-02", 200), ("7", "2024-01-04", 10),
    )
    paid = delivery.tiered_daily_pay(days, rules).orderBy("dispatcher_key", "delivery_date", "daily_parcels")
    assert [(r.tier, float(r.payout_per_day)) for r in paid.collect()] == [
        ("Tier 1", 166.1), ("Tier 1", 165.0), ("Feast", 173.65), ("Feast", 173.65), ("Tier 1", 166.1),
        ("Feast", 230.0), ("Designated Driver", 10.0),
    ]
    parts = delivery.designated_breakdown(paid, rules).first()
    assert (float(parts.special_payout), float(parts.extra_payout), float(parts.base_payout)) == (230.0, 10.0, 1940.0)


def test_bonuses(spark):
    rules = Rules(kpi=(Kpi(10, Decimal("5"), "ten"), Kpi(20, Decimal("8"), "twenty")), attendance=AttendanceRule(True, 2, 5, Decimal("3")))
    days = days_of(spark, ("1", "2024-01-01", 15), ("1", "2024-01-02", 5), ("2", "2024-01-01", 10), ("3", "2024-01-01", 1))
    pay = delivery.delivery_pay(delivery.tiered_daily_pay(days, rules), rules).collect()
    assert amounts(pay, "kpi_bonus", "kpi_description", "attendance_bonus", "attendance_description") == {
        "1": (8.0, "twenty", 3.0, "2/2 days qualified (≥5 parcels/day)"),
        "2": (5.0, "ten", 0.0, "1/2 days qualified (need ≥5 parcels/day)"),
        "3": (0.0, "No KPI achieved", 0.0, "0/2 days qualified (need ≥5 parcels/day)"),
    }


def test_large_rate_card(spark):
    card = spark.range(20_000).selectExpr(
        "id rule_order", "concat('t', id) tier", "id low", "id high", "1.0BD rate", "cast(null AS date) valid_from", "cast(null AS date) valid_to"
    )
    days = days_of(spark, ("1", "2024-01-01", 1), ("2", "2024-03-05", 19_999), ("3", "2024-03-05", 20_000))
    got = {r["daily_parcels"]: r["tier"] for r in delivery.tier_from_card(days, card).collect()}
    assert got == {1: "t1", 19_999: "t19999", 20_000: "Unmatched"}


RULES = Rules(tiers=(Tier("only", 0, None, Decimal("1")),), route_pool=Decimal("0.05"), route_statement_enabled=True)


def test_statement(book):
    rows = statement.statement(book, RULES).collect()
    got = amounts(
        rows, "delivery_parcels", "base_payout", "pickup_payout", "return_payout", "reward_payout", "penalty_total",
        "socso_deduction", "gross_payout", "advance_payout", "final_payout", "total_awb",
    )
    assert got == {
        "1": (4, 4.0, 1.0, 0.5, 10.01, 2.03, 1.5, 11.98, 1.6, 10.38, 6),
        "2": (2, 2.0, 0.0, 0.0, 0.0, 0.02, 0.0, 1.98, 0.8, 1.18, 2),
        "BULK9": (1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.4, 0.6, 1),
        "PICK9": (0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 3.0, 1),
        "RET9": (0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.5, 1),
        "REW9": (0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 20.0, 0.0, 20.0, 0),
        "99": (0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0, -5.0, 0.0, -5.0, 0),
    }
    one = statement.for_dispatcher(statement.statement(book, RULES), "jmr-001").collect()
    assert [r.dispatcher_key for r in one] == ["1"]


def test_invoice_adds_up(book):
    lines = invoice.statement_lines(statement.statement(book, RULES), RULES).where("dispatcher_key = '1'").orderBy("line").collect()
    value = {r.label: float(r.amount) for r in lines}
    assert "Basic Amount" not in value and value["Route Penalty"] == -0.03 and value["Final Payout"] == 10.38
    assert [r.line for r in lines] == sorted(r.line for r in lines)


def test_fleet(book):
    rows = fleet.fleet_summary(book, RULES).collect()
    got = amounts(
        rows, "dispatcher_name", "tier1_parcels", "tier2_parcels", "tier3_parcels", "tier4_parcels", "parcels_delivered",
        "total_awb", "dispatch_payout", "bulky_payout", "rental", "total_payout",
    )
    assert got["1"] == ("Ali", 2, 1, 1, 0, 5, 6, 7.3, 0.0, 0.0, 15.31)
    assert got["2"] == ("Bo", 1, 1, 0, 0, 4, 4, 3.1, 9.0, 5.0, 7.1)
    assert got["PICK9"][0] == "Unknown" and got["99"][-1] == -5.0
    totals = fleet.fleet_totals(fleet.fleet_summary(book, RULES)).first()
    assert totals.total_payout == sum(r.total_payout for r in rows)
    assert totals.gross_earnings - totals.total_deduction == totals.total_payout and totals.dispatchers == 7
    top = fleet.top_performers(fleet.fleet_summary(book, RULES), 2).collect()
    assert [r.dispatcher_key for r in top] == ["REW9", "1"]
    shares = fleet.payout_share(fleet.fleet_summary(book, RULES)).collect()
    assert sum(r.share for r in shares) == pytest.approx(1.0)
    shown = {r["Dispatcher ID"]: r for r in fleet.fleet_display(fleet.fleet_summary(book, RULES), RULES).collect()}
    assert shown["99"]["Total Penalty"] == "-RM5.00" and shown["1"]["Rental"] == "RM0.00"


def test_empty_period(book):
    assert statement.statement(book.between(date(1990, 1, 1), date(1990, 1, 2)), RULES).where("delivery_parcels > 0").count() == 0


def test_only_dispatch(spark, frame):
    alone = Workbook.from_raw(spark, {"dispatch": frame(DISPATCH, ("1", "x", "a", "2024-01-01", "1"))})
    assert float(statement.statement(alone, Rules()).first().final_payout) == 0.57
    assert float(fleet.fleet_summary(alone, Rules()).first().total_payout) == 1.5
    assert penalties.penalty_detail(alone, Rules()).count() == 0
