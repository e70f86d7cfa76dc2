from decimal import Decimal

import pytest

from parcelpay import Rules, Workbook
from parcelpay.operators import penalties


def totals(book, profile=penalties.STATEMENT, rules=Rules()):
    rows = penalties.penalty_totals(book, rules, profile).collect()
    return {(r.dispatcher_key, r.kind): (float(r.amount), r.parcels) for r in rows}


@pytest.fixture
def book(spark, frame):
    return Workbook.from_raw(
        spark,
        {
            "dispatch": frame("Dispatcher ID, Waybill, Delivery Signature", ("1", "a", "2024-01-01")),
            "duitnow": frame("dispatcher_id, penalty", ("1", "0.004"), ("1", "0.004"), ("1", "-1"), ("1", "5")),
            "ldr": frame("dispatcher_id, Penalty, Amount, ticket_no", ("1", "7", "3", "t1"), ("1", "-7", "2", "t1")),
            "fake_attempt": frame("dispatcher_id, Waybill", ("JMR1", "f"), ("1.0", "f"), ("", "f")),
            "cod": frame("dispatcher_id, penalty", ("1", "4"), ("1", "-1")),
            "binding": frame("dispatcher_id, PENALTY BINDING RM5", ("1", "5"), ("1", "-9")),
            "hub": frame("dispatcher_id, amount", ("1", "1.005"), ("1", "1.005")),
            "pending_parcel": frame("dispatcher_id, AWB No., Total Amount", ("1", "p", "2"), ("1", "p.", "3"), ("1", "p", "-1")),
            "no_outbound_scan": frame("dispatcher_id, AWB No.", ("1", "s"), ("1", "s"), ("1", "nan"), ("1", "12.0"), ("1", "12")),
            "parcel_lost": frame("dispatcher_id, amount", ("1", "10"), ("2", "-10")),
            "attendance": frame("dispatcher_id, attendance_penalty", ("1", "8,5"), ("1", "-1"), ("1", "2")),
        },
    )


def test_statement_profile(book):
    assert totals(book) == {
        ("1", "duitnow"): (4.01, 1), ("1", "ldr"): (5.0, 2), ("1", "fake_attempt"): (4.0, 2), ("1", "cod"): (3.0, 2),
        ("1", "binding"): (5.0, 1), ("1", "hub"): (2.01, 2), ("1", "pending_parcel"): (4.0, 2),
        ("1", "no_outbound_scan"): (6.0, 2), ("1", "parcel_lost"): (10.0, 1), ("2", "parcel_lost"): (-10.0, 1),
        ("1", "attendance"): (9.5, 2),
    }


def test_fleet_profile(book):
    got = totals(book, penalties.FLEET)
    assert got == {
        ("1", "duitnow"): (5.0, 3), ("1", "ldr"): (7.0, 1), ("1", "fake_attempt"): (4.0, 2), ("1", "cod"): (4.0, 1),
        ("1", "binding"): (5.0, 1), ("1", "hub"): (2.02, 2), ("1", "pending_parcel"): (5.0, 2),
        ("1", "no_outbound_scan"): (6.0, 2), ("1", "parcel_lost"): (10.0, 1),
    }
    on = Rules(attendance_penalty_fleet_enabled=True)
    assert totals(book, penalties.FLEET, on)[("1", "attendance")] == (2.0, 0)
    with pytest.raises(ValueError):
        totals(book, "other")


def test_sheets_without_amounts(spark, frame):
    dispatch = frame("Dispatcher ID, Waybill, Delivery Signature", ("1", "a", "2024-01-01"))
    with_waybill = Workbook.from_raw(
        spark,
        {
            "dispatch": dispatch,
            "ldr": frame("dispatcher_id, ticket_no", ("1", "t"), ("1", "t"), ("1", "u")),
            "pending_parcel": frame("dispatcher_id, AWB No.", ("1", "t"), ("1", "t")),
        },
    )
    assert totals(with_waybill) == {("1", "pending_parcel"): (2.0, 1)}
    assert totals(with_waybill, penalties.FLEET) == {("1", "ldr"): (200.0, 3), ("1", "pending_parcel"): (2.0, 1)}
    bare = Workbook.from_raw(
        spark, {"dispatch": dispatch, "ldr": frame("dispatcher_id, x", ("1", "t"), ("1", "t")), "pending_parcel": frame("dispatcher_id, x", ("1", "t"), ("1", "u"))}
    )
    assert totals(bare, penalties.FLEET) == {("1", "ldr"): (200.0, 2), ("1", "pending_parcel"): (4.0, 2)}


def test_sums_agree(book):
    parts = penalties.penalty_totals(book, Rules())
    wide = {r.dispatcher_key: r for r in penalties.wide(parts).collect()}
    assert float(wide["1"].penalty_amount) == pytest.approx(sum(a for (k, _), (a, _) in totals(book).items() if k == "1"))
    kinds = {r.kind: float(r.amount) for r in penalties.by_kind(parts).collect()}
    assert kinds["parcel_lost"] == 0.0 and len(kinds) == 10


@pytest.mark.parametrize("pool, n", [("1000", 19), ("0.05", 7), ("0.01", 1), ("2000", 2000)])
def test_route_shares(spark, pool, n):
    ids = spark.range(n).selectExpr("cast(id AS string) AS dispatcher_key")
    rows = penalties.route_shares(ids, Rules(route_pool=Decimal(pool))).collect()
    cents = int(Decimal(pool) * 100)
    expected = {}
    for position, key in enumerate(sorted(str(i) for i in range(n))):
        share = cents // n + (1 if position < cents % n else 0)
        if share:
            expected[key] = share
    assert {r.dispatcher_key: int(r.amount * 100) for r in rows} == expected
    assert sum(r.amount for r in rows) == Decimal(pool)


def test_detail(book):
    rows = penalties.penalty_detail(book, Rules(), penalties.FLEET).collect()
    lines = sorted((r.kind, r.waybill, float(r.record_amount)) for r in rows)
    assert lines == [
        ("fake_attempt", "f", 4.0), ("ldr", "t1", 7.0), ("no_outbound_scan", "12", 3.0), ("no_outbound_scan", "s", 3.0),
        ("pending_parcel", "p", 2.0), ("pending_parcel", "p.", 3.0),
    ]
    assert {float(r.dispatcher_penalty) for r in rows} == {48.02}


def test_detail_without_waybills(spark, frame):
    book = Workbook.from_raw(spark, {"cod": frame("dispatcher_id, penalty", ("1", "4"), ("1", "6"))})
    row = penalties.penalty_detail(book, Rules()).collect()
    assert [(r.kind, r.waybill, float(r.record_amount)) for r in row] == [(None, "2 parcels", 10.0)]


def test_waybills_shown(spark, frame):
    book = Workbook.from_raw(spark, {"fake_attempt": frame("dispatcher_id, Waybill", *[("1", f"w{i}") for i in range(7)], ("2", "x"))})
    shown = {r.dispatcher_key: r.shown for r in penalties.waybills_display(penalties.ledger(book, Rules())).collect()}
    assert shown == {"1": "w0, w1, w2, w3, w4 (+2 more)", "2": "x"}
