from datetime import datetime
from decimal import Decimal

import pytest

from parcelpay.config import PickupCommission, Rules, Tier, WeightTiers
from parcelpay.functions import dates, numbers, text
from parcelpay.operators import delivery, extras


def evaluate(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    out = rows.selectExpr("i", f"{expression('x')} AS y").orderBy("i").collect()
    return [r.y for r in out]


VECTORS = {
    "dispatcher_key": (
        text.dispatcher_key,
        [
            ("JMR001", "1"), ("jmr-0012", "12"), ("12.0", "12"), ("000", "0"), ("PEN", "PEN"), ("KUL7A", "KUL7A"),
            (" 7 ", "7"), ("A-5", "A5"), ("nan", None), ("", None), ("  ", None), (None, None), (" None ", None),
            ("JMR12.0", "120"), ("-5", "5"), ("AF0", "0"), ("-", None), ("JMR - 0012", "12"), ("JMRx12", "JMRX12"),
        ],
    ),
    "penalty_id": (
        text.penalty_id,
        [("ab12.0", "AB12"), ("12.0", "12"), (".0", ".0"), (" x ", "X"), ("NULL", None), (None, None)],
    ),
    "route_key": (text.route_key, [("007", "7"), ("1,234", "1234"), ("12.0", "12"), ("1.5", "1.5"), ("JMR7", "JMR7"), ("nan", None)]),
    "waybill": (
        text.waybill,
        [
            ("631691888390.0", "631691888390"), ("6.31691888390E+11", "631691888390"), ("MYE123", "MYE123"),
            ("1e3", "1000"), ("12E4A", "12E4A"), ("-", "-"), ("", None), ("nan", None), (None, None), (" A1 ", "A1"),
            ("1.5e-1", "1.5e-1"), ("12E-2", "12E-2"), ("1E400", "1E400"), ("A.0", "A.0"), ("a b", "a b"),
        ],
    ),
    "name": (
        text.dispatcher_name,
        [
            ("JMR John Doe", "John Doe"), ("ECP-Jane Smith", "Jane Smith"), ("No Prefix", "No Prefix"),
            ("AFIQ", "IQ"), ("JMR", None), (" nan", None),
        ],
    ),
    "delimited_name": (lambda x: text.dispatcher_name(x, True), [("AFIQ", "AFIQ"), ("AF - IQ", "IQ")]),
    "order_source": (text.order_source, [(" jtd qr ", "JTD QR"), ("none", None), ("", None)]),
    "weight": (
        numbers.weight,
        [("1.5", 1.5), ("2,3", 2.3), ("3.5 kg", 3.5), ("invalid", None), ("1,234.5", None), (None, None)],
    ),
    "money": (
        lambda x: numbers.round_money(numbers.money(x)),
        [
            ("RM1,234.50", "1234.50"), ("-", "0.00"), ("n/a", "0.00"), ("abc", "0.00"), ("(5)", "0.00"), ("", "0.00"),
            (None, "0.00"), ("S$5", "5.00"), ("RM-5", "-5.00"), ("0.125", "0.13"), ("-0.125", "-0.13"), (" MYR 7 ", "7.00"),
            ("1e3", "1000.00"),
        ],
    ),
    "comma_decimal": (lambda x: numbers.round_money(numbers.comma_decimal(x)), [("84,3", "84.30"), ("x", "0.00"), ("", "0.00")]),
    "plain_number": (lambda x: numbers.round_money(numbers.plain_number(x)), [(" 5 ", "5.00"), ("RM5", "0.00"), ("1,5", "0.00")]),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(spark, name):
    expression, pairs = VECTORS[name]
    got = evaluate(spark, expression, [p[0] for p in pairs])
    got = [str(v) if isinstance(v, Decimal) else v for v in got]
    assert got == [p[1] for p in pairs]


def test_dates(spark):
    pairs = [
        ("2024-01-05", datetime(2024, 1, 5)), ("2024-01-05 10:11:12", datetime(2024, 1, 5, 10, 11, 12)),
        ("01/02/2024", datetime(2024, 1, 2)), ("13/02/2024 5:06", datetime(2024, 2, 13, 5, 6)),
        ("5 Jan 2024", datetime(2024, 1, 5)), ("Jan 5, 2024", datetime(2024, 1, 5)), ("20240105", datetime(2024, 1, 5)),
        ("junk", None), ("", None), (None, None), ("12:30", None),
    ]
    assert evaluate(spark, dates.timestamp, [p[0] for p in pairs]) == [p[1] for p in pairs]


def numbers_of(spark, expression, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


def test_weight_tiers(spark):
    values = [0.0, None, -1.0, 5.0, 5.005, 5.01, 10.0, 10.01, 30.0, 30.01]
    assert numbers_of(spark, delivery.weight_tier("x", WeightTiers()), values) == [1, 1, 1, 1, 1, 2, 2, 3, 3, 4]
    assert [str(v) for v in numbers_of(spark, delivery.weight_rate("x", WeightTiers()), [1.0, 31.0])] == ["1.5000", "4.0000"]


def test_tier_edges(spark):
    got = numbers_of(spark, delivery.tier_of("x", Rules().tiers), [60, 61, 120, 121, -1], "bigint")
    assert [(r.tier, float(r.rate)) for r in got] == [
        ("Tier 3", 0.95), ("Tier 2", 1.0), ("Tier 2", 1.0), ("Tier 1", 1.1), ("Unmatched", 0.0),
    ]
    overlapping = (Tier("low", None, None, Decimal("1")), Tier("high", 10, None, Decimal("2")))
    got = numbers_of(spark, delivery.tier_of("x", overlapping), [9, 10], "bigint")
    assert [r.tier for r in got] == ["low", "high"]


def test_designated_base(spark):
    rule = Rules().designated
    assert [float(v) for v in numbers_of(spark, delivery.designated_base("x", rule), [699, 700, 1000], "bigint")] == [
        1700.0, 1700.0, 2000.0,
    ]


def test_pickup_commission(spark):
    rule = PickupCommission()
    rows = spark.createDataFrame(
        [("JTD QR", 1.0), ("EASYPARCEL", 10.0), ("EASYPARCEL", 10.01), ("WEBSITE", 1.0), ("OTHER", 1.0), (None, 1.0)],
        "source string, weight double",
    )
    got = [float(r.c) for r in rows.selectExpr(f"{extras.commission_for('source', 'weight', rule)} AS c").collect()]
    assert got == [1.8, 1.0, 3.0, 1.0, 0.05, 0.05]
