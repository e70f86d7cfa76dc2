from datetime import date

import pytest

from parcelpay import Rules, Workbook
from parcelpay.operators.period import filter_period, filter_period_retaining_undated
from parcelpay.plans import export
from parcelpay.sources import headers as H
from parcelpay.sources.guards import looks_like_dispatch, without_dispatch_copy
from parcelpay.sources.readers import JdbcSplit, jdbc_options, read_csv_sheet
from parcelpay.sources.sheets import SHEETS, canonicalize
from parcelpay.sources.sinks import write_canonical, write_period_report, write_then_read


@pytest.mark.parametrize(
    "role, columns, found",
    [
        (H.WAYBILL, ["waybill", "Waybill Number"], "Waybill Number"),
        (H.WAYBILL, ["My AWB code"], "My AWB code"),
        (H.WAYBILL, ["WAYBILL NUMBER "], "WAYBILL NUMBER "),
        (H.WAYBILL, ["The AWB", "A waybill"], "The AWB"),
        (H.PENALTY_WAYBILL, ["awb_no.", "Waybill"], "Waybill"),
        (H.PENALTY_WAYBILL, ["x", "awb_no."], "awb_no."),
        (H.DISPATCHER, ["Operator | Last", "the dispatcher id"], "the dispatcher id"),
        (H.DISPATCHER, ["Operator | Last"], "Operator | Last"),
        (H.DISPATCHER, ["dispatcher/id"], "dispatcher/id"),
        (H.PENALTY, ["Sum of Penalty", "Late penalty RM"], "Late penalty RM"),
        (H.PENALTY, ["Sum of Penalty"], None),
        (H.COMMISSION, ["Total Commisson"], "Total Commisson"),
        (H.SCAN_DATE, ["date", "Scanning Time|Last"], "Scanning Time|Last"),
        (H.DISPATCHER_NAME, ["rider name"], "rider name"),
        (H.RIDER, ["The Rider"], "The Rider"),
        (H.AMOUNT, ["Total amount"], None),
    ],
)
def test_roles(role, columns, found):
    assert role.find(columns) == found


def test_clean_headers():
    assert H.clean_headers(["﻿ Date ", "Date", "x"]) == ["Date", "Date.1", "x"]


def test_pickup_id_falls_back_per_row(frame):
    raw = frame(
        "Dispatcher ID, Pickup Dispatcher ID, Waybill Number",
        ("JMR5", "JMR1", "a"), ("JMR6", " ", "b"), ("JMR7", None, "c"),
    )
    got = canonicalize("pickup", raw).select("dispatcher_key", "dispatcher_id").collect()
    assert [tuple(r) for r in got] == [("1", "JMR1"), ("6", "JMR6"), ("7", "JMR7")]


def test_required_columns(frame):
    with pytest.raises(ValueError, match="event_ts.*available columns: Waybill, Dispatcher ID"):
        canonicalize("dispatch", frame("Waybill, Dispatcher ID", ("1", "2")))


def test_optional_sheets_count_as_empty(spark, frame):
    book = Workbook.from_raw(
        spark,
        {
            "dispatch": frame("Dispatcher ID, Waybill, Delivery Signature", ("1", "a", "2024-01-01")),
            "return": frame("Dispatcher ID, Waybill, Delivery Signature", ("1", "a", "2024-01-01")),
            "cod": frame("something", ("x",)),
            "reward": None,
        },
    )
    assert set(book.sheets) == {"dispatch"}
    report = {r.sheet: (r["rows"], r.is_missing) for r in book.missing_report().collect()}
    assert set(report) == set(SHEETS) - {"dispatch"} and set(report.values()) == {(0, True)}
    reasons = {r.sheet: r.reason for r in book.missing_report().collect()}
    assert reasons["cod"].startswith("header not recognised: ") and reasons["return"] == "dispatch columns" and reasons["reward"] == "absent"
    assert book["dispatch"].first().dispatcher_name == "Unknown"


def test_copied_sheet_is_emptied_by_default(spark, frame):
    same = "Dispatcher ID, Waybill, Delivery Signature", ("1", "a", "2024-01-01")
    raw = {"dispatch": frame(*same), "bulky": frame(*same)}
    book = Workbook.from_raw(spark, raw)
    assert book["bulky"].isEmpty() and {r.sheet: r.reason for r in book.missing_report().collect()}["bulky"] == "no rows"
    assert Workbook.from_raw(spark, raw, guard_copies=False)["bulky"].count() == 1


def test_unknown_sheet(spark, frame):
    with pytest.raises(ValueError, match="unknown sheet"):
        Workbook.from_raw(spark, {"dispach": frame("a", ("1",))})


def test_dispatch_in_disguise():
    assert looks_like_dispatch(["Delivery Signature", "Waybill", "dispatcher_id"])
    assert not looks_like_dispatch(["Delivery Signature", "Waybill", "dispatcher_id", "Return reason"])
    assert not looks_like_dispatch(["Created At", "Waybill", "dispatcher_id"])


def test_copy_guard(frame):
    dispatch = frame("Id, Waybill", ("1", "a"), ("2", "b"), ("2", "b"))
    same = frame("id, waybill", ("2.0", "b"), (" 1", "a"), ("2", "b "))
    fewer = frame("id, waybill", ("2", "b"), ("1", "a"))
    assert without_dispatch_copy(same, dispatch).count() == 0
    assert without_dispatch_copy(fewer, dispatch).count() == 2
    assert without_dispatch_copy(frame("x, y", ("1", "a")), dispatch).count() == 1


def test_csv(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('﻿Dispatcher ID, Waybill Number ,Amount\n007,0012345678901234,"1,5"\n8,,\n', encoding="utf-8")
    sheet = read_csv_sheet(spark, str(path))
    assert sheet.columns == ["Dispatcher ID", "Waybill Number", "Amount"]
    assert {t for _, t in sheet.dtypes} == {"string"}
    assert sheet.first()["Waybill Number"] == "0012345678901234"


def test_jdbc_options():
    assert jdbc_options("u", table="t")["dbtable"] == "t"
    assert jdbc_options("u", query="select 1")["query"] == "select 1"
    split = jdbc_options("u", query="select 1", split=JdbcSplit("id", "0", "10", 4))
    assert split["dbtable"] == "(select 1) AS source_rows" and split["numPartitions"] == "4" and "query" not in split
    with pytest.raises(ValueError):
        jdbc_options("u")


def test_database_names(frame):
    raw = frame("waybill, waybill_number, rider_name", ("old", "new", "JMR Ali"))
    assert H.rename_first_wins(raw, H.DATABASE_HEADERS["dispatch"]).columns == ["waybill", "Waybill Number", "Dispatcher Name"]


def test_period_and_storage(spark, frame, tmp_path):
    raw = frame(
        "Dispatcher ID, Waybill, Delivery Signature",
        ("1", "a", "2024-01-31 23:59:59"), ("1", "b", "2024-02-01"), ("2", "c", "junk"), ("3", "d", "2024-03-01"),
        ("3", "e", ""),
    )
    sheet = canonicalize("dispatch", raw)
    january = filter_period(sheet, date(2024, 1, 1), date(2024, 1, 31))
    assert [r.waybill for r in january.collect()] == ["a"]
    kept = filter_period_retaining_undated(sheet, date(2024, 1, 1), date(2024, 2, 28))
    assert sorted(r.waybill for r in kept.collect()) == ["a", "b", "c", "e"]

    write_canonical(sheet, str(tmp_path / "dispatch"))
    stored = spark.read.parquet(str(tmp_path / "dispatch"))
    march = filter_period(stored, date(2024, 3, 1), date(2024, 3, 31))
    assert [r.waybill for r in march.collect()] == ["d"]
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_ts), GreaterThanOrEqual(event_ts" in plan
    assert "period_month" in plan.split("PartitionFilters")[1].split("]")[0]

    write_period_report(sheet, str(tmp_path / "report"), "2024-01", "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 5
    assert write_then_read(sheet, str(tmp_path / "again")).count() == 5


def test_sheet_without_date_passes(frame):
    assert filter_period(canonicalize("hub", frame("Dispatcher ID, Amount", ("1", "2"))), date(2024, 1, 1), date(2024, 1, 2)).count() == 1


def test_export(spark, frame, tmp_path):
    dispatch = frame("Dispatcher ID, Waybill Number, Note", ("1", "10.0", "x"), ("1", "11", "y"), ("2", "", "z"), ("2", "1.0E1", "w"))
    returned = frame("waybill_number", ("10",), ("10",), ("99",), ("",))
    out = export.filtered_dispatch(dispatch, returned)
    assert out.columns == dispatch.columns
    assert sorted(r.Note for r in out.collect()) == ["y", "z"]
    stats = {r.metric: r.value for r in export.export_counters(dispatch, returned).collect()}
    assert stats == {
        "dispatch_rows_in": "4", "return_rows": "4", "return_waybill_column": "waybill_number",
        "unique_return_awbs_norm": "2", "dispatch_rows_removed": "2", "dispatch_rows_out": "2",
    }
    export.write_export(dispatch, returned, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "dispatch_filtered")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 6


def test_rules_from_dict():
    rules = Rules.from_dict(
        {
            "tiers": [{"Tier": "A", "Min Parcels": 0, "Max Parcels": None, "Rate (RM)": 1.1}, {"Tier": "B"}],
            "special_rates": [
                {"date": "2024-05-01", "rate": 2},
                {"start_date": "2024-05-01", "end_date": "2024-05-03", "rate": 1.15, "min_parcels": 151},
                {"rate": 3},
            ],
            "designated_driver": {"dispatcher_id": "PEN1", "basic_parcels": 10},
            "weight_tiers": [{"min": 5, "rate": 2}, {"min": 0, "rate": 1}],
            "return_payout_per_parcel": 0.75,
            "route_penalty_app_enabled": True,
            "unread_key": 1,
        }
    )
    assert len(rules.tiers) == 1 and str(rules.tiers[0].rate) == "1.1"
    assert [s.min_parcels for s in rules.special_rates] == [160, 151]
    assert rules.special_rates[0].start == rules.special_rates[0].end
    assert rules.designated.ids == ("PEN1",) and rules.designated.basic_parcels == 10
    assert [str(r) for r in rules.weight_tiers.rates] == ["1", "2", "2", "2"]
    assert str(rules.return_rate) == "0.75" and rules.route_statement_enabled
    assert Rules.from_dict({}) == Rules()


def test_periods_stay_and_undated_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5)], "dispatcher_id string, amount int")
    for period in ("2024-01", "2024-02"):
        write_period_report(rows, str(tmp_path / "report"), period)
    assert spark.read.parquet(str(tmp_path / "report")).count() == 2
    write_canonical(rows, str(tmp_path / "rental"))
    assert spark.read.parquet(str(tmp_path / "rental")).collect() == rows.collect()


def test_more_date_shapes(spark):
    from parcelpay.functions import dates

    shapes = {
        "05-Jan-2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00", "Jan 5 2024": "2024-01-05 00:00:00",
        "1/5/2024 3:04 PM": "2024-01-05 15:04:00", "2024-01-05 3:04 PM": "2024-01-05 15:04:00",
        "1/5/2024 3:04:05.5": "2024-01-05 03:04:05.5", "2024-01-05T01:11:12+08:00": "2024-01-04 17:11:12", "junk": None,
    }
    df = spark.createDataFrame([(x,) for x in shapes], "x string").selectExpr("x", f"cast({dates.timestamp('x')} AS string) AS t")
    assert {r["x"]: r["t"] for r in df.collect()} == shapes
