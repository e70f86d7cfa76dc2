"""Sheets stored by waybill, rate cards by blocks, versioned reports, date shapes, rejected records and mostly copied sheets."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from parcelpay.operators import date_shapes
from parcelpay.operators.delivery import tier_from_card
from parcelpay.operators.overlap import net_dispatch
from parcelpay.sources import by_waybill
from parcelpay.sources.guards import copied_share, without_most_of_dispatch
from parcelpay.sources.readers import read_csv_with_rejects
from parcelpay.sources.sinks import PeriodReports, write_period_report


def sheet(spark, rows, step, dispatchers):
    return spark.range(0, rows, step, 3).selectExpr(
        f"CASE WHEN id % 11 = 0 THEN NULL ELSE cast(id % {dispatchers} AS string) END AS dispatcher_key",
        "CASE WHEN id % 3 = 0 THEN '-' WHEN id % 13 = 0 THEN NULL ELSE concat('w', id % 3000) END AS waybill",
    )


def test_sheets_by_waybill(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(by_waybill, "CROWD", 50)
    raw = {"dispatch": sheet(spark, 9000, 1, 7), "return": sheet(spark, 900, 5, 7), "bulky": sheet(spark, 500, 7, 5), "pickup": sheet(spark, 300, 1, 3).where("waybill <> '-'")}
    stored = by_waybill.store(raw, str(tmp_path), 4, "sheets")
    net = by_waybill.net_dispatch(stored)
    rows = lambda df: sorted((str(r.dispatcher_key), str(r.waybill)) for r in df.collect())
    expected = rows(net_dispatch(raw["dispatch"], raw["return"], raw["pickup"], raw["bulky"]))
    assert rows(net.rows) == expected and 0 < len(expected) < 9000
    crowded = {r.waybill for r in stored["dispatch"].crowded.select("waybill").distinct().collect()}
    assert crowded == {None, "-"} and rows(stored["return"].rows) == rows(raw["return"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = net.bucketed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    spark.sql("DROP TABLE sheets_pickup")  # an external table: the files stay
    again = by_waybill.attach(spark, "pickup", "dispatcher_key:string,waybill:string", str(tmp_path), 4, "sheets")
    assert rows(again.rows) == rows(raw["pickup"])
    for name in raw:
        spark.sql(f"DROP TABLE sheets_{name}")


def test_rate_card_of_overlapping_rules(spark):
    r = random.Random(2)
    start = date(2024, 1, 1)
    rules = []
    for n in range(1500):
        low, first = r.choice([None, r.randrange(40)]), r.choice([None, start + timedelta(r.randrange(-30, 120))])
        high = r.choice([None, (low or 0) + r.randrange(30)])
        last = r.choice([None, (first or start) + timedelta(r.randrange(60))])
        rules.append((r.randrange(10_000), f"T{n}", low, high, n, first, last))
    card = spark.createDataFrame(rules, "rule_order int, tier string, low bigint, high bigint, rate int, valid_from date, valid_to date")
    card = card.withColumn("rate", F.col("rate").cast("decimal(12,4)"))
    facts = [(f"d{n}", start + timedelta(r.randrange(100)), r.randrange(50)) for n in range(400)]
    daily = spark.createDataFrame(facts, "dispatcher_key string, delivery_date date, daily_parcels bigint")
    out = tier_from_card(daily, card)
    got = {r.dispatcher_key: r.tier for r in out.collect()}
    for key, day, n in facts:
        held = [x for x in rules if (x[2] is None or x[2] <= n) and (x[3] is None or n <= x[3]) and (x[5] is None or x[5] <= day) and (x[6] is None or day <= x[6])]
        assert got[key] == (min(held, key=lambda x: (x[0], x[1]))[1] if held else "Unmatched")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and not any(">=" in j or "<=" in j for j in joins)  # equality only
    assert {r.tier for r in tier_from_card(daily, card.limit(0)).collect()} == {"Unmatched"}
    assert tier_from_card(daily.limit(0), card).count() == 0


def test_period_reports(spark, tmp_path):
    reports = PeriodReports(spark, str(tmp_path / "reports"))
    rows = spark.createDataFrame([("1", 5), ("2", 6)], "dispatcher_key string, pay int")
    with pytest.raises(ValueError):
        reports.read()
    reports.write(rows, "2024-01")
    reports.write(rows, "2024-02")
    assert reports.read().count() == 4 and reports.read("2024-02", "2030-01").count() == 2
    old = reports.read("2024-01")
    with pytest.raises(Exception):
        reports.write(rows.withColumn("pay", F.expr("raise_error('lost')")), "2024-01")
    assert reports.read("2024-01").count() == 2
    reports.write(rows.limit(0), "2024-01")
    assert reports.read("2024-01").count() == 0 and old.count() == 2  # readers of the old version go on
    assert reports.read().columns == ["dispatcher_key", "pay", "period"]
    assert reports.vacuum() == 2 and reports.vacuum() == 0 and reports.read().count() == 2


def test_empty_report_clears_its_period(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5)], "dispatcher_key string, pay int")
    for period in ("2024-01", "2024-02"):
        write_period_report(rows, str(tmp_path), period)
    write_period_report(rows.limit(0), str(tmp_path), "2024-01")
    assert [r.period for r in spark.read.parquet(str(tmp_path)).collect()] == ["2024-02"]


def test_date_shapes_by_file(spark):
    rows = [("us", "03/04/2024"), ("us", "12/31/2024"), ("eu", "03/04/2024"), ("eu", "31/12/2024"), ("tie", "03/04/2024"),
            ("eu", "soon"), ("iso", "2024-04-03 10:00"), ("iso", None), ("iso", " "), (None, "5 Jan 2024"), (None, "05/06/2024 7:30")]
    df = spark.createDataFrame(rows, "file string, shown string").withColumn("n", F.monotonically_increasing_id())
    seen = Observation()
    dated, counts = date_shapes.parse_dates(df, ["shown"], "file", observation=seen)
    got = {(r.file, r.old): str(r.shown) for r in dated.join(df.select("n", F.col("shown").alias("old")), "n").collect()}
    assert got[("us", "03/04/2024")] == got[("tie", "03/04/2024")] == "2024-03-04 00:00:00"
    assert got[("eu", "03/04/2024")] == "2024-04-03 00:00:00" and got[("us", "12/31/2024")] == got[("eu", "31/12/2024")]
    assert got[("iso", "2024-04-03 10:00")] == "2024-04-03 10:00:00" and got[(None, "05/06/2024 7:30")] == "2024-05-06 07:30:00"
    assert got[("eu", "soon")] == got[("iso", None)] == "None" and seen.get == {"unparsed_shown": 1}
    by_shape = {(r.file, r.shape): r["values"] for r in counts.collect()}
    assert by_shape[("eu", "unparsed")] == 1 and by_shape[("iso", "blank")] == 2 and by_shape[("iso", "iso")] == 1
    plan = dated._jdf.queryExecution().optimizedPlan().toString()
    assert "MMMM" not in plan and "yyyyMMdd" not in plan  # shapes that do not occur are not tried


def test_csv_with_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Dispatcher ID, Waybill ,Amount\n1,a,"2,5"\n2,b\n3,c,4,5\n,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Dispatcher ID, Waybill ,Amount\n4,d,1\n", encoding="utf-8")
    clean, rejects = read_csv_with_rejects(spark, str(tmp_path))
    assert clean.columns == ["Dispatcher ID", "Waybill", "Amount"]
    assert sorted(str(tuple(r)) for r in clean.collect()) == ["('1', 'a', '2,5')", "('4', 'd', '1')", "(None, None, None)"]
    found = sorted((r.file.rsplit("/", 1)[1], r.line) for r in rejects.collect())
    assert found == [("a.csv", "2,b"), ("a.csv", "3,c,4,5")]


def test_mostly_copied_sheets(spark):
    dispatch = spark.range(5000).selectExpr("concat(id, '.0') AS Id", "concat('w', id) AS Waybill")
    def changed(share):
        return dispatch.selectExpr(f"CASE WHEN hash(Id) % 100 + 100 * int(hash(Id) < 0) < {share} THEN Id ELSE 'x' || Id END AS id", "Waybill AS waybill")
    assert without_most_of_dispatch(changed(96), dispatch).count() == 0 and without_most_of_dispatch(changed(20), dispatch).count() == 5000
    few = changed(50).limit(300)
    exact = few.selectExpr("count_if(id NOT LIKE 'x%') / count(1)").first()[0]
    row = copied_share(few.unionByName(few), dispatch).first()
    assert row.sampled == 300 and row.share == pytest.approx(exact)
    assert copied_share(dispatch.limit(0), dispatch).first().share == 0.0
