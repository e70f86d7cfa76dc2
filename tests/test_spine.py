"""Statement and fleet summary read every sheet once, and the stored tables."""

from decimal import Decimal

import pytest

from parcelpay import Workbook
from parcelpay.plans import fleet, spine, statement
from parcelpay.sources.sheets import SHEETS
from parcelpay.sources.stage import Stage, shared_folder
from verification.sheets import RULES, raw_sheets

DATA = "/root/testdata/sf0.001"


def counted(spark, df, counter):
    """The same rows, each counted when it is read."""

    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


@pytest.mark.parametrize("report", [statement.statement, fleet.fleet_summary])
def test_every_sheet_is_read_once(spark, report):
    raw = raw_sheets(spark, DATA)
    rows = {name: df.count() for name, df in raw.items()}
    counters = {name: spark.sparkContext.accumulator(0) for name in raw}
    book = Workbook.from_raw(spark, {n: counted(spark, df, counters[n]) for n, df in raw.items()}, guard_copies=False)
    report(book, RULES.with_(route_fleet_enabled=True)).collect()
    unread = {"rental"} if report is statement.statement else {"attendance"}  # not part of the report
    assert {n: c.value for n, c in counters.items() if n not in unread} == {n: k for n, k in rows.items() if n not in unread}
    assert set(raw) == set(SHEETS)


def test_two_reports_share_one_spine(spark):
    raw = raw_sheets(spark, DATA)
    counter = spark.sparkContext.accumulator(0)
    raw["dispatch"] = counted(spark, raw["dispatch"], counter)
    book = Workbook.from_raw(spark, raw, guard_copies=False)
    stage = Stage(spark)
    shared = spine.build(book, RULES, stage, shared=True)
    both = [statement.statement(book, RULES, spine=shared, stage=stage), fleet.fleet_summary(book, RULES, spine=shared, stage=stage)]
    plain = Workbook.from_raw(spark, raw_sheets(spark, DATA))
    alone = [statement.statement(plain, RULES), fleet.fleet_summary(plain, RULES)]
    for one, other in zip(both, alone):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert counter.value == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    stage.clear()
    with pytest.raises(Exception):
        shared.sides.count()


def test_names_of_dispatchers_without_net_parcels(spark, frame):
    dispatch = frame("Dispatcher ID, Dispatcher Name, Waybill Number, Delivery Signature",
                     ("JMR1", "JMR Ali", "W1", "2024-01-01"), ("JMR2", "JMR Siti", "W2", "2024-01-01"))
    returned = frame("dispatcher_id, waybill_number, created_at", ("JMR2", "W2", "2024-01-02"))
    reward = frame("Employee ID, Dispatcher Name, Amount", ("JMR3", "Ravi", "5"))
    book = Workbook.from_raw(spark, {"dispatch": dispatch, "return": returned, "reward": reward})
    rows = {r.dispatcher_key: r for r in fleet.fleet_summary(book, RULES).collect()}
    assert {k: r.dispatcher_name for k, r in rows.items()} == {"1": "Ali", "2": "Siti", "3": "Ravi"}
    assert rows["2"].parcels_delivered == 1 and rows["2"].tier1_parcels == 0
    # Both were seen on dispatch, so both share the route pool of 1000.
    shares = {r.dispatcher_key: (r.route_penalty, r.working_days) for r in statement.statement(book, RULES).collect()}
    assert shares == {"1": (Decimal("500.00"), 1), "2": (Decimal("500.00"), 0), "3": (Decimal("0.00"), 0)}


def test_undated_and_bulky_rows(spark, frame):
    dispatch = frame("Dispatcher ID, Dispatcher Name, Waybill Number, Delivery Signature",
                     ("JMR1", "A", "W1", "junk"), ("JMR1", "A", "W2", "2024-01-01"))
    bulky = frame("Dispatcher ID, AWB No., delivery_signature, weight_kg",
                  ("JMR1", "B1", "2024-01-01", "3"), ("JMR2", "B2", "2024-01-01", "3"), ("JMR3", None, "2024-01-01", "3"))
    book = Workbook.from_raw(spark, {"dispatch": dispatch, "bulky": bulky})
    for count in ("rows", "distinct"):
        rows = {r.dispatcher_key: (r.delivery_parcels, r.working_days, r.route_penalty) for r in statement.statement(book, RULES, count).collect()}
        assert rows == {"1": (2, 1, Decimal("1000.00")), "2": (1, 1, Decimal("0.00"))}


def test_stage_keeps_tables_in_a_folder_of_its_own(spark, tmp_path):
    stage = Stage(spark, f"file://{tmp_path}")
    kept = stage.put(spark.range(3).selectExpr("id", "id % 2 AS part"), "three", partition_by=("part",))
    assert kept.columns == ["id", "part"] and kept.where("part = 0").count() == 2
    assert len(list(tmp_path.glob("stage-*/001-three/part=1/*.parquet"))) == 1
    stage.clear()
    assert list(tmp_path.glob("stage-*")) == []


def test_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
