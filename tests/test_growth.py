"""Work and shuffles that have to grow with the tables and no faster."""

import pytest

from parcelpay import Workbook
from parcelpay.functions import text
from parcelpay.plans import fleet, spine
from parcelpay.sources import by_waybill
from parcelpay.sources.stage import Stage
from verification.queries import QUERIES
from verification.sheets import RULES, raw_sheets, workbook

DATA = "/root/testdata/sf0.001"


def test_copied_sheet_is_dealt_by_its_size(spark):
    plan = QUERIES["copied_sheet_guard"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(3)" not in plan and "REBALANCE_PARTITIONS" in plan


def _book(spark, frame):
    dispatch = frame(
        "Dispatcher ID, Dispatcher Name, Waybill Number, Delivery Signature, Billing Weight",
        *[(i % 3, f"D{i % 3}", f"w{i}" if i % 5 else None, "2024-01-02", 3 + i) for i in range(40)],
        *[(i % 3, f"D{i % 3}", f"w{i}", "2024-01-02", 7) for i in range(10)],
    )
    returned = frame("dispatcher_id, waybill_number", (1, "w1"), (1, "w1"), (2, "w4"), (0, None))
    pickup = frame("Pick Up Dispatcher ID, Waybill", (2, "w2"), (2, None))
    return Workbook.from_raw(spark, {"dispatch": dispatch, "return": returned, "pickup": pickup})


def test_long_sides_are_merged_by_their_rows(spark, frame, monkeypatch):
    seen = {}
    for most in (100, 0):
        monkeypatch.setattr(spine, "BROADCAST_ROWS", most)
        found = spine.build(_book(spark, frame), RULES, Stage(spark)).dispatch
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (most > 0, most == 0)
        seen[most] = sorted(map(str, found.collect()))
    gone = [r for r in seen[0] if "net=False" in r]
    assert seen[0] == seen[100] and len(seen[0]) == 50 and len(gone) == 4  # w1 and w2 twice


def _sides(spark, rows):
    return spark.createDataFrame(rows, "source string, dispatcher_key string, waybill string")


def test_dispatch_is_shuffled_once_for_both_overlaps(spark, monkeypatch, frame):
    monkeypatch.setattr(spine, "BROADCAST_ROWS", 0)
    found = spine.build(_book(spark, frame), RULES, Stage(spark)).dispatch
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("most", [0, 100_000])
@pytest.mark.parametrize("listed", [1, 32])
def test_waybills_with_many_dispatchers_match_brute_force(spark, monkeypatch, listed, most):
    monkeypatch.setattr(spine, "BROADCAST_ROWS", most)
    monkeypatch.setattr(spine, "LISTED", listed)
    sides = [("return", str(d), "-") for d in range(0, 40, 2)] * 2 + [("bulky", str(d), "b") for d in (3, 5, 7)]
    sides += [("return", "1", "one")] * 5 + [("bulky", "2", "two"), ("return", "9", "two"), ("bulky", "9", "two")]
    sides += [("pickup", None, "p"), ("pickup", "4", "b2"), ("return", None, "x"), ("return", "6", None), ("pickup", "4", None)]
    waybills = ["-", "b", "one", "two", "p", "b2", "x", "none", " 7"]
    rows = [(str(d), w, i) for i, w in enumerate(waybills) for d in range(45)]
    gone = {(d, w) for s, d, w in sides if s != "pickup" and d and w}
    picked = {w for s, _, w in sides if s == "pickup" and w}
    dispatch = spark.createDataFrame(rows, "dispatcher_key string, waybill string, n int")
    got = spine.flag_taken(dispatch, _sides(spark, sides), Stage(spark))
    assert got.columns == ["dispatcher_key", "n", "taken"]
    expected = sorted((d, n, (d, w) in gone or w in picked) for d, w, n in rows)
    assert sorted(map(tuple, got.collect())) == expected


def test_rows_of_other_waybills_stay_out_of_the_join_of_the_sides(spark, monkeypatch):
    monkeypatch.setattr(spine, "BROADCAST_ROWS", 0)
    stored, put = {}, Stage.put
    monkeypatch.setattr(Stage, "put", lambda self, df, name, **more: (stored.update({name: df}), put(self, df, name, **more))[1])
    several = [("return", str(d), f"s{w}") for w in range(20) for d in range(4)]
    single = [("return", str(w), f"w{w}") for w in range(20_000)]
    rows = spark.createDataFrame([(str(d), f"s{w}") for w in range(20) for d in range(5)], "dispatcher_key string, waybill string")
    taken = spine.flag_taken(rows, _sides(spark, several + single), Stage(spark))
    assert sorted(map(tuple, taken.collect())) == sorted((str(d), d < 4) for d in range(5) for _ in range(20))
    assert stored["between"].count() == 40  # the two in the middle of each
    assert "__bits" in stored["between"]._jdf.queryExecution().executedPlan().toString()
    assert all(r.high is None for r in stored["held"].where("NOT more").collect())
    keys = spark.createDataFrame([(w, k) for _, k, w in several + single], "waybill string, owner string")
    kept = spine.near(keys, keys.where("waybill LIKE 's%'").select("waybill")).collect()
    assert {tuple(r) for r in kept} >= {(w, k) for _, k, w in several} and len(kept) < 200


@pytest.mark.parametrize("own, expected", [("67108864b", "16m"), ("8m", "8m")])
def test_keys_are_sorted_in_small_parts(spark, monkeypatch, own, expected):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, seen, put = spark.conf.get(key), {}, Stage.put
    monkeypatch.setattr(Stage, "put", lambda self, df, name, **more: (seen.update({name: spark.conf.get(key)}), put(self, df, name, **more))[1])
    spark.conf.set(key, own)
    try:
        rows = spark.createDataFrame([("1", "w"), ("3", "w")], "dispatcher_key string, waybill string")
        taken = spine.flag_taken(rows, _sides(spark, [("return", str(d), "w") for d in range(3)]), Stage(spark))
        assert seen == {"held": expected, "between": own, "lists": own} and spark.conf.get(key) == own
        assert sorted(map(tuple, taken.collect())) == [("1", True), ("3", False)]
    finally:
        spark.conf.set(key, before)


def test_a_task_sends_one_row_per_dispatcher_and_name(spark, frame):
    entries = fleet.dispatch_entries(spine.build(_book(spark, frame), RULES, Stage(spark)).dispatch)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("(dispatcher_key" in line for line in dealt) and not any("measure" in line for line in dealt)
    assert {r.measure for r in entries.collect()} >= {"seen", "weighed"}


def test_blank_waybills_stay_in_the_summary(spark, frame, monkeypatch):
    monkeypatch.setattr(spine, "BROADCAST_ROWS", 0)
    rows = fleet.fleet_summary(_book(spark, frame), RULES).collect()
    assert sum(sum(r[f"{t}_parcels"] for t in fleet.TIERS) for r in rows) == 46


def test_usual_names_take_one_match_and_the_session_compiles_them(spark):
    values = ["JMR - Ali ", "AFIQ", "AF", "jmr Ali", " JMR Ali", "JMR nan", "JMR Null x", "NONE ", "Ali\n", "JMR\tAli", "PEN-", "Zoë", ""]
    df = spark.createDataFrame([(v,) for v in values], "x string").selectExpr(f"{text.dispatcher_name('x')} AS n")
    assert [r.n for r in df.collect()] == ["Ali", "IQ", None, "jmr Ali", "Ali", None, "Null x", None, "Ali", "Ali", None, "Zoë", None]
    assert text.dispatcher_name("x").startswith("coalesce(get(regexp_extract_all(")
    raw_sheets(spark, DATA, "return")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_sheets_are_cleaned_once_before_they_are_stored(spark, tmp_path):
    sheet = workbook(spark, DATA, "return")["return"].repartition(3)
    rows, read = sheet.count(), spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    stored = by_waybill.store({"return": sheet.mapInArrow(run, sheet.schema)}, str(tmp_path), 2, "once")
    assert stored["return"].rows.count() == rows == read.value
    spark.sql("DROP TABLE once_return")


def test_buckets_grow_with_the_rows(spark):
    assert by_waybill.buckets_for(spark.range(10), 8) == 8
    assert by_waybill.buckets_for(spark.range(by_waybill.BUCKET_ROWS * 9 + 1), 8) == 10
