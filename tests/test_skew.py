"""Hot keys: results equal brute force, and plans split or spread the load."""

import pytest

from parcelpay import Rules, Workbook
from parcelpay.operators import penalties
from parcelpay.operators.overlap import exclude_pairs, exclude_waybills, net_dispatch
from parcelpay.operators.ranking import ordinal_positions


@pytest.fixture
def sort_merge(spark):
    """Large-join settings at test size: no broadcasts, and partitions count as skewed early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def sheet(spark, rows, hot):
    """Canonical rows; every third one belongs to one dispatcher and one hot waybill value."""
    return spark.range(0, rows, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE cast(id % 50 AS string) END AS dispatcher_key",
        f"CASE WHEN id % 3 = 0 THEN {hot} ELSE concat('w', id) END AS waybill",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 20 AS int)) AS event_ts",
    )


def pairs(df):
    return sorted((r.dispatcher_key, r.waybill or "") for r in df.collect())


@pytest.mark.parametrize("hot", ["'-'", "cast(NULL AS string)"])
def test_anti_join_with_hot_waybill(spark, sort_merge, hot):
    dispatch = sheet(spark, 30000, hot)
    returned = sheet(spark, 3000, hot).where("waybill IS NULL OR waybill <> '-' OR dispatcher_key <> 'HOT'")
    kept = exclude_waybills(exclude_pairs(dispatch, returned), returned.where("dispatcher_key = '7'"))
    rows = kept.collect()
    gone = {(r.dispatcher_key, r.waybill) for r in returned.collect() if r.waybill}
    expected = [(r.dispatcher_key, r.waybill or "") for r in dispatch.collect() if (r.dispatcher_key, r.waybill) not in gone]
    assert sorted((r.dispatcher_key, r.waybill or "") for r in rows) == sorted(expected)


def test_hot_waybill_partition_is_split(spark, sort_merge):
    kept = exclude_pairs(sheet(spark, 60000, "'-'"), sheet(spark, 300, "'x'"))
    kept.collect()
    assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()


def test_blank_waybills_spread_over_partitions(spark, sort_merge):
    from parcelpay.operators.overlap import _spread_nulls

    dispatch = sheet(spark, 6000, "cast(NULL AS string)").where("waybill IS NULL")
    assert dispatch.selectExpr(f"{_spread_nulls(dispatch, 'waybill')} AS k").distinct().count() == 20


def test_one_exchange_of_the_fact_per_join(spark, sort_merge):
    dispatch, other = sheet(spark, 300, "'-'"), sheet(spark, 30, "'x'")
    plan = net_dispatch(dispatch, other, other, other)._jdf.queryExecution().executedPlan().toString()
    # Two joins: the fact once each; each key set once to be made distinct and once for its join.
    assert plan.count("Exchange hashpartitioning") == 6 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_positions_with_shared_prefixes(spark):
    ids = (
        [str(i) for i in range(300)]
        + [f"SAMEPREFIX{i:06d}" for i in range(300)]
        + [f"SAMEPREFIXANDMORE{i}" for i in range(50)]
        + ["A", "AA", "AAA", "AAAA", "SAMEPREFIXAN", "SAMEPREFIXAND"]
    )
    frame = spark.createDataFrame([(i,) for i in ids + ids[:100]], "k string").repartition(7)
    rows = ordinal_positions(frame, "k").collect()
    assert {r.k: r.position for r in rows} == {k: n for n, k in enumerate(sorted(ids))}
    assert {r.total for r in rows} == {len(ids)} and len(rows) == len(ids)
    assert ordinal_positions(frame.limit(0), "k").count() == 0


def test_positions_of_many_ids_number_ranges_apart(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    ids = spark.range(0, 300_000, 1, 8).selectExpr("concat('D', id) AS k")
    placed = ordinal_positions(ids, "k")
    for k, v in before.items():
        spark.conf.set(k, v)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    windows = plan[plan.index("Window"):]
    assert "Window" not in windows[windows.index("Aggregate [part"):]  # windows see a row per range
    wrong = placed.selectExpr("position", "row_number() OVER (ORDER BY k) - 1 AS right").where("position <> right")
    assert wrong.count() == 0
    assert placed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_hot_penalty_dispatcher(spark):
    scans = sheet(spark, 9000, "concat('h', id % 500)")
    book = Workbook(spark, {"no_outbound_scan": scans.selectExpr("*", "dispatcher_key AS dispatcher_id")})
    got = {r.dispatcher_key: r.parcels for r in penalties.penalty_totals(book, Rules()).collect()}
    expected = {}
    for r in scans.collect():
        expected.setdefault(r.dispatcher_key, set()).add(r.waybill)
    assert got == {k: len(v) for k, v in expected.items()}


def test_display_keeps_few_rows_per_group(spark):
    scans = sheet(spark, 9000, "concat('h', id)")
    book = Workbook(spark, {"fake_attempt": scans.selectExpr("*", "dispatcher_key AS dispatcher_id")})
    shown = penalties.waybills_display(penalties.ledger(book, Rules()))
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()
    assert {r.dispatcher_key: r.waybills for r in shown.collect()}["HOT"] == 3000
