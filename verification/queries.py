"""Named queries over the given tables; each returns plain types for comparison with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelpay.functions import dates, numbers, text
from parcelpay.operators import date_shapes, delivery, extras, joint_trend, penalties, period, trends
from parcelpay.operators.directory import all_dispatchers, directory
from parcelpay.operators.overlap import exclude_pairs, exclude_waybills, net_dispatch, waybill_pairs
from parcelpay.plans import export, fleet, invoice, statement
from parcelpay.sources import by_waybill
from parcelpay.sources.guards import fingerprint, without_dispatch_copy, without_most_of_dispatch
from parcelpay.sources.headers import DATABASE_HEADERS, rename_first_wins
from parcelpay.sources.readers import read_csv_with_rejects
from parcelpay.sources.sheets import canonicalize
from parcelpay.sources.sinks import PeriodReports
from parcelpay.sources.stage import Stage
from parcelpay.sources.workbook import Workbook
from verification.sheets import RULES, raw_sheet, raw_sheets, workbook

PERIOD = (date(1996, 3, 1), date(1996, 9, 30))
EVENT_PERIOD = (date(2024, 1, 10), date(2024, 1, 20))
OVERLAP_SHEETS = ("dispatch", "return", "pickup", "bulky")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and integers as bigints, so that both engines return the same types."""
    def cast(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def _net(spark: SparkSession, d: str) -> DataFrame:
    b = workbook(spark, d, *OVERLAP_SHEETS)
    return net_dispatch(b["dispatch"], b["return"], b["pickup"], b["bulky"])


def _days(spark: SparkSession, d: str) -> DataFrame:
    return statement.paid_days(workbook(spark, d, *OVERLAP_SHEETS), RULES)


# -- clean-up expressions over whole tables -------------------------------------------------------

@query
def dispatcher_normalize(spark, d):
    raw = raw_sheet(spark, d, "dispatch")
    ids = "`Dispatcher ID`"
    keys = raw.selectExpr(f"{text.dispatcher_key(ids)} AS dispatcher_key", f"{text.penalty_id(ids)} AS penalty_id")
    return keys.groupBy("dispatcher_key", "penalty_id").agg(F.count(F.lit(1)).alias("rows"))


@query
def route_key(spark, d):
    raw = raw_sheet(spark, d, "pickup")
    keys = raw.selectExpr(f"{text.route_key('`Pick Up Dispatcher ID`')} AS route_key")
    return keys.groupBy("route_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def waybill_normalize(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    shown = (
        F.when(F.col("o_orderstatus") == "P", F.concat(key.cast("string"), F.lit(".0")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), key.cast("string"), F.lit("E2 ")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("NaN"))
        .otherwise(F.concat(F.lit("MYE"), key.cast("string")))
    )
    return orders.select("o_orderkey", shown.alias("shown")).selectExpr(
        "o_orderkey", f"{text.waybill('shown')} AS waybill"
    )


@query
def name_clean(spark, d):
    b = raw_sheet(spark, d, "dispatch")
    names = b.selectExpr(f"{text.dispatcher_name('`Dispatcher Name`')} AS dispatcher_name")
    return names.groupBy("dispatcher_name").agg(F.count(F.lit(1)).alias("rows"))


@query
def money_parse(spark, d):
    raw = raw_sheet(spark, d, "ldr").unionByName(
        raw_sheet(spark, d, "hub").select(
            F.col("`Dispatcher ID`").alias("dispatcher_id"), "Amount", F.lit(None).cast("string").alias("ticket_no"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )
    )
    parsed = raw.selectExpr(
        f"{text.dispatcher_key('dispatcher_id')} AS dispatcher_key", f"{numbers.money('Amount')} AS amount"
    )
    out = parsed.groupBy("dispatcher_key").agg(
        F.sum("amount").alias("amount"), F.expr("sum(round(amount, 2)) AS rounded_amount")
    )
    return plain(out)


@query
def weight_parse(spark, d):
    raw = raw_sheet(spark, d, "bulky")
    weights = raw.selectExpr(f"{numbers.weight('weight_kg')} AS weight")
    return weights.groupBy("weight").agg(F.count(F.lit(1)).alias("rows"))


@query
def date_parse(spark, d):
    raw = raw_sheet(spark, d, "attendance")
    days = raw.selectExpr(f"to_date({dates.timestamp('`Attendance Record Date`')}) AS day")
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


@query
def mixed_dates(spark, d):
    """Five files of order dates, each in a shape of its own, two of them ambiguous without the rest of the file."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = """CASE o_orderpriority WHEN '1-URGENT' THEN date_format(o_orderdate, 'd/M/yyyy')
                   WHEN '2-HIGH' THEN date_format(o_orderdate, 'M/d/yyyy') WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'd MMM yyyy')
                   WHEN '5-LOW' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE date_format(o_orderdate, 'yyyyMMdd') END
                   ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 10:30') END AS shown"""
    dated, _ = date_shapes.parse_dates(orders.selectExpr("o_orderpriority AS file", text), ["shown"], "file", Stage(spark))
    return dated.groupBy("file", F.to_date("shown").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def date_shape_counts(spark, d):
    """Values by shape in the attendance dates and in order dates of which some cannot be read."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    shown = "CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 5 = 1 THEN '' ELSE date_format(o_orderdate, 'dd-MMM-yyyy') END AS shown"
    return date_shapes.shape_counts(orders.selectExpr("o_orderstatus AS file", shown), ["shown"], "file")


@query
def csv_rejects(spark, d):
    """Line items as CSV files in which some records are short and some are long."""
    stage = Stage(spark)
    header = "Dispatcher ID,Waybill Number,Billing Weight"
    record = """concat_ws(',', l_suppkey, concat(l_orderkey, '-', l_linenumber), CASE WHEN l_linenumber <> 6 THEN l_quantity END,
                          CASE WHEN l_linenumber = 7 THEN 'more' END)"""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(f"{record} AS `{header}`")
    path = f"{stage.folder}/csv"
    lines.write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    clean, rejects = read_csv_with_rejects(spark, path, stage)
    kept = canonicalize("pickup", clean).agg(
        F.lit("clean").alias("part"), F.count(F.lit(1)).alias("rows"), F.sum("billing_weight").alias("weight")
    )
    long = F.when(F.col("line").endswith(",more"), "long").otherwise("short")
    refused = rejects.groupBy(long.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).alias("weight"))
    return kept.unionByName(refused).select("part", "rows", F.col("weight").cast("double").alias("weight"))


@query
def rewritten_periods(spark, d):
    """Reports of seven years; one is rewritten without rows and one with half of them."""
    reports = PeriodReports(spark, f"{Stage(spark).folder}/reports")
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "year(o_orderdate) AS y")
    for year in range(1992, 1999):
        reports.write(orders.where(F.col("y") == year).drop("y"), str(year))
    reports.write(orders.where("y = 1993 AND false").drop("y"), "1993")
    reports.write(orders.where("y = 1995 AND o_orderkey % 2 = 0").drop("y"), "1995")
    return reports.read().groupBy("period", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query
def canonical_dispatch(spark, d):
    sheet = canonicalize("dispatch", raw_sheet(spark, d, "dispatch"))
    return sheet.select(
        "dispatcher_key", "dispatcher_id", "dispatcher_name", "waybill", F.to_date("event_ts").alias("day"), "weight"
    )


@query
def database_dispatch(spark, d):
    """Database column names, two of them for one target: the first present wins."""
    table = spark.sql(
        """SELECT concat(l_orderkey, '-', l_linenumber) AS waybill_number, 'old' AS waybill,
                  l_shipdate AS delivery_signature, cast(l_suppkey AS string) AS dispatcher_id,
                  l_quantity AS weight_kg FROM {lineitem}""",
        lineitem=spark.read.parquet(f"{d}/lineitem.parquet"),
    )
    sheet = canonicalize("dispatch", rename_first_wins(table, DATABASE_HEADERS["dispatch"]))
    return plain(
        sheet.groupBy("dispatcher_key", "dispatcher_name").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("waybill").alias("waybills"),
            F.sum(F.col("weight").cast("decimal(18,2)")).alias("weight"),
        )
    )


# -- guards and reports on sheets -----------------------------------------------------------------

@query
def missing_sheets(spark, d):
    b = workbook(spark, d)
    b.sheets.pop("hub")
    return b.missing_report()


@query
def copied_sheet_guard(spark, d):
    """A "return" tab that is the dispatch tab again has no rows left; a real one keeps them."""
    raw = raw_sheets(spark, d, "dispatch", "return")
    copy = raw_sheet(spark, d, "dispatch").hint("rebalance")  # other files, as many as the rows need
    parts = [
        ("copy", without_dispatch_copy(copy, raw["dispatch"])),
        ("part", without_dispatch_copy(copy.where("`Billing Weight` > 20"), raw["dispatch"])),
        ("return", without_dispatch_copy(raw["return"], raw["dispatch"])),
    ]
    rows = [df.agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("rows")) for n, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def mostly_copied_sheet(spark, d):
    """Of two sheets of changed dispatch rows, the one with 95 % unchanged rows is emptied and the one with 20 % kept."""
    dispatch = raw_sheet(spark, d, "dispatch")
    waybill = F.col("`Waybill Number`")
    parts = []
    for share in (95, 20):
        other = F.when(F.pmod(F.xxhash64(waybill), F.lit(100)) < share, waybill).otherwise(F.concat(waybill, F.lit("X")))
        sheet = dispatch.withColumn("Waybill Number", other)
        kept = without_most_of_dispatch(sheet, dispatch)
        parts.append(kept.agg(F.lit(share).cast("bigint").alias("share"), F.count(F.lit(1)).alias("rows")))
    return parts[0].unionByName(parts[1])


@query
def dispatch_in_return_tab(spark, d):
    """Changed dispatch rows in the "return" tab count as none, unless a column is about returns."""
    raw = raw_sheets(spark, d, "dispatch", "return")
    changed = raw["dispatch"].withColumn("Waybill Number", F.concat("Waybill Number", F.lit("X")))
    tabs = {"dispatch": changed, "reason": changed.withColumn("Return Reason", F.lit("refused")), "return": raw["return"]}
    parts = []
    for name, tab in tabs.items():
        kept = Workbook.from_raw(spark, {"dispatch": raw["dispatch"], "return": tab})["return"]
        parts.append(kept.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def sheet_fingerprint(spark, d):
    """Two arrangements of one sheet have one fingerprint."""
    raw = raw_sheet(spark, d, "pickup")
    both = fingerprint(raw).unionByName(fingerprint(raw.repartition(5, "Waybill")))
    return both.agg(F.max("rows").alias("rows"), F.count_distinct("rows", "digest").alias("fingerprints"))


# -- periods --------------------------------------------------------------------------------------

@query
def default_period(spark, d):
    return period.default_period(workbook(spark, d, "dispatch")["dispatch"])


@query
def default_period_rows(spark, d):
    rows = period.filter_default_period(workbook(spark, d, "dispatch")["dispatch"])
    return rows.groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def period_filter(spark, d):
    b = workbook(spark, d, "dispatch").between(*PERIOD)
    return b["dispatch"].groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def period_filter_all_sheets(spark, d):
    b = workbook(spark, d).between(*EVENT_PERIOD)
    parts = [
        b[n].agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("rows"))
        for n in ("dispatch", "duitnow", "ldr", "cod", "pending_parcel", "no_outbound_scan", "attendance", "hub", "reward")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _undated(spark: SparkSession, d: str) -> DataFrame:
    """Dispatch with unparsable dates for heavy parcels, and dispatchers without any date."""
    sheet = workbook(spark, d, "dispatch")["dispatch"]
    blank = (F.col("dispatcher_key").isin("3", "5", "8")) | (F.col("weight") > 30)
    return sheet.withColumn("event_ts", F.when(~blank, F.col("event_ts")))


@query
def null_date_retention(spark, d):
    kept = period.filter_period_retaining_undated(_undated(spark, d), *PERIOD)
    return kept.groupBy("dispatcher_key").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_ts").isNull()).alias("undated")
    )


@query
def lost_dispatchers(spark, d):
    return period.lost_dispatchers(_undated(spark, d), *PERIOD)


@query
def presence_counts(spark, d):
    b = workbook(spark, d, "dispatch", "attendance")
    return period.presence_counts(b["dispatch"], b["attendance"].where("amount > 0"), *PERIOD)


# -- overlap --------------------------------------------------------------------------------------

@query
def exclude_returned_pairs(spark, d):
    b = workbook(spark, d, "dispatch", "return")
    rows = exclude_pairs(b["dispatch"], b["return"])
    return rows.groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def exclude_pairs_preserving(spark, d):
    """Returned pairs go, except for waybills that were picked up."""
    b = workbook(spark, d, "dispatch", "return", "pickup")
    rows = exclude_pairs(b["dispatch"], b["return"], preserve=b["pickup"])
    return rows.groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def exclude_picked_up(spark, d):
    b = workbook(spark, d, "dispatch", "pickup")
    rows = exclude_waybills(b["dispatch"], b["pickup"])
    return rows.groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def net_dispatch_rows(spark, d):
    return _net(spark, d).select("dispatcher_key", "waybill", F.to_date("event_ts").alias("day"), "weight")


@query
def net_dispatch_stored(spark, d):
    """The net dispatch from sheets stored by waybill, whose overlaps need no shuffle of dispatch."""
    b = workbook(spark, d, *OVERLAP_SHEETS)
    stage = Stage(spark)
    buckets = by_waybill.buckets_for(b["dispatch"], 8)
    sheets = by_waybill.store({n: b[n] for n in OVERLAP_SHEETS}, stage.folder, buckets, f"s{uuid.uuid4().hex}")
    net = by_waybill.net_dispatch(sheets).rows
    return net.select("dispatcher_key", "waybill", F.to_date("event_ts").alias("day"), "weight")


@query
def stored_export_counts(spark, d):
    b = workbook(spark, d, "dispatch", "return")
    buckets = by_waybill.buckets_for(b["dispatch"], 8)
    sheets = by_waybill.store({n: b[n] for n in ("dispatch", "return")}, Stage(spark).folder, buckets, f"s{uuid.uuid4().hex}")
    return by_waybill.export_counts(sheets["dispatch"], sheets["return"])


@query
def return_waybill_pairs(spark, d):
    return waybill_pairs(workbook(spark, d, "return")["return"])


@query
def export_without_returns(spark, d):
    raw = raw_sheets(spark, d, "dispatch", "return")
    out = export.filtered_dispatch(raw["dispatch"], raw["return"])
    return out.select(
        F.col("`Dispatcher ID`").alias("dispatcher_id"),
        F.col("`Waybill Number`").alias("waybill"),
        F.to_date("`Delivery Signature`").alias("day"),
        F.col("`Billing Weight`").alias("weight"),
    )


@query
def export_stats(spark, d):
    raw = raw_sheets(spark, d, "dispatch", "return")
    return export.export_counters(raw["dispatch"], raw["return"])


# -- delivery pay ---------------------------------------------------------------------------------

@query
def daily_parcels(spark, d):
    b = workbook(spark, d, *OVERLAP_SHEETS)
    return delivery.daily_parcels(net_dispatch(b["dispatch"], b["return"], b["pickup"], b["bulky"]), b["bulky"])


@query
def daily_distinct_parcels(spark, d):
    return delivery.daily_parcels(workbook(spark, d, "dispatch")["dispatch"], count="distinct")


@query
def tiered_daily_pay(spark, d):
    days = statement.paid_days(
        workbook(spark, d, *OVERLAP_SHEETS), RULES.with_(special_rates=(), designated=RULES.designated.__class__())
    )
    return plain(days.select("dispatcher_key", "delivery_date", "daily_parcels", "tier", "rate_per_parcel", "payout_per_day"))


@query
def tiered_pay_summary(spark, d):
    """Flagship: dispatch, overlaps out, parcels per day, tier rate, pay per dispatcher."""
    rules = RULES.with_(special_rates=(), designated=RULES.designated.__class__())
    days = statement.paid_days(workbook(spark, d, *OVERLAP_SHEETS), rules)
    pay = delivery.delivery_pay(days, rules)
    return plain(pay.select("dispatcher_key", "delivery_parcels", "working_days", "base_payout"))


@query
def special_rate_pay(spark, d):
    days = _days(spark, d).where("special_rate IS NOT NULL")
    return plain(days.select("dispatcher_key", "delivery_date", "daily_parcels", "tier", "special_rate", "payout_per_day"))


@query
def rate_card_pay(spark, d):
    """Tier rates from a table instead of configuration."""
    daily = daily_parcels(spark, d)
    nation = spark.read.parquet(f"{d}/region.parquet")
    card = nation.select(
        F.col("r_regionkey").alias("rule_order"),
        F.col("r_name").alias("tier"),
        (F.col("r_regionkey") + 1).cast("bigint").alias("low"),
        F.when(F.col("r_regionkey") < 2, F.col("r_regionkey") + 1).cast("bigint").alias("high"),
        (F.col("r_regionkey") * 0.1 + 1).cast("decimal(12,4)").alias("rate"),
        F.lit(date(1995, 6, 1)).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    out = delivery.tier_from_card(daily, card).groupBy("tier").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("daily_parcels") * F.col("rate_per_parcel")).alias("pay")
    )
    return plain(out)


@query
def rate_card_overlaps(spark, d):
    """Every order date is a rule of its own with a validity and bounds that overlap thousands of others."""
    daily = daily_parcels(spark, d)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    card = orders.selectExpr(
        "o_orderkey AS rule_order", "concat('T', o_orderkey % 5) AS tier", "cast(1 + o_custkey % 3 AS bigint) AS low",
        "CASE WHEN o_custkey % 2 = 0 THEN cast(1 + o_custkey % 3 + o_orderkey % 2 AS bigint) END AS high",
        "cast(o_orderkey % 7 * 0.1 + 1 AS decimal(12,4)) AS rate", "to_date(o_orderdate) AS valid_from",
        "CASE WHEN o_orderkey % 3 > 0 THEN date_add(to_date(o_orderdate), cast(o_custkey % 90 AS int)) END AS valid_to",
    )
    out = delivery.tier_from_card(daily, card).groupBy("tier").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("daily_parcels") * F.col("rate_per_parcel")).alias("pay")
    )
    return plain(out)


@query
def designated_driver_pay(spark, d):
    days = _days(spark, d).where("designated")
    return plain(
        days.select("dispatcher_key", "delivery_date", "daily_parcels", "tier", "rate_per_parcel", "extra_parcels", "payout_per_day")
    )


@query
def designated_breakdown(spark, d):
    return plain(delivery.designated_breakdown(_days(spark, d), RULES))


@query
def kpi_bonus(spark, d):
    pay = delivery.delivery_pay(_days(spark, d), RULES)
    return plain(pay.select("dispatcher_key", "delivery_parcels", "kpi_bonus", "kpi_description"))


@query
def attendance_bonus(spark, d):
    pay = delivery.delivery_pay(_days(spark, d), RULES)
    return plain(pay.select("dispatcher_key", "qualified_days", "attendance_bonus", "attendance_description"))


@query
def flat_parcel_pay(spark, d):
    return plain(delivery.flat_parcel_pay(_net(spark, d), RULES))


@query
def weight_tier_pay(spark, d):
    return plain(delivery.weight_tier_pay(_net(spark, d), RULES))


@query
def daily_breakdown(spark, d):
    return statement.daily_breakdown(_days(spark, d), RULES)


# -- extras ---------------------------------------------------------------------------------------

@query
def pickup_pay(spark, d):
    return plain(extras.pickup_pay(workbook(spark, d, "pickup")["pickup"], RULES))


@query
def return_pay(spark, d):
    return plain(extras.return_pay(workbook(spark, d, "return")["return"], RULES))


@query
def bulky_pay(spark, d):
    return plain(extras.bulky_pay(workbook(spark, d, "bulky")["bulky"], RULES))


@query
def bulky_only_rows(spark, d):
    """Bulky rows whose waybill is not left on the dispatch sheet after returns."""
    b = workbook(spark, d, "dispatch", "return", "bulky")
    rows = extras.bulky_only(b["bulky"], exclude_pairs(b["dispatch"], b["return"]))
    return rows.groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def reward_total(spark, d):
    return plain(extras.amount_totals(workbook(spark, d, "reward")["reward"]))


@query
def rental_total(spark, d):
    return plain(extras.amount_totals(workbook(spark, d, "rental")["rental"], positive_only=False))


@query
def benefit_deductions(spark, d):
    b = workbook(spark, d, "socso", "overpaid")
    parts = [
        extras.amount_totals(b[n]).select(F.lit(n).alias("deduction"), "dispatcher_key", "records", "amount")
        for n in ("socso", "overpaid")
    ]
    return plain(parts[0].unionByName(parts[1]))


@query
def rounded_hub_totals(spark, d):
    return plain(extras.rounded_amount_totals(workbook(spark, d, "hub")["hub"]))


# -- penalties ------------------------------------------------------------------------------------

def _one_kind(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        b = workbook(spark, d, kind)
        parts = [
            penalties.penalty_totals(b, RULES, profile, (kind,)).withColumn("profile", F.lit(profile))
            for profile in (penalties.STATEMENT, penalties.FLEET)
        ]
        return plain(parts[0].unionByName(parts[1]).select("profile", "dispatcher_key", "amount", "parcels"))

    return run


for _kind in penalties.SHEET_KINDS:
    QUERIES[f"penalty_{_kind}"] = _one_kind(_kind)


@query
def penalty_pending_parcel_priced(spark, d):
    """The sheet without an amount column: distinct waybills at the configured price."""
    b = workbook(spark, d, "pending_parcel")
    b = b.replacing(pending_parcel=b["pending_parcel"].drop("amount"))
    return plain(penalties.penalty_totals(b, RULES).select("dispatcher_key", "amount", "parcels"))


@query
def penalty_ldr_priced(spark, d):
    """The sheet without any amount column, in the fleet profile: distinct waybills at 100."""
    b = workbook(spark, d, "ldr")
    b = b.replacing(ldr=b["ldr"].drop("amount"))
    return plain(
        penalties.penalty_totals(b, RULES, penalties.FLEET).select("dispatcher_key", "amount", "parcels")
    )


@query
def penalty_route(spark, d):
    keys = all_dispatchers(workbook(spark, d, "dispatch"))
    return plain(penalties.route_shares(keys, RULES).select("dispatcher_key", "amount", "parcels"))


@query
def route_split(spark, d):
    """A pool over all customers, by name, with left-over cents for the first ones."""
    from parcelpay.operators.ranking import split_pool

    names = spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.substring("c_mktsegment", 1, 4), F.col("c_custkey").cast("string")).alias("id")
    )
    return plain(split_pool(names, 1234567, "id"))


@query
def penalty_totals(spark, d):
    return plain(penalties.wide(penalties.penalty_totals(workbook(spark, d), RULES)))


@query
def penalty_by_kind(spark, d):
    return plain(penalties.by_kind(penalties.penalty_totals(workbook(spark, d), RULES, penalties.FLEET)))


@query
def penalty_waybills(spark, d):
    return plain(
        penalties.penalty_waybills(penalties.ledger(workbook(spark, d, "ldr", "pending_parcel", "parcel_lost"), RULES))
    )


@query
def penalty_waybills_shown(spark, d):
    rows = penalties.ledger(workbook(spark, d, "ldr", "fake_attempt", "pending_parcel"), RULES)
    return penalties.waybills_display(rows)


@query
def scan_dedupe(spark, d):
    first = penalties.dedupe_first(workbook(spark, d, "no_outbound_scan")["no_outbound_scan"])
    return first.select("dispatcher_key", "waybill", F.to_date("event_ts").alias("first_day"), "records")


@query
def penalty_detail(spark, d):
    return plain(penalties.penalty_detail(workbook(spark, d), RULES))


@query
def penalties_in_period(spark, d):
    b = workbook(spark, d).between(*EVENT_PERIOD)
    return plain(penalties.penalty_totals(b, RULES))


# -- statement and fleet --------------------------------------------------------------------------

@query
def statement_all(spark, d):
    return plain(statement.statement(workbook(spark, d), RULES))


@query
def statement_in_period(spark, d):
    b = workbook(spark, d).between(*PERIOD)
    return plain(statement.statement(b, RULES))


@query
def statement_one_dispatcher(spark, d):
    return plain(statement.for_dispatcher(statement.statement(workbook(spark, d), RULES), "JMR-0007"))


@query
def invoice_lines(spark, d):
    return plain(invoice.statement_lines(statement.statement(workbook(spark, d), RULES), RULES))


@query
def fleet_summary(spark, d):
    return plain(fleet.fleet_summary(workbook(spark, d), RULES))


@query
def fleet_summary_with_route(spark, d):
    """The route pool split over the dispatchers that still deliver after the exclusions."""
    return plain(fleet.fleet_summary(workbook(spark, d), RULES.with_(route_fleet_enabled=True)))


@query
def fleet_summary_with_attendance(spark, d):
    """Attendance penalties, off by default in the fleet profile, are taken too; they count no parcels.

    The profile reads plain numbers only: the ids that end in 7 keep the decimal comma of the sheet and owe nothing.
    """
    raw, amount = raw_sheets(spark, d), F.col("ATTENDANCE PENALTY")
    plain_text = F.when(F.col("Dispatcher ID").endswith("7"), amount).otherwise(F.replace(amount, F.lit(","), F.lit(".")))
    raw["attendance"] = raw["attendance"].withColumn("ATTENDANCE PENALTY", plain_text)
    book = Workbook.from_raw(spark, raw)
    return plain(fleet.fleet_summary(book, RULES.with_(attendance_penalty_fleet_enabled=True)))


@query
def fleet_totals(spark, d):
    return plain(fleet.fleet_totals(fleet.fleet_summary(workbook(spark, d), RULES)))


@query
def fleet_invoice_lines(spark, d):
    return plain(invoice.fleet_lines(fleet.fleet_totals(fleet.fleet_summary(workbook(spark, d), RULES))))


@query
def fleet_display(spark, d):
    shown = fleet.fleet_display(fleet.fleet_summary(workbook(spark, d), RULES), RULES)
    # The two averages are compared as numbers in fleet_summary; the engines print ties differently.
    names = {k: h for k, h in fleet.HEADERS.items() if not k.startswith("avg_")}
    return shown.select(*[F.col(f"`{h}`").alias(k) for k, h in names.items()])


@query
def top_performers(spark, d):
    top = fleet.top_performers(fleet.fleet_summary(workbook(spark, d), RULES), 10)
    return plain(top.select("dispatcher_key", "dispatcher_name", "total_payout"))


@query
def top_penalties(spark, d):
    top = fleet.top_penalties(fleet.fleet_summary(workbook(spark, d), RULES))
    return plain(top.select("dispatcher_key", "penalty_amount", "penalty_count"))


@query
def payout_share(spark, d):
    share = fleet.payout_share(fleet.fleet_summary(workbook(spark, d), RULES))
    return plain(share.select("dispatcher_key", "total_payout", F.round("share", 9).alias("share")))


@query
def dispatcher_directory(spark, d):
    return directory(workbook(spark, d))


@query
def pickup_detail(spark, d):
    return fleet.pickup_detail(workbook(spark, d, "pickup")["pickup"])


@query
def return_detail(spark, d):
    return fleet.return_detail(workbook(spark, d, "return")["return"])


# -- trends and forecast --------------------------------------------------------------------------

@query
def daily_trend(spark, d):
    return trends.daily_trend(workbook(spark, d, "dispatch")["dispatch"])


@query
def daily_payout_trend(spark, d):
    return plain(trends.daily_payout_trend(workbook(spark, d, "dispatch")["dispatch"], RULES))


@query
def daily_stats(spark, d):
    return plain(trends.daily_stats(_days(spark, d)))


def _event_series(spark: SparkSession, d: str) -> DataFrame:
    """Scan events per day and event type: one series per type."""
    events = spark.read.parquet(f"{d}/events.parquet")
    daily = events.groupBy("event_type", F.to_date("ts").alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    return trends.series(daily, "ds", "n", F.col("event_type"))


def _fleet_series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dispatch = workbook(spark, d, "dispatch")["dispatch"]
    return (
        trends.series(trends.daily_trend(dispatch), "signature_date", "total_parcels"),
        trends.series(trends.daily_payout_trend(dispatch, RULES), "signature_date", "total_payout"),
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


@query
def forecast(spark, d):
    return _rounded(trends.forecast(_event_series(spark, d), RULES.forecast_days))


@query
def forecast_metrics(spark, d):
    points = _event_series(spark, d)
    return _rounded(trends.forecast_metrics(points, trends.forecast(points, RULES.forecast_days)))


@query
def combined_forecast(spark, d):
    parcels, payout = _fleet_series(spark, d)
    both = trends.combined_forecast(
        trends.forecast(parcels, RULES.forecast_days), trends.forecast(payout, RULES.forecast_days)
    )
    return plain(both)


@query
def history_and_forecast(spark, d):
    points = _event_series(spark, d)
    return _rounded(trends.history_and_forecast(points, trends.forecast(points, 7)))


@query
def joint_forecast(spark, d):
    return _rounded(joint_trend.joint_forecast(_event_series(spark, d), RULES.forecast_days))


@query
def joint_components(spark, d):
    return _rounded(joint_trend.joint_components(_event_series(spark, d)))
