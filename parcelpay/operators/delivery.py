"""Delivery pay: daily tiers, special rates, designated drivers, weight tiers, flat rate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelpay.config import AttendanceRule, DesignatedDriver, Kpi, Rules, SpecialRate, Tier, WeightTiers
from parcelpay.functions.numbers import MONEY, RATE, rate, round_money
from parcelpay.functions.sql import case, literal
from parcelpay.functions.text import dispatcher_key
from parcelpay.sources.stage import Stage

# -- parcels per day ---------------------------------------------------------------------------


def daily_parcels(
    net: DataFrame, bulky: DataFrame | None = None, count: str = "rows", as_of: date | None = None
) -> DataFrame:
    """(dispatcher_key, delivery_date, daily_parcels).

    Bulky rows with a waybill count as deliveries of their own. ``count`` is "rows", or
    "distinct" for distinct waybills. Rows without a date are left out, or dated ``as_of``.
    """
    day = "to_date(event_ts)" if as_of is None else f"coalesce(to_date(event_ts), {literal(as_of)})"
    fields = ["dispatcher_key", f"{day} AS delivery_date"] + (["waybill"] if count == "distinct" else [])
    parts = net.selectExpr(*fields)
    if bulky is not None and "event_ts" in bulky.columns:
        parts = parts.unionByName(bulky.where("waybill IS NOT NULL").selectExpr(*fields))
    dated = parts.where("dispatcher_key IS NOT NULL AND delivery_date IS NOT NULL")
    counted = {"rows": "count(1)", "distinct": "count(DISTINCT waybill)"}
    if count not in counted:
        raise ValueError(f"count must be 'rows' or 'distinct', not {count!r}")
    return dated.groupBy("dispatcher_key", "delivery_date").agg(F.expr(counted[count]).alias("daily_parcels"))


# -- rate rules --------------------------------------------------------------------------------


def _between(value: str, low: int | None, high: int | None) -> str:
    bounds = []
    if low is not None:
        bounds.append(f"{value} >= {low}")
    if high is not None:
        bounds.append(f"{value} <= {high}")
    return " AND ".join(bounds) or "true"


def tier_of(parcels: str, tiers: Sequence[Tier]) -> str:
    """struct(tier, rate) of the first matching tier, highest lower bound first."""
    ordered = sorted(tiers, key=lambda t: t.low or 0, reverse=True)
    return case(
        [
            (
                _between(parcels, t.low, t.high),
                f"named_struct('tier', {literal(t.name)}, 'rate', {rate(t.rate)})",
            )
            for t in ordered
        ],
        f"named_struct('tier', 'Unmatched', 'rate', cast(0 AS {RATE}))",
    )


def special_rate_of(day: str, parcels: str, rules: Sequence[SpecialRate]) -> str:
    """struct(rate, description) of the first special rate that applies, else NULL."""
    return case(
        [
            (
                f"{parcels} > {r.min_parcels} AND {day} BETWEEN {literal(r.start)} AND {literal(r.end)}",
                f"named_struct('rate', {rate(r.rate)}, 'description', {literal(r.description)})",
            )
            for r in rules
        ],
        f"cast(NULL AS struct<rate: {RATE}, description: string>)",
    )


def _levels(span: str) -> str:
    """How often a span of whole numbers can be halved until one block covers it."""
    return f"cast(ceil(log2(greatest({span}, 0) + 1)) AS int)"


def _blocks_of(value: str, levels: str) -> str:
    """Every block that holds a value: one per level, of 2^level numbers, named by (level, value >> level)."""
    return f"transform(sequence(0, {levels}), l -> struct(l AS level, shiftright({value}, l) AS block))"


def _blocks_in(low: str, high: str, levels: str) -> str:
    """The disjoint blocks that make up an interval, two per level at most.

    Whole blocks of a level run from ``a`` to ``b``. The first is part of no larger block within the interval where its
    number is odd, the last one where its number is even.
    """
    ends = (
        f"transform(sequence(0, {levels}), l -> struct(l AS level, "
        f"shiftright({low} + shiftleft(1L, l) - 1, l) AS a, shiftright({high} + 1, l) - 1 AS b))"
    )
    taken = "array(CASE WHEN e.a <= e.b AND e.a % 2 = 1 THEN e.a END, CASE WHEN e.a <= e.b AND e.b % 2 = 0 THEN e.b END)"
    return f"flatten(transform({ends}, e -> transform(array_compact({taken}), k -> struct(e.level AS level, k AS block))))"


def tier_from_card(daily: DataFrame, card: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Tier and rate per day from a rate card kept as a table.

    ``card`` has (rule_order, tier, low, high, rate, valid_from, valid_to); open bounds are NULL.
    The first rule by ``rule_order`` that matches wins, however many rules overlap.

    Days and counts are cut into blocks of 1, 2, 4, ... numbers. A rule is the union of a few pairs of blocks, and of the
    rules that hold a pair only the first is kept. A day and count lie in one block per level, so their rule is found by
    equality on the pair alone: rows before the last aggregation are bounded by the distinct (day, count) pairs times
    the levels, and no rule is compared with a day it does not hold. The daily counts are stored in ``stage`` first,
    since their span, their distinct pairs and their rows are all needed.
    """
    stage = stage or Stage(daily.sparkSession)
    daily = stage.put(daily, "daily")
    span = daily.agg(
        F.expr(
            """struct(min(delivery_date) AS day0, cast(datediff(max(delivery_date), min(delivery_date)) AS bigint) AS days,
                      min(daily_parcels) AS count0, cast(max(daily_parcels) - min(daily_parcels) AS bigint) AS counts)"""
        ).alias("s")
    ).scalar()
    day_levels, count_levels = _levels("s.days"), _levels("s.counts")
    open_rule = "coalesce(cast(datediff(valid_from, s.day0) AS bigint), 0)", "coalesce(cast(datediff(valid_to, s.day0) AS bigint), s.days)"
    held = (
        card.withColumn("s", span)
        .selectExpr(
            "struct(rule_order, tier, low, high, rate, valid_from, valid_to) AS rule",
            "s",
            f"greatest({open_rule[0]}, 0) AS d1",
            f"least({open_rule[1]}, s.days) AS d2",
            "greatest(coalesce(low - s.count0, 0L), 0L) AS c1",
            "least(coalesce(high - s.count0, s.counts), s.counts) AS c2",
        )
        .where("d1 <= d2 AND c1 <= c2")
        .selectExpr("rule", "s", "c1", "c2", f"explode({_blocks_in('d1', 'd2', day_levels)}) AS d")
        .selectExpr("rule", "d", f"explode({_blocks_in('c1', 'c2', count_levels)}) AS c")
        .groupBy(F.struct("d", "c").alias("k"))
        .agg(F.min("rule").alias("rule"))
        .selectExpr("k.d AS d", "k.c AS c", "rule")
    )
    pairs = (
        daily.select("delivery_date", "daily_parcels").distinct().withColumn("s", span)
        .selectExpr("delivery_date", "daily_parcels", "s", "daily_parcels - s.count0 AS n",
                    f"explode({_blocks_of('cast(datediff(delivery_date, s.day0) AS bigint)', day_levels)}) AS d")
        .selectExpr("delivery_date", "daily_parcels", "d", f"explode({_blocks_of('n', count_levels)}) AS c")
    )
    hits = pairs.join(held, ["d", "c"]).groupBy("delivery_date", "daily_parcels").agg(F.min("rule").alias("__hit"))
    return daily.join(hits, ["delivery_date", "daily_parcels"], "left").selectExpr(
        *daily.columns,
        "coalesce(__hit.tier, 'Unmatched') AS tier",
        f"coalesce(cast(__hit.rate AS {RATE}), cast(0 AS {RATE})) AS rate_per_parcel",
    )


def is_designated(key: str, rule: DesignatedDriver) -> str:
    if not rule.ids:
        return "false"
    return f"{key} IN ({', '.join(dispatcher_key(literal(i)) for i in rule.ids)})"


# -- tiered and designated daily pay -----------------------------------------------------------


def tiered_daily_pay(daily: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rate and pay per dispatcher and day, with the columns to keep.

    A special rate beats the tier. A designated driver is paid beyond the basic parcels of the
    running total instead of by tier; special-rate days pay all their parcels there, too.
    """
    dd = rules.designated
    extra = "0L"
    if dd.ids:
        # Days per dispatcher are few, and the shuffle by dispatcher serves the later totals, too.
        running = (
            "sum(daily_parcels) OVER (PARTITION BY dispatcher_key ORDER BY delivery_date "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )
        extra = (
            f"CASE WHEN {is_designated('dispatcher_key', dd)} THEN "
            f"greatest(0L, {running} - greatest({running} - daily_parcels, {dd.basic_parcels}L)) ELSE 0L END"
        )
    rated = daily.selectExpr(
        "dispatcher_key",
        "delivery_date",
        "daily_parcels",
        f"{is_designated('dispatcher_key', dd)} AS designated",
        f"{tier_of('daily_parcels', rules.tiers)} AS t",
        f"{special_rate_of('delivery_date', 'daily_parcels', rules.special_rates)} AS s",
        f"{extra} AS extra",
        *keep,
    )
    after_basic = rate(dd.rate_after_basic)
    return rated.selectExpr(
        "dispatcher_key",
        "delivery_date",
        "daily_parcels",
        "designated",
        "coalesce(s.description, CASE WHEN designated THEN 'Designated Driver' ELSE t.tier END) AS tier",
        "s.rate AS special_rate",
        f"""coalesce(s.rate, CASE WHEN NOT designated THEN t.rate WHEN extra > 0 THEN {after_basic}
                                  ELSE cast(0 AS {RATE}) END) AS rate_per_parcel""",
        "CASE WHEN s IS NULL AND designated THEN extra ELSE 0L END AS extra_parcels",
        f"""cast(CASE WHEN s IS NOT NULL THEN daily_parcels * s.rate
                      WHEN designated THEN round(extra * {after_basic}, 2)
                      ELSE daily_parcels * t.rate END AS decimal(20,4)) AS payout_per_day""",
        *keep,
    )


def delivery_pay(paid_days: DataFrame, rules: Rules) -> DataFrame:
    """Per dispatcher: parcels, working days, base pay, and KPI and attendance bonuses."""
    return with_bonuses(delivery_totals(paid_days, rules.attendance), rules)


def delivery_totals(paid_days: DataFrame, attendance: AttendanceRule) -> DataFrame:
    return paid_days.groupBy("dispatcher_key").agg(
        F.sum("daily_parcels").alias("delivery_parcels"),
        F.count(F.lit(1)).alias("working_days"),
        F.expr(f"count_if(daily_parcels >= {attendance.min_parcels_per_day})").alias("qualified_days"),
        F.sum("payout_per_day").alias("day_pay"),
        F.expr("coalesce(sum(CASE WHEN special_rate IS NOT NULL THEN payout_per_day END), 0)").alias("special_pay"),
        F.bool_or("designated").alias("designated"),
    )


def with_bonuses(totals: DataFrame, rules: Rules) -> DataFrame:
    """Base pay and bonuses from per-dispatcher delivery totals.

    Without a delivery day there is no base pay, not even the basic amount, and no bonus.
    """
    dd = rules.designated
    own, general = kpi_bonus("delivery_parcels", dd.kpi), kpi_bonus("delivery_parcels", rules.kpi)
    bonus, description = attendance_bonus("qualified_days", rules.attendance)
    nothing = f"cast(0 AS {MONEY})"
    basic = f"CASE WHEN designated AND working_days > 0 THEN {literal(dd.basic_amount)} ELSE 0BD END"
    kpi = f"(CASE WHEN designated THEN {own} ELSE {general} END)"
    return totals.selectExpr(
        "*",
        f"{round_money(f'day_pay + {basic}')} AS base_payout",
        f"CASE WHEN working_days > 0 THEN {kpi}.bonus ELSE {nothing} END AS kpi_bonus",
        f"CASE WHEN working_days > 0 THEN {kpi}.description ELSE '' END AS kpi_description",
        f"CASE WHEN working_days > 0 THEN {bonus} ELSE {nothing} END AS attendance_bonus",
        f"""CASE WHEN working_days > 0 THEN {description}
                 ELSE 'No delivery records in selected period' END AS attendance_description""",
    )


def kpi_bonus(parcels: str, rules: Sequence[Kpi]) -> str:
    """struct(bonus, description) of the highest threshold reached."""
    ordered = sorted(rules, key=lambda k: k.parcels, reverse=True)
    return case(
        [
            (
                f"{parcels} >= {k.parcels}",
                f"named_struct('bonus', {round_money(literal(k.bonus))}, 'description', {literal(k.description)})",
            )
            for k in ordered
        ],
        f"named_struct('bonus', cast(0 AS {MONEY}), 'description', 'No KPI achieved')",
    )


def attendance_bonus(qualified_days: str, rule: AttendanceRule) -> tuple[str, str]:
    """(bonus, description) for the number of days with enough parcels."""
    if not rule.enabled:
        return f"cast(0 AS {MONEY})", "'Attendance bonus not enabled'"
    reached = f"{qualified_days} >= {rule.required_days}"
    bonus = f"CASE WHEN {reached} THEN {round_money(literal(rule.bonus))} ELSE cast(0 AS {MONEY}) END"
    description = (
        f"concat({qualified_days}, '/{rule.required_days} days qualified (', "
        f"CASE WHEN {reached} THEN '≥' ELSE 'need ≥' END, '{rule.min_parcels_per_day} parcels/day)')"
    )
    return bonus, description


def designated_breakdown(paid_days: DataFrame, rules: Rules) -> DataFrame:
    """Basic amount, extra parcels and pay, and special-day pay of designated drivers."""
    dd = rules.designated
    basic = literal(dd.basic_amount)
    return delivery_totals(paid_days.where("designated"), rules.attendance).selectExpr(
        "dispatcher_key",
        "delivery_parcels",
        f"{round_money(basic)} AS basic_amount",
        f"{dd.basic_parcels}L AS basic_parcels",
        f"{rate(dd.rate_after_basic)} AS rate_after_basic",
        f"greatest(0L, delivery_parcels - {dd.basic_parcels}L) AS extra_parcels",
        f"{round_money('day_pay - special_pay')} AS extra_payout",
        f"{round_money('special_pay')} AS special_payout",
        f"{round_money(f'day_pay + {basic}')} AS base_payout",
    )


def designated_base(parcels: str, rule: DesignatedDriver) -> str:
    """Basic amount plus the rate for every parcel beyond the basic ones, without special days."""
    return round_money(
        f"{literal(rule.basic_amount)} + greatest(0L, {parcels} - {rule.basic_parcels}L) * {rate(rule.rate_after_basic)}"
    )


def flat_parcel_pay(net: DataFrame, rules: Rules) -> DataFrame:
    """Distinct non-blank waybills per dispatcher at one rate."""
    return (
        net.where("dispatcher_key IS NOT NULL AND waybill IS NOT NULL")
        .groupBy("dispatcher_key")
        .agg(F.count_distinct("waybill").alias("parcels"))
        .selectExpr("dispatcher_key", "parcels", f"{round_money(f'parcels * {rate(rules.flat_rate)}')} AS payout")
    )


# -- weight tiers ------------------------------------------------------------------------------

TIER_NUMBERS = range(1, 5)


def weight_tier(weight: str, tiers: WeightTiers) -> str:
    """Tier number 1 to 4; without a weight, or at zero and below, tier 1."""
    return case(
        [
            (f"{weight} > {literal(tiers.cut3)}", "4"),
            (f"{weight} >= {literal(tiers.cut2)}", "3"),
            (f"{weight} >= {literal(tiers.cut1)}", "2"),
        ],
        "1",
    )


def weight_rate(weight: str, tiers: WeightTiers) -> str:
    return f"element_at(array({', '.join(rate(r) for r in tiers.rates)}), {weight_tier(weight, tiers)})"


def weight_tier_counts(tiers: WeightTiers, weight: str = "weight") -> list[Column]:
    """Aggregates ``tier1_parcels`` to ``tier4_parcels``."""
    tier = weight_tier(weight, tiers)
    return [F.expr(f"count_if({tier} = {n})").alias(f"tier{n}_parcels") for n in TIER_NUMBERS]


def weight_tier_value(tiers: WeightTiers) -> str:
    """Pay of the counted parcels: each tier's count at its rate."""
    return round_money(" + ".join(f"tier{n}_parcels * {rate(r)}" for n, r in enumerate(tiers.rates, 1)))


def weight_tier_pay(net: DataFrame, rules: Rules) -> DataFrame:
    """Per dispatcher: parcels by weight tier, weights, delivery pay and average rate."""
    counts = (
        net.where("dispatcher_key IS NOT NULL")
        .groupBy("dispatcher_key")
        .agg(
            F.count(F.lit(1)).alias("parcels"),
            *weight_tier_counts(rules.weight_tiers),
            F.expr("sum(cast(weight AS decimal(18,6)))").alias("total_weight"),
            F.count("weight").alias("weighed"),
        )
    )
    return counts.selectExpr(
        "dispatcher_key",
        "parcels",
        *[f"tier{n}_parcels" for n in TIER_NUMBERS],
        *weight_and_pay(rules.weight_tiers),
    )


def weight_and_pay(tiers: WeightTiers) -> list[str]:
    """Weight and pay columns from ``parcels``, ``tierN_parcels``, ``total_weight``, ``weighed``."""
    pay, total = weight_tier_value(tiers), "cast(coalesce(total_weight, 0) AS double)"
    return [
        f"{total} AS total_weight",
        f"CASE WHEN weighed > 0 THEN {total} / weighed ELSE 0D END AS avg_weight",
        f"{pay} AS dispatch_payout",
        f"CASE WHEN parcels > 0 THEN cast({pay} AS double) / parcels ELSE 0D END AS avg_rate",
    ]
