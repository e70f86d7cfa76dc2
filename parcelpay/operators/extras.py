"""Pickup, return and bulky pay, rewards, rentals and benefit deductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import BulkyRates, PickupCommission, Rules
from parcelpay.functions.numbers import MONEY, rate, round_money
from parcelpay.functions.sql import case, literal, literals
from parcelpay.operators.overlap import exclude_waybills


def commission_for(source: str, weight: str, rule: PickupCommission) -> str:
    """Commission of one pickup by order source, and by weight for the weighed source."""
    heavy = f"{source} = {literal(rule.weighed_source)} AND {weight} > {literal(rule.weighed_threshold_kg)}"
    return case(
        [
            (f"{source} = {literal(rule.qr_source)}", rate(rule.qr)),
            (heavy, rate(rule.weighed_high)),
            (f"{source} = {literal(rule.weighed_source)}", rate(rule.weighed_low)),
            (f"{source} IN ({literals(rule.standard_sources)})", rate(rule.standard)),
        ],
        rate(rule.other),
    )


def pickup_commission(pickup: DataFrame, rules: Rules) -> str:
    """Commission per pickup row: by order source, else the sheet's own, else the flat rate."""
    if "order_source" in pickup.columns:
        weight = "billing_weight" if "billing_weight" in pickup.columns else "0"
        return round_money(commission_for("order_source", weight, rules.pickup))
    if "commission" in pickup.columns:
        return round_money("commission")
    return round_money(rate(rules.pickup_rate))


def countable(sheet: DataFrame) -> DataFrame:
    """Rows with a dispatcher and a waybill; a lone dash is a waybill."""
    return sheet.where("dispatcher_key IS NOT NULL AND waybill IS NOT NULL")


def pickup_pay(pickup: DataFrame, rules: Rules) -> DataFrame:
    return (
        countable(pickup)
        .groupBy("dispatcher_key")
        .agg(
            F.count(F.lit(1)).alias("pickup_parcels"),
            F.expr(f"cast(sum({pickup_commission(pickup, rules)}) AS {MONEY})").alias("pickup_payout"),
        )
    )


def return_value(rules: Rules) -> str:
    return round_money(f"return_parcels * {rate(rules.return_rate)}")


def return_pay(returned: DataFrame, rules: Rules) -> DataFrame:
    counts = countable(returned).groupBy("dispatcher_key").agg(F.count(F.lit(1)).alias("return_parcels"))
    return counts.selectExpr("*", f"{return_value(rules)} AS return_payout")


def bulky_rate(bulky: DataFrame, rule: BulkyRates) -> str:
    """Under-threshold rate up to and including the threshold, and without a weight."""
    if "weight" not in bulky.columns:
        return f"cast({literal(rule.under)} AS {MONEY})"
    heavy = f"weight > {literal(rule.threshold)}"
    return f"cast(CASE WHEN {heavy} THEN {literal(rule.over)} ELSE {literal(rule.under)} END AS {MONEY})"


def bulky_pay(bulky: DataFrame, rules: Rules) -> DataFrame:
    return (
        bulky.where("dispatcher_key IS NOT NULL")
        .groupBy("dispatcher_key")
        .agg(
            F.count(F.lit(1)).alias("bulky_parcels"),
            F.expr(f"cast(sum({bulky_rate(bulky, rules.bulky)}) AS {MONEY})").alias("bulky_payout"),
        )
    )


def bulky_only(bulky: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Bulky rows with a waybill that is not on the dispatch sheet."""
    return exclude_waybills(bulky.where("waybill IS NOT NULL"), dispatch)


def amount_totals(sheet: DataFrame, positive_only: bool = True) -> DataFrame:
    """Rounded sum of amounts per dispatcher; rewards and deductions count positive amounts only."""
    rows = sheet.where("dispatcher_key IS NOT NULL")
    if positive_only:
        rows = rows.where("amount > 0")
    return rows.groupBy("dispatcher_key").agg(
        F.count(F.lit(1)).alias("records"), F.expr(round_money("sum(amount)")).alias("amount")
    )


def rounded_amount_totals(sheet: DataFrame) -> DataFrame:
    """Positive amounts, each rounded before the sum."""
    return (
        sheet.where("dispatcher_key IS NOT NULL AND amount > 0")
        .groupBy("dispatcher_key")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.expr(f"cast(sum({round_money('amount')}) AS {MONEY})").alias("amount"),
        )
    )
