"""Invoice lines: ordered (label, quantity, amount) rows per dispatcher and for the fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import MONEY, round_money
from parcelpay.functions.sql import literal
from parcelpay.operators import penalties

# Invoice labels of the penalty kinds.
PENALTY_LABELS = {
    "duitnow": "DuitNow",
    "ldr": "LD&R",
    "fake_attempt": "Fake Attempt",
    "cod": "COD",
    "binding": "Binding",
    "hub": "Hub",
    "pending_parcel": "Pending Parcel",
    "no_outbound_scan": "No Outbound Scan",
    "parcel_lost": "Parcel Lost",
    "route": "Route",
    "attendance": "Attendance",
}


Line = tuple[str, str, str, str]


def _lines(df: DataFrame, keys: Sequence[str], lines: Sequence[Line]) -> DataFrame:
    """Rows per (label, quantity, amount, condition); a line appears where its condition holds."""
    structs = [
        f"CASE WHEN {condition} THEN named_struct('line', {number}, 'label', {literal(label)}, "
        f"'quantity', cast({quantity} AS bigint), 'amount', cast({amount} AS {MONEY})) END"
        for number, (label, quantity, amount, condition) in enumerate(lines, 1)
    ]
    exploded = df.select(*keys, F.expr(f"explode(array_compact(array({', '.join(structs)}))) AS x"))
    return exploded.select(*keys, "x.*")


def _line(label: str, quantity: str, amount: str, condition: str = "true") -> Line:
    return label, quantity, amount, condition


def statement_lines(report: DataFrame, rules: Rules) -> DataFrame:
    """Invoice lines of every dispatcher from the statement; deductions carry a minus sign."""
    dd = rules.designated
    basic = round_money(literal(dd.basic_amount))
    designated = "designated AND working_days > 0"
    extra_pay = f"(base_payout - special_pay - {basic})"
    lines = [
        _line("Base Delivery Payout", "delivery_parcels", "base_payout"),
        _line("Basic Amount", str(dd.basic_parcels), basic, designated),
        _line(
            "Extra Parcels", f"greatest(0L, delivery_parcels - {dd.basic_parcels}L)", extra_pay,
            f"{designated} AND {extra_pay} > 0",
        ),
        _line("Special Rate Incentive", "NULL", "special_pay", f"{designated} AND special_pay > 0"),
        _line("Pickup Payout", "pickup_parcels", "pickup_payout"),
        _line("Return Payout", "return_parcels", "return_payout"),
        _line("Reward", "reward_count", "reward_payout"),
        _line("KPI Bonus", "NULL", "kpi_bonus"),
        _line("Attendance Bonus", "qualified_days", "attendance_bonus"),
        _line("Total Penalties", "penalty_count", "-penalty_total"),
        *[
            _line(f"{PENALTY_LABELS[k]} Penalty", "NULL", f"-{k}_penalty", f"{k}_penalty > 0")
            for k in penalties.KINDS
        ],
        _line("SOCSO", "NULL", "-socso_deduction"),
        _line("Overpaid", "NULL", "-overpaid_deduction"),
        _line("Gross Payout", "total_awb", "gross_payout"),
        _line("Advance Payout", "NULL", "-advance_payout"),
        _line("Final Payout", "NULL", "final_payout"),
    ]
    return _lines(report, ["dispatcher_key"], lines)


def fleet_lines(totals: DataFrame) -> DataFrame:
    """Invoice lines of the whole fleet from the totals row."""
    lines = [
        _line("Delivery Parcels Payout", "parcels_delivered", "dispatch_payout"),
        _line("Pickup Payout", "pickup_parcels", "pickup_payout"),
        _line("Return Parcels Payout", "return_parcels", "return_payout"),
        _line("Bulky Parcels Payout", "bulky_parcels", "bulky_payout"),
        _line("Total Reward", "NULL", "reward"),
        _line("Gross Payout", "total_awb", "gross_earnings"),
        *[_line(f"{PENALTY_LABELS[k]} Penalty", "NULL", f"-{k}_penalty") for k in penalties.KINDS],
        _line("Total Penalty", "penalty_count", "-penalty_amount"),
        _line("Total Rental (deduction)", "NULL", "-rental"),
        _line("SOCSO", "NULL", "-socso_deduction"),
        _line("Overpaid", "NULL", "-overpaid_deduction"),
        _line("Total Deduction", "NULL", "-total_deduction"),
        _line("Total Payout", "dispatchers", "total_payout"),
    ]
    return _lines(totals, [], lines)
