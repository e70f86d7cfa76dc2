"""Fleet summary: weight-tier pay, extras, penalties and net pay of every dispatcher, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import MONEY
from parcelpay.functions.sql import literal, literals
from parcelpay.operators import delivery, extras, penalties
from parcelpay.plans import measures as M
from parcelpay.plans import spine as S
from parcelpay.sources.stage import Stage
from parcelpay.sources.workbook import Workbook

TIERS = tuple(f"tier{n}" for n in range(1, 5))
WEIGHED = "weighed"
PENALTY_COLUMNS = tuple(f"{k}_penalty" for k in penalties.KINDS)
EARNINGS = ("dispatch_payout", "pickup_payout", "return_payout", "bulky_payout", "reward")
DEDUCTIONS = ("penalty_amount", "rental", "socso_deduction", "overpaid_deduction")


def dispatch_entries(dispatch: DataFrame) -> DataFrame:
    """Net parcels by weight tier, their weight, and the rows that were only seen, per dispatcher and name.

    The rows come dealt by waybill, so every task knows most dispatchers and sends one row for each: all measures
    side by side, and not a row per measure.
    """
    counted = dispatch.groupBy("dispatcher_key", "dispatcher_name").agg(
        *[F.expr(f"count_if(net AND tier = {n})").alias(t) for n, t in enumerate(TIERS, 1)],
        F.expr("count_if(NOT net)").alias(M.SEEN),
        F.expr("coalesce(sum(CASE WHEN net THEN cast(weight AS decimal(18,6)) END), 0) AS weight"),
        F.expr(f"count_if(net AND weight IS NOT NULL) AS {WEIGHED}"),
    )
    counts = [f"named_struct('measure', '{m}', 'quantity', {m}, 'amount', 0BD, 'flagged', 0L)" for m in (*TIERS, M.SEEN)]
    weight = f"named_struct('measure', '{WEIGHED}', 'quantity', {WEIGHED}, 'amount', weight, 'flagged', {WEIGHED})"
    rows = counted.selectExpr("dispatcher_key", "dispatcher_name", f"inline(array({', '.join([*counts, weight])}))")
    return M.entries(
        rows.where("quantity > 0"), "measure", quantity="quantity", amount="amount", flagged="flagged", name="dispatcher_name"
    )


def fleet_summary(book: Workbook, rules: Rules, spine: S.Spine | None = None, stage: Stage | None = None) -> DataFrame:
    """One row per dispatcher known to any sheet.

    Every sheet is read once: the small parcel sheets are stored in ``stage`` first (see ``plans.spine``), unless the
    caller has a spine of the same workbook and rules. A dispatcher is named by its net parcels, else by its other
    parcels, else by any sheet that has a name for it.
    """
    stage = stage or Stage(book.spark)
    spine = spine or S.build(book, rules, stage)
    pickup, returned = extras.countable(spine.side("pickup")), extras.countable(spine.side("return"))
    reward = book["reward"].where("amount > 0")
    parts = [
        dispatch_entries(spine.dispatch),
        M.constant(pickup, "pickup", amount="amount"),
        M.constant(returned, "return"),
        M.constant(spine.side("bulky"), "bulky", amount="amount", name="dispatcher_name"),
        M.constant(book["rental"], "rental", amount="amount"),
        M.constant(
            reward, "reward", amount="amount", name="dispatcher_name" if "dispatcher_name" in reward.columns else "NULL"
        ),
        *[M.constant(book[name].where("amount > 0"), name, amount="amount") for name in ("socso", "overpaid")],
        M.penalty_entries(penalties.penalty_totals(book, rules, penalties.FLEET)),
    ]
    kinds = [f"penalty:{k}" for k in penalties.KINDS]
    known = "nullif(dispatcher_name, 'Unknown')"
    totals = (
        M.totalled(parts)
        .groupBy("dispatcher_key")
        .agg(
            F.expr(
                f"coalesce(min(CASE WHEN measure IN ({literals(TIERS)}) THEN {known} END), "
                f"min(CASE WHEN measure = '{M.SEEN}' THEN {known} END), min({known}), 'Unknown') AS dispatcher_name"
            ),
            M.quantity_of(*TIERS, alias="parcels"),
            *[M.quantity_of(t, alias=f"{t}_parcels") for t in TIERS],
            M.amount_of(WEIGHED, alias="total_weight"),
            M.count_of("flagged", WEIGHED, alias="weighed"),
            M.quantity_of("pickup", alias="pickup_parcels"),
            M.money_of("pickup", alias="pickup_payout"),
            M.quantity_of("return", alias="return_parcels"),
            M.quantity_of("bulky", alias="bulky_parcels"),
            M.money_of("bulky", alias="bulky_payout"),
            M.money_of("reward", alias="reward"),
            M.money_of("rental", alias="rental"),
            *[M.money_of(f"penalty:{k}", alias=f"{k}_penalty") for k in penalties.KINDS],
            M.money_of(*kinds, alias="penalty_amount"),
            M.quantity_of(*kinds, alias="penalty_count"),
            M.money_of("socso", alias="socso_deduction"),
            M.money_of("overpaid", alias="overpaid_deduction"),
        )
    )
    if rules.route_fleet_enabled and rules.route_pool > 0:
        totals = S.with_route_share(totals, "parcels > 0", "penalty_amount", rules, stage)
    delivered = "parcels + return_parcels + bulky_parcels"
    priced = totals.selectExpr(
        "dispatcher_key",
        "dispatcher_name",
        f"{delivered} AS parcels_delivered",
        f"{delivered} + pickup_parcels AS total_awb",
        *[f"{t}_parcels" for t in TIERS],
        *delivery.weight_and_pay(rules.weight_tiers),
        "pickup_parcels",
        "pickup_payout",
        "return_parcels",
        f"{extras.return_value(rules)} AS return_payout",
        "bulky_parcels",
        "bulky_payout",
        "reward",
        "rental",
        *PENALTY_COLUMNS,
        "penalty_amount",
        "penalty_count",
        "socso_deduction",
        "overpaid_deduction",
    )
    net_pay = f"{' + '.join(EARNINGS)} - {' - '.join(DEDUCTIONS)}"
    return priced.selectExpr("*", f"cast({net_pay} AS {MONEY}) AS total_payout")


def by_name(summary: DataFrame) -> DataFrame:
    return summary.orderBy("dispatcher_name", "dispatcher_key")


_COUNTS = ("parcels_delivered", "total_awb", "pickup_parcels", "return_parcels", "bulky_parcels", "penalty_count")
_MONEY = (*EARNINGS, *PENALTY_COLUMNS, *DEDUCTIONS, "total_payout")


def fleet_totals(summary: DataFrame) -> DataFrame:
    """One row: every measure over all dispatchers, gross earnings, total deduction and net."""
    sums = summary.agg(
        F.expr("count(1) AS dispatchers"),
        *[F.expr(f"cast(coalesce(sum({c}), 0) AS bigint) AS {c}") for c in _COUNTS],
        F.expr("cast(coalesce(sum(cast(total_weight AS decimal(28,6))), 0) AS double) AS total_weight"),
        *[F.expr(f"cast(coalesce(sum({c}), 0) AS {MONEY}) AS {c}") for c in _MONEY],
    )
    return sums.selectExpr(
        "*",
        f"cast({' + '.join(EARNINGS)} AS {MONEY}) AS gross_earnings",
        f"cast({' + '.join(DEDUCTIONS)} AS {MONEY}) AS total_deduction",
    )


def top_performers(summary: DataFrame, n: int = 5) -> DataFrame:
    return summary.orderBy(F.col("total_payout").desc(), "dispatcher_key").limit(n)


def top_penalties(summary: DataFrame, n: int = 5) -> DataFrame:
    penalised = summary.where("penalty_amount > 0")
    return penalised.orderBy(F.col("penalty_amount").desc(), "dispatcher_key").limit(n)


def payout_share(summary: DataFrame) -> DataFrame:
    """Part of the fleet's total payout per dispatcher, largest first.

    The total is a scalar subquery; a window over everything would use one task.
    """
    total = summary.agg(F.sum("total_payout").cast("double")).scalar()
    pay = F.col("total_payout").cast("double")
    return summary.select(
        "dispatcher_key",
        "dispatcher_name",
        "total_payout",
        F.when(total != 0, pay / total).otherwise(0.0).alias("share"),
    ).orderBy(F.col("total_payout").desc(), "dispatcher_key")


# Report headers of the summary columns.
HEADERS = {
    "dispatcher_key": "Dispatcher ID",
    "dispatcher_name": "Dispatcher Name",
    "parcels_delivered": "Parcels Delivered",
    "total_awb": "Total AWB",
    "total_weight": "Total Weight (kg)",
    "avg_weight": "Avg Weight (kg)",
    "avg_rate": "Avg Rate per Parcel",
    "dispatch_payout": "Delivery Parcels Payout",
    "total_payout": "Total Payout",
    "penalty_amount": "Total Penalty",
    "duitnow_penalty": "DuitNow Penalty",
    "ldr_penalty": "LDR Penalty",
    "fake_attempt_penalty": "Fake Attempt Penalty",
    "cod_penalty": "COD Penalty",
    "binding_penalty": "Binding Penalty",
    "hub_penalty": "Hub Penalty",
    "socso_deduction": "SOCSO",
    "overpaid_deduction": "Overpaid",
    "pending_parcel_penalty": "Pending Parcel Penalty",
    "no_outbound_scan_penalty": "No Outbound Scan Penalty",
    "parcel_lost_penalty": "Parcel Lost Penalty",
    "route_penalty": "Route Penalty",
    "attendance_penalty": "Attendance Penalty",
    "pickup_parcels": "Pickup Parcels",
    "pickup_payout": "Pickup Payout",
    "return_parcels": "Return Parcels",
    "return_payout": "Return Parcels Payout",
    "bulky_parcels": "Bulky Parcels",
    "bulky_payout": "Bulky Parcels Payout",
    "reward": "Reward",
    "rental": "Rental",
    "tier1_parcels": "Parcels 0-5kg",
    "tier2_parcels": "Parcels 5.01-10kg",
    "tier3_parcels": "Parcels 10.01-30kg",
    "tier4_parcels": "Parcels 30+kg",
}

_SHOWN_AS_DEDUCTION = {*PENALTY_COLUMNS, *DEDUCTIONS}
_SHOWN_AS_MONEY = {*EARNINGS, "total_payout", "avg_rate"}
_SHOWN_AS_WEIGHT = {"total_weight", "avg_weight"}


def money_text(amount: str, currency: str) -> str:
    return f"concat({literal(currency)}, format_number({amount}, 2))"


def deduction_text(amount: str, currency: str) -> str:
    zero = literal(f"{currency}0.00")
    return f"CASE WHEN {amount} > 0 THEN concat('-', {money_text(amount, currency)}) ELSE {zero} END"


def fleet_display(summary: DataFrame, rules: Rules) -> DataFrame:
    """Summary in report form: headers, money text, deductions with a minus sign; by name."""
    shown = []
    for column, header in HEADERS.items():
        value = column
        if column in _SHOWN_AS_DEDUCTION:
            value = deduction_text(column, rules.currency)
        elif column in _SHOWN_AS_MONEY:
            value = money_text(column, rules.currency)
        elif column in _SHOWN_AS_WEIGHT:
            value = f"format_string('%.2f', {column})"
        shown.append(f"{value} AS `{header}`")
    return by_name(summary).selectExpr(*shown)


def pickup_detail(pickup: DataFrame) -> DataFrame:
    """Distinct waybills per pickup dispatcher id, most first."""
    return (
        pickup.where("dispatcher_id IS NOT NULL")
        .groupBy("dispatcher_id")
        .agg(F.count_distinct("waybill").alias("pickup_parcels"))
        .orderBy(F.col("pickup_parcels").desc(), "dispatcher_id")
    )


def return_detail(returned: DataFrame) -> DataFrame:
    """Return rows per dispatcher, most first."""
    return (
        returned.where("dispatcher_key IS NOT NULL")
        .groupBy("dispatcher_key")
        .agg(F.count(F.lit(1)).alias("return_parcels"))
        .orderBy(F.col("return_parcels").desc(), "dispatcher_key")
    )
