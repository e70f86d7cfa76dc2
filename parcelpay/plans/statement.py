"""Statement per dispatcher: delivery pay, extras, bonuses, penalties, gross, advance, final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import MONEY, round_money
from parcelpay.functions.sql import literal
from parcelpay.functions.text import dispatcher_key
from parcelpay.operators import delivery, extras, penalties
from parcelpay.operators.overlap import net_dispatch
from parcelpay.plans import measures as M
from parcelpay.plans import spine as S
from parcelpay.sources.stage import Stage
from parcelpay.sources.workbook import Workbook


def paid_days(book: Workbook, rules: Rules, count: str = "rows", net: DataFrame | None = None) -> DataFrame:
    """Daily pay of all dispatchers after the overlap exclusions, bulky rows included.

    ``net`` is the net dispatch if the caller has it stored.
    """
    if net is None:
        net = net_dispatch(book["dispatch"], book["return"], book["pickup"], book["bulky"])
    return delivery.tiered_daily_pay(delivery.daily_parcels(net, book["bulky"], count), rules)


def _days(book: Workbook, rules: Rules, count: str, spine: S.Spine) -> list[DataFrame]:
    """Entries of the daily pay and of the dispatchers seen."""
    measure = "WHEN special_rate IS NULL THEN 'day' ELSE 'special_day' END"
    values = dict(
        quantity="daily_parcels", amount="payout_per_day", flagged=f"daily_parcels >= {rules.attendance.min_parcels_per_day}"
    )
    if count != "rows":
        days = M.entries(paid_days(book, rules, count), f"CASE {measure}", **values)
        return [days, M.constant(spine.dispatch, M.SEEN, seen="1")]
    days = delivery.tiered_daily_pay(S.daily_parcels(spine), rules, keep=("dispatch_rows",))
    return [M.entries(days, f"CASE WHEN daily_parcels = 0 THEN '{M.SEEN}' {measure}", seen="dispatch_rows", **values)]


def statement(
    book: Workbook, rules: Rules, count: str = "rows", spine: S.Spine | None = None, stage: Stage | None = None
) -> DataFrame:
    """One row per dispatcher known to any sheet.

    Every sheet is read once: the small parcel sheets are stored in ``stage`` first (see ``plans.spine``), unless the
    caller has a spine of the same workbook and rules. With the route penalty the totals are stored, too, before they
    are split. ``count`` "distinct" counts distinct waybills a day; the parcel sheets are then read again for them.
    """
    stage = stage or Stage(book.spark)
    spine = spine or S.build(book, rules, stage)
    pickup, returned = extras.countable(spine.side("pickup")), extras.countable(spine.side("return"))
    parts = [
        *_days(book, rules, count, spine),
        M.constant(pickup, "pickup", amount="amount"),
        M.constant(returned, "return"),
        *[
            M.constant(book[name].where("amount > 0"), name, amount="amount")
            for name in ("reward", "socso", "overpaid")
        ],
        M.penalty_entries(penalties.penalty_totals(book, rules, penalties.STATEMENT)),
    ]
    days = ("day", "special_day")
    kinds = [f"penalty:{k}" for k in penalties.KINDS]
    totals = (
        M.totalled(parts)
        .groupBy("dispatcher_key")
        .agg(
            M.quantity_of(*days, alias="delivery_parcels"),
            M.count_of("rows", *days, alias="working_days"),
            M.count_of("flagged", *days, alias="qualified_days"),
            M.amount_of(*days, alias="day_pay"),
            M.money_of("special_day", alias="special_pay"),
            M.quantity_of("pickup", alias="pickup_parcels"),
            M.money_of("pickup", alias="pickup_payout"),
            M.quantity_of("return", alias="return_parcels"),
            M.count_of("rows", "reward", alias="reward_count"),
            M.money_of("reward", alias="reward_payout"),
            *[M.money_of(f"penalty:{k}", alias=f"{k}_penalty") for k in penalties.KINDS],
            M.money_of(*kinds, alias="penalty_total"),
            M.quantity_of(*kinds, alias="penalty_count"),
            M.money_of("socso", alias="socso_deduction"),
            M.money_of("overpaid", alias="overpaid_deduction"),
            F.expr("sum(seen) > 0 AS on_dispatch"),
        )
        .selectExpr(
            "*",
            f"{delivery.is_designated('dispatcher_key', rules.designated)} AS designated",
            f"{extras.return_value(rules)} AS return_payout",
        )
    )
    if rules.route_statement_enabled and rules.route_pool > 0:
        totals = S.with_route_share(totals, "on_dispatch", "penalty_total", rules, stage)
    return settle(delivery.with_bonuses(totals, rules), rules).select(
        "dispatcher_key",
        "designated",
        "delivery_parcels",
        "working_days",
        "base_payout",
        "special_pay",
        "kpi_bonus",
        "kpi_description",
        "qualified_days",
        "attendance_bonus",
        "attendance_description",
        "pickup_parcels",
        "pickup_payout",
        "return_parcels",
        "return_payout",
        "reward_count",
        "reward_payout",
        *[f"{k}_penalty" for k in penalties.KINDS],
        "penalty_total",
        "penalty_count",
        "socso_deduction",
        "overpaid_deduction",
        "total_awb",
        "gross_payout",
        "advance_payout",
        "final_payout",
    )


def settle(totals: DataFrame, rules: Rules) -> DataFrame:
    """Gross, advance, final and total AWB from the components.

    The advance is a share of base delivery pay only. SOCSO and overpaid amounts are deductions,
    not penalties.
    """
    gross = (
        "base_payout + pickup_payout + return_payout + reward_payout + kpi_bonus + attendance_bonus "
        "- penalty_total - socso_deduction - overpaid_deduction"
    )
    advance = f"cast(0 AS {MONEY})"
    if rules.advance.enabled and rules.advance.percentage > 0:
        advance = round_money(f"base_payout * {literal(rules.advance.percentage)} / 100")
    return totals.selectExpr(
        "*",
        "delivery_parcels + pickup_parcels + return_parcels AS total_awb",
        f"cast({gross} AS {MONEY}) AS gross_payout",
        f"{advance} AS advance_payout",
    ).selectExpr("*", f"cast(gross_payout - advance_payout AS {MONEY}) AS final_payout")


def for_dispatcher(report: DataFrame, dispatcher: str) -> DataFrame:
    """One dispatcher's rows of any per-dispatcher report, under any spelling of the id."""
    return report.where(f"dispatcher_key = {dispatcher_key(literal(dispatcher))}")


def daily_breakdown(days: DataFrame, rules: Rules) -> DataFrame:
    """Daily rows in display form; a day within the basic amount shows "Basic" instead of a rate."""
    currency = literal(rules.currency)
    return days.selectExpr(
        "dispatcher_key",
        "delivery_date AS date",
        "daily_parcels AS total_parcel",
        "tier",
        f"""CASE WHEN designated AND rate_per_parcel = 0 THEN 'Basic'
                 ELSE concat({currency}, cast(rate_per_parcel AS {MONEY})) END AS payout_rate""",
        f"concat({currency}, {round_money('payout_per_day')}) AS payout",
    )
