"""Penalties as one ledger of ten sheet kinds plus the route share."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import MONEY, PARSED, round_money
from parcelpay.functions.sql import case, literal, literals
from parcelpay.operators.ranking import split_pool
from parcelpay.operators.unions import union_all
from parcelpay.sources.stage import Stage
from parcelpay.sources.workbook import Workbook

STATEMENT = "statement"
FLEET = "fleet"

SHEET_KINDS = (
    "duitnow", "ldr", "fake_attempt", "cod", "binding", "hub", "pending_parcel", "no_outbound_scan",
    "parcel_lost", "attendance",
)
KINDS = (
    "duitnow", "ldr", "fake_attempt", "cod", "binding", "hub", "pending_parcel", "no_outbound_scan",
    "parcel_lost", "route", "attendance",
)

ROWS = "rows"
DISTINCT = "distinct"
ONE_IF_ANY = "one_if_any"
POSITIVE_ROWS = "positive_rows"
NONE = "none"


@dataclass(frozen=True)
class KindRule:
    """How one kind turns its rows into an amount and a count.

    ``amount`` is the column to sum, or None where only parcels are priced: ``row_price`` per row,
    ``parcel_price`` per distinct waybill (per row where no waybill is known).
    """

    kind: str
    amount: str | None = None
    count: str = ROWS
    positive_only: bool = False
    failed_only: bool = False
    row_price: Decimal | None = None
    parcel_price: Decimal | None = None

    @property
    def distinct(self) -> bool:
        return self.count == DISTINCT or self.parcel_price is not None


def kind_rules(book: Workbook, rules: Rules, profile: str = STATEMENT) -> list[KindRule]:
    """Rules of the present penalty sheets, for the dispatcher statement or the fleet summary."""
    if profile not in (STATEMENT, FLEET):
        raise ValueError(f"profile must be {STATEMENT!r} or {FLEET!r}, not {profile!r}")
    fleet = profile == FLEET
    columns = {k: book[k].columns for k in SHEET_KINDS if k in book.sheets}
    out = [
        KindRule("duitnow", "amount", ROWS if fleet else ONE_IF_ANY, positive_only=fleet, failed_only=True),
        KindRule("fake_attempt", row_price=rules.fake_attempt_rate),
        KindRule("cod", "amount", positive_only=fleet),
        KindRule("binding", "amount", positive_only=True),
        KindRule("hub", "amount", positive_only=True),
        KindRule("no_outbound_scan", count=DISTINCT, parcel_price=rules.no_outbound_scan_rate),
        KindRule("parcel_lost", "amount", positive_only=fleet),
    ]
    if "amount" in columns.get("pending_parcel", ()):
        out.append(KindRule("pending_parcel", "amount", DISTINCT, positive_only=fleet))
    else:
        out.append(KindRule("pending_parcel", count=DISTINCT, parcel_price=rules.pending_parcel_rate))
    ldr = columns.get("ldr", ())
    if fleet:
        amount = next((c for c in ("penalty", "amount") if c in ldr), None)
        if amount is None:
            out.append(KindRule("ldr", parcel_price=rules.ldr_legacy_rate))
        else:
            out.append(KindRule("ldr", amount, positive_only=True))
        if rules.attendance_penalty_fleet_enabled:
            out.append(KindRule("attendance", "amount_plain", NONE, positive_only=True))
    else:
        if "amount" in ldr:
            out.append(KindRule("ldr", "amount"))
        out.append(KindRule("attendance", "amount", POSITIVE_ROWS))
    return sorted((r for r in out if r.kind in columns), key=lambda r: KINDS.index(r.kind))


def _ledger_part(sheet: DataFrame, rule: KindRule, row_rounding: bool) -> DataFrame:
    rows = sheet.where("dispatcher_key IS NOT NULL")
    if rule.failed_only and "failed" in sheet.columns:
        rows = rows.where("failed")
    if rule.positive_only and rule.amount is not None:
        rows = rows.where(f"{rule.amount} > 0")
    amount = rule.amount or literal(rule.row_price or Decimal(0))
    if row_rounding:
        amount = f"round({amount}, 2)"
    waybill = "waybill" if "waybill" in sheet.columns else "cast(NULL AS string)"
    day = "event_ts" if "event_ts" in sheet.columns else "NULL"
    return rows.selectExpr(
        "dispatcher_key",
        "dispatcher_id",
        f"'{rule.kind}' AS kind",
        f"{waybill} AS waybill",
        f"cast({amount} AS {PARSED}) AS amount",
        f"cast({day} AS timestamp_ntz) AS event_ts",
    )


def empty_ledger(book: Workbook) -> DataFrame:
    return book.spark.createDataFrame(
        [],
        f"dispatcher_key string, dispatcher_id string, kind string, waybill string, amount {PARSED}, "
        "event_ts timestamp_ntz",
    )


def ledger(book: Workbook, rules: Rules, profile: str = STATEMENT, kinds: tuple[str, ...] = SHEET_KINDS) -> DataFrame:
    """All penalty records in one relation, after the filters of the profile.

    The fleet profile rounds every record; the statement rounds sums. Kinds priced by distinct
    waybill carry amount 0 here and get their price in ``penalty_totals``.
    """
    parts = [
        _ledger_part(book[r.kind], r, row_rounding=profile == FLEET)
        for r in kind_rules(book, rules, profile)
        if r.kind in kinds
    ]
    return union_all(parts) if parts else empty_ledger(book)


def _per_kind(rules: list[KindRule], value) -> str:
    """CASE over the kind with a driver-side expression per rule."""
    return case([(f"kind = '{r.kind}'", value(r)) for r in rules], "NULL")


def _parcels(r: KindRule) -> str:
    # Scans without a waybill never count; other parcels fall back to rows.
    return "waybills" if r.kind == "no_outbound_scan" else "CASE WHEN waybills > 0 THEN waybills ELSE records END"


def _amount(r: KindRule) -> str:
    if r.parcel_price is None:
        return round_money("amount")
    return round_money(f"({_parcels(r)}) * {literal(r.parcel_price)}")


def _count(r: KindRule) -> str:
    return {
        ROWS: "records",
        DISTINCT: _parcels(r),
        ONE_IF_ANY: f"CASE WHEN {round_money('amount')} > 0 THEN 1 ELSE 0 END",
        POSITIVE_ROWS: "positive",
        NONE: "0",
    }[r.count]


def penalty_totals(
    book: Workbook, rules: Rules, profile: str = STATEMENT, kinds: tuple[str, ...] = SHEET_KINDS
) -> DataFrame:
    """(dispatcher_key, kind, amount, parcels) per dispatcher and kind.

    Two aggregations: by distinct waybill where the kind needs it (other kinds group under NULL
    and collapse before the shuffle), then by kind. A dispatcher with most of the records is thus
    spread over its waybills.
    """
    chosen = [r for r in kind_rules(book, rules, profile) if r.kind in kinds]
    rows = ledger(book, rules, profile, kinds)
    if not chosen:
        return rows.selectExpr("dispatcher_key", "kind", f"cast(amount AS {MONEY}) AS amount", "0L AS parcels")
    by_waybill = [r.kind for r in chosen if r.distinct]
    counted = f"CASE WHEN kind IN ({literals(by_waybill)}) THEN waybill END" if by_waybill else "cast(NULL AS string)"
    return (
        rows.groupBy("dispatcher_key", "kind", F.expr(counted).alias("counted_waybill"))
        .agg(
            F.expr("sum(amount) AS amount"),
            F.expr("count(1) AS records"),
            F.expr("count_if(amount > 0) AS positive"),
        )
        .groupBy("dispatcher_key", "kind")
        .agg(
            F.expr("sum(amount) AS amount"),
            F.expr("sum(records) AS records"),
            F.expr("sum(positive) AS positive"),
            F.expr("count(counted_waybill) AS waybills"),
        )
        .selectExpr(
            "dispatcher_key",
            "kind",
            f"{_per_kind(chosen, _amount)} AS amount",
            f"cast({_per_kind(chosen, _count)} AS bigint) AS parcels",
        )
    )


def route_shares(dispatcher_keys: DataFrame, rules: Rules, stage: Stage | None = None) -> DataFrame:
    """(dispatcher_key, kind, amount, parcels) of the route pool split over the distinct dispatchers given."""
    cents = int((rules.route_pool * 100).to_integral_value())
    shares = split_pool(dispatcher_keys, cents, stage=stage)
    return shares.where("share > 0").selectExpr(
        "dispatcher_key", "'route' AS kind", "share AS amount", "1L AS parcels"
    )


def by_kind(totals: DataFrame) -> DataFrame:
    """Fleet totals per kind."""
    return totals.groupBy("kind").agg(
        F.expr(f"cast(sum(amount) AS {MONEY}) AS amount"),
        F.expr("sum(parcels) AS parcels"),
        F.expr("count(1) AS dispatchers"),
    )


def wide(totals: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per dispatcher: amount per kind, total amount and total count."""
    return totals.groupBy("dispatcher_key").agg(
        *[
            F.expr(f"cast(coalesce(sum(CASE WHEN kind = '{k}' THEN amount END), 0) AS {MONEY}) AS {k}_penalty")
            for k in kinds
        ],
        F.expr(f"cast(sum(amount) AS {MONEY}) AS penalty_amount"),
        F.expr("sum(parcels) AS penalty_count"),
    )


def dedupe_first(sheet: DataFrame) -> DataFrame:
    """One row per dispatcher and waybill with its earliest date.

    An aggregation, not a numbered window: copies of a hot pair collapse before the shuffle.
    """
    rows = sheet.where("dispatcher_key IS NOT NULL AND waybill IS NOT NULL")
    first = [F.min("event_ts").alias("event_ts")] if "event_ts" in sheet.columns else []
    return rows.groupBy("dispatcher_key", "waybill").agg(*first, F.expr("count(1) AS records"))


def penalty_waybills(rows: DataFrame) -> DataFrame:
    """Distinct penalised waybills per dispatcher and kind, with their records and amount."""
    return (
        rows.where("waybill IS NOT NULL")
        .groupBy("dispatcher_key", "kind", "waybill")
        .agg(F.expr("count(1) AS records"), F.expr("sum(amount) AS amount"))
    )


def waybills_display(rows: DataFrame, limit: int = 5) -> DataFrame:
    """(dispatcher_key, kind, waybills, shown): first waybills as text, then "(+k more)".

    The rank filter lets Spark keep only the first few per group before the shuffle, so a group of
    any size costs its first ``limit`` rows and a count.
    """
    distinct = penalty_waybills(rows).select("dispatcher_key", "kind", "waybill")
    rank = "row_number() OVER (PARTITION BY dispatcher_key, kind ORDER BY waybill)"
    first = (
        distinct.selectExpr("*", f"{rank} AS n")
        .where(f"n <= {limit}")
        .groupBy("dispatcher_key", "kind")
        .agg(F.expr("array_sort(collect_list(waybill)) AS first"))
    )
    sizes = distinct.groupBy("dispatcher_key", "kind").agg(F.expr("count(1) AS waybills"))
    more = f"CASE WHEN waybills > {limit} THEN concat(' (+', waybills - {limit}, ' more)') ELSE '' END"
    return sizes.join(first, ["dispatcher_key", "kind"]).selectExpr(
        "dispatcher_key", "kind", "waybills", f"concat(concat_ws(', ', first), {more}) AS shown"
    )


def penalty_detail(book: Workbook, rules: Rules, profile: str = FLEET) -> DataFrame:
    """One row per penalised waybill, with its own amount and the dispatcher's total.

    A dispatcher whose penalties name no waybill gets one row "n parcels". Dispatchers without
    counted parcels are left out.
    """
    # Grouped by the key as a struct: the join below then shuffles both sides itself and may split
    # a dispatcher with very many waybills.
    totals = (
        penalty_totals(book, rules, profile)
        .groupBy(F.struct("dispatcher_key").alias("key"))
        .agg(F.expr(f"cast(sum(amount) AS {MONEY}) AS penalty_amount"), F.expr("sum(parcels) AS penalty_count"))
        .where("penalty_count > 0")
        .select("key.dispatcher_key", "penalty_amount", "penalty_count")
    )
    prices = [r for r in kind_rules(book, rules, profile) if r.parcel_price is not None]
    own = _per_kind(prices, lambda r: literal(r.parcel_price))
    lines = penalty_waybills(ledger(book, rules, profile)).selectExpr(
        "dispatcher_key", "kind", "waybill", f"{round_money(f'coalesce({own}, amount)')} AS record_amount"
    )
    summary = totals.join(lines.select("dispatcher_key").distinct(), "dispatcher_key", "left_anti").selectExpr(
        "dispatcher_key",
        "cast(NULL AS string) AS kind",
        "concat(penalty_count, ' parcels') AS waybill",
        "penalty_amount AS record_amount",
        "penalty_amount AS dispatcher_penalty",
    )
    detailed = lines.join(totals, "dispatcher_key").select(
        *lines.columns, F.col("penalty_amount").alias("dispatcher_penalty")
    )
    return detailed.unionByName(summary)
