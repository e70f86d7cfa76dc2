"""Raw sheets to canonical sheets.

A canonical sheet has typed columns with fixed names. Optional columns that the source lacks are
left out, so plans decide on the driver, by ``df.columns``, which rule applies. ``event_ts`` is the
date column of every dated sheet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelpay.functions import dates, numbers, text
from parcelpay.functions.sql import literal, name as quoted
from parcelpay.sources import headers as H

Parser = Callable[[str, T.DataType], str]


def _text(parse: Callable[[str], str]) -> Parser:
    return lambda x, kind: parse(x)


def _failed(x: str, kind: T.DataType) -> str:
    return f"coalesce(upper({text.strip(x)}) = 'FAIL', false)"


@dataclass(frozen=True)
class Field:
    target: str
    roles: tuple[H.Role, ...]
    parse: Parser
    kind: str
    required: bool = False
    default: str | None = None


def _id(*roles: H.Role) -> tuple[Field, Field]:
    return (
        Field("dispatcher_key", roles, _text(text.dispatcher_key), "string", required=True),
        Field("dispatcher_id", roles, _text(text.penalty_id), "string", required=True),
    )


def _waybill(role: H.Role, required: bool = False) -> Field:
    return Field("waybill", (role,), _text(text.waybill), "string", required=required)


def _when(role: H.Role, required: bool = False) -> Field:
    return Field("event_ts", (role,), dates.timestamp, "timestamp_ntz", required=required)


def _amount(parse: Parser, *roles: H.Role, target: str = "amount", required: bool = False) -> Field:
    return Field(target, roles, parse, numbers.PARSED, required=required)


_NAME = Field("dispatcher_name", (H.DISPATCHER_NAME,), _text(text.dispatcher_name), "string")
_WEIGHT = Field("weight", (H.WEIGHT,), numbers.weight, "double")

SHEETS: dict[str, tuple[Field, ...]] = {
    "dispatch": (
        *_id(H.DISPATCHER),
        Field("dispatcher_name", (H.DISPATCHER_NAME,), _text(text.dispatcher_name), "string", default="Unknown"),
        _waybill(H.WAYBILL, required=True),
        _when(H.DELIVERY_DATE, required=True),
        _WEIGHT,
    ),
    "pickup": (
        *_id(H.DISPATCHER),
        _waybill(H.WAYBILL, required=True),
        _when(H.PICKUP_DATE),
        Field("order_source", (H.ORDER_SOURCE,), _text(text.order_source), "string"),
        _amount(numbers.money, H.WEIGHT, target="billing_weight"),
        _amount(numbers.money, H.COMMISSION, target="commission"),
    ),
    "return": (*_id(H.RETURN_DISPATCHER), _waybill(H.WAYBILL, required=True), _when(H.RETURN_DATE)),
    "bulky": (*_id(H.DISPATCHER), _NAME, _waybill(H.WAYBILL, required=True), _when(H.BULKY_DATE), _WEIGHT),
    "reward": (*_id(H.EMPLOYEE, H.DISPATCHER), _NAME, _amount(numbers.plain_number, H.AMOUNT, required=True)),
    "rental": (*_id(H.DISPATCHER), _amount(numbers.plain_number, H.AMOUNT, required=True)),
    "attendance": (
        *_id(H.DISPATCHER),
        _amount(numbers.comma_decimal, H.ATTENDANCE_PENALTY, required=True),
        _amount(numbers.plain_number, H.ATTENDANCE_PENALTY, target="amount_plain"),
        _when(H.ATTENDANCE_DATE),
    ),
    "duitnow": (
        *_id(H.DISPATCHER),
        _amount(numbers.money, H.PENALTY, required=True),
        Field("failed", (H.ACHIEVE,), _failed, "boolean"),
        _when(H.CREATED_DATE),
    ),
    "ldr": (
        *_id(H.DISPATCHER),
        _waybill(H.PENALTY_WAYBILL),
        _amount(numbers.money, H.AMOUNT),
        _amount(numbers.money, H.PENALTY, target="penalty"),
        _when(H.CREATED_DATE),
    ),
    "fake_attempt": (*_id(H.DISPATCHER), _waybill(H.PENALTY_WAYBILL), _when(H.PLAIN_DATE)),
    "cod": (*_id(H.DISPATCHER), _amount(numbers.money, H.PENALTY, required=True), _when(H.CREATED_DATE)),
    "binding": (*_id(H.DISPATCHER), _amount(numbers.money, H.PENALTY, required=True), _when(H.CREATED_DATE)),
    "hub": (*_id(H.DISPATCHER), _amount(numbers.money, H.AMOUNT, required=True), _when(H.CREATED_DATE)),
    "socso": (*_id(H.DISPATCHER), _amount(numbers.money, H.AMOUNT, required=True), _when(H.CREATED_DATE)),
    "overpaid": (*_id(H.DISPATCHER), _amount(numbers.money, H.AMOUNT, required=True), _when(H.CREATED_DATE)),
    "pending_parcel": (
        *_id(H.DISPATCHER),
        _waybill(H.PENALTY_WAYBILL),
        _amount(numbers.money, H.ANY_AMOUNT),
        _when(H.CREATED_DATE),
    ),
    "no_outbound_scan": (*_id(H.DISPATCHER), _waybill(H.PENALTY_WAYBILL), _when(H.SCAN_DATE)),
    "parcel_lost": (
        *_id(H.DISPATCHER),
        _waybill(H.PENALTY_WAYBILL),
        _amount(numbers.money, H.ANY_AMOUNT, required=True),
        _when(H.CREATED_DATE),
    ),
}

PENALTY_SHEETS = (
    "duitnow", "ldr", "fake_attempt", "cod", "binding", "hub", "pending_parcel", "no_outbound_scan",
    "parcel_lost", "attendance",
)


def canonical_schema(name: str) -> T.StructType:
    parts = ", ".join(f"{f.target} {f.kind}" for f in SHEETS[name])
    return T.StructType.fromDDL(parts)


def empty_sheet(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], canonical_schema(name))


def missing_columns(name: str, columns: list[str]) -> list[str]:
    """Required canonical columns that no source header can supply."""
    return [f.target for f in SHEETS[name] if f.required and _source(name, f, columns) is None]


def require_columns(name: str, df: DataFrame) -> None:
    missing = missing_columns(name, df.columns)
    if missing:
        raise ValueError(
            f"sheet {name!r} is missing required columns: {', '.join(missing)}; "
            f"available columns: {', '.join(df.columns)}"
        )


def _source(name: str, field: Field, columns: list[str]) -> str | None:
    if name == "pickup" and field.target.startswith("dispatcher_"):
        ids = H.pickup_dispatcher_columns(columns)
        return ids[0] if ids else None
    for role in field.roles:
        found = role.find(columns)
        if found is not None:
            return found
    return None


def canonicalize(name: str, raw: DataFrame) -> DataFrame:
    """Typed canonical sheet; one projection, so unused source columns are never read.

    Raises ``ValueError`` when a required column has no source.
    """
    require_columns(name, raw)
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    out: list[str] = []
    for field in SHEETS[name]:
        if name == "pickup" and field.target.startswith("dispatcher_"):
            ids = H.pickup_dispatcher_columns(raw.columns)
            parsed = f"coalesce({', '.join(field.parse(quoted(c), kinds[c]) for c in ids)})"
        else:
            source = _source(name, field, raw.columns)
            if source is not None:
                parsed = field.parse(quoted(source), kinds[source])
                if field.default is not None:
                    parsed = f"coalesce({parsed}, {literal(field.default)})"
            elif field.default is not None:
                parsed = literal(field.default)
            else:
                continue
        out.append(f"{parsed} AS {field.target}")
    sheet = raw.selectExpr(*out)
    if name == "no_outbound_scan":
        sheet = sanitize_scans(sheet)
    return sheet


def sanitize_scans(sheet: DataFrame) -> DataFrame:
    """Scan rows with a dispatcher and a waybill; pivot and summary rows go."""
    needed = [c for c in ("dispatcher_key", "waybill") if c in sheet.columns]
    return sheet.where(" AND ".join(f"{c} IS NOT NULL" for c in needed))
