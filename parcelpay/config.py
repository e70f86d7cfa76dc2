"""Pay rules as frozen dataclasses, loadable from a JSON file with per-key defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import date
from decimal import Decimal
from typing import Any


def money(value: Any) -> Decimal:
    """Exact decimal of a configured number (never through binary floating point)."""
    return Decimal(str(value))


@dataclass(frozen=True)
class Tier:
    """Per-parcel rate for days whose parcel count lies in ``[low, high]``; ``None`` is open."""

    name: str
    low: int | None
    high: int | None
    rate: Decimal


@dataclass(frozen=True)
class SpecialRate:
    """Rate for all parcels of a day in ``[start, end]`` with strictly more than ``min_parcels``."""

    start: date
    end: date
    rate: Decimal
    description: str = "Special Rate"
    min_parcels: int = 160


@dataclass(frozen=True)
class Kpi:
    parcels: int
    bonus: Decimal
    description: str


@dataclass(frozen=True)
class AttendanceRule:
    enabled: bool = True
    required_days: int = 26
    min_parcels_per_day: int = 30
    bonus: Decimal = Decimal("100")


@dataclass(frozen=True)
class AdvanceRule:
    enabled: bool = True
    percentage: Decimal = Decimal("40")


@dataclass(frozen=True)
class BulkyRates:
    under: Decimal = Decimal("4.00")
    over: Decimal = Decimal("5.00")
    threshold: float = 50.0


@dataclass(frozen=True)
class DesignatedDriver:
    """Drivers with a basic amount that covers the first ``basic_parcels`` parcels."""

    ids: tuple[str, ...] = ()
    basic_amount: Decimal = Decimal("1700")
    basic_parcels: int = 700
    rate_after_basic: Decimal = Decimal("1.0")
    kpi: tuple[Kpi, ...] = (
        Kpi(3500, Decimal("100"), "3500 Parcel/month"),
        Kpi(4500, Decimal("150"), "4500 Parcel/month"),
    )


@dataclass(frozen=True)
class WeightTiers:
    """Rates of the four weight tiers.

    A parcel is in tier 4 above ``cut3`` kg, tier 3 from ``cut2``, tier 2 from ``cut1``,
    otherwise (also without a weight) in tier 1.
    """

    rates: tuple[Decimal, Decimal, Decimal, Decimal] = (
        Decimal("1.50"), Decimal("1.60"), Decimal("2.70"), Decimal("4.00"),
    )
    cut1: float = 5.01
    cut2: float = 10.01
    cut3: float = 30.0


# Pickup commission by order source.
STANDARD_PICKUP_SOURCES = (
    "TT-RETURN", "LAZADA-RETURN", "SHEIN-RETURN", "CAINIAO-RETURN", "APP-ANDROID",
    "APP-IOS", "APP-HORMONY", "WEBSITE", "WHATSAPP", "WECHAT",
)


@dataclass(frozen=True)
class PickupCommission:
    qr_source: str = "JTD QR"
    qr: Decimal = Decimal("1.80")
    weighed_source: str = "EASYPARCEL"
    weighed_threshold_kg: Decimal = Decimal("10")
    weighed_low: Decimal = Decimal("1.00")
    weighed_high: Decimal = Decimal("3.00")
    standard_sources: tuple[str, ...] = STANDARD_PICKUP_SOURCES
    standard: Decimal = Decimal("1.00")
    other: Decimal = Decimal("0.05")


@dataclass(frozen=True)
class Rules:
    """All pay rules of a settlement run. Defaults are the production values."""

    currency: str = "RM"
    tiers: tuple[Tier, ...] = (
        Tier("Tier 3", 0, 60, Decimal("0.95")),
        Tier("Tier 2", 61, 120, Decimal("1.00")),
        Tier("Tier 1", 121, None, Decimal("1.10")),
    )
    kpi: tuple[Kpi, ...] = (
        Kpi(3000, Decimal("100"), "3000 Parcel/month"),
        Kpi(4000, Decimal("150"), "4000 Parcel/month"),
    )
    special_rates: tuple[SpecialRate, ...] = ()
    attendance: AttendanceRule = field(default_factory=AttendanceRule)
    advance: AdvanceRule = field(default_factory=AdvanceRule)
    weight_tiers: WeightTiers = field(default_factory=WeightTiers)
    bulky: BulkyRates = field(default_factory=BulkyRates)
    designated: DesignatedDriver = field(default_factory=DesignatedDriver)
    pickup: PickupCommission = field(default_factory=PickupCommission)
    pickup_rate: Decimal = Decimal("1.00")
    return_rate: Decimal = Decimal("0.50")
    flat_rate: Decimal = Decimal("1.50")
    fake_attempt_rate: Decimal = Decimal("2.00")
    pending_parcel_rate: Decimal = Decimal("2.00")
    no_outbound_scan_rate: Decimal = Decimal("3.00")
    ldr_legacy_rate: Decimal = Decimal("100")
    route_pool: Decimal = Decimal("0")
    route_statement_enabled: bool = False
    route_fleet_enabled: bool = False
    attendance_penalty_fleet_enabled: bool = False
    forecast_days: int = 30

    def with_(self, **changes: Any) -> "Rules":
        return replace(self, **changes)

    @classmethod
    def from_json(cls, path: str) -> "Rules":
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(json.load(handle))

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> "Rules":
        """Rules from a parsed configuration; every absent key keeps its default."""
        out: dict[str, Any] = {}
        if "tiers" in raw:
            out["tiers"] = tuple(
                Tier(str(t.get("Tier")), t.get("Min Parcels"), t.get("Max Parcels"), money(t["Rate (RM)"]))
                for t in raw["tiers"]
                if t.get("Rate (RM)") is not None
            )
        if "kpi_incentives" in raw:
            out["kpi"] = _kpi(raw["kpi_incentives"])
        if "special_rates" in raw:
            out["special_rates"] = tuple(s for s in map(_special_rate, raw["special_rates"]) if s)
        if "attendance_incentive" in raw:
            a = raw["attendance_incentive"] or {}
            out["attendance"] = AttendanceRule(
                bool(a.get("enabled", False)),
                int(a.get("required_days", 26)),
                int(a.get("min_parcels_per_day", 30)),
                money(a.get("bonus", 0)),
            )
        if "advance_payout" in raw:
            a = raw["advance_payout"] or {}
            out["advance"] = AdvanceRule(bool(a.get("enabled", False)), money(a.get("percentage", 0)))
        if "weight_tiers" in raw:
            rates = tuple(money(t["rate"]) for t in sorted(raw["weight_tiers"], key=lambda t: t["min"]))
            if not rates:
                raise ValueError("weight_tiers must hold at least one rate")
            # The heaviest tier given also prices all heavier ones.
            out["weight_tiers"] = WeightTiers((rates + rates[-1:] * 3)[:4])
        if "bulky_rates" in raw:
            b = raw["bulky_rates"]
            out["bulky"] = BulkyRates(
                money(b.get("under_50", 4)), money(b.get("over_50", 5)), float(b.get("weight_threshold", 50))
            )
        if "designated_driver" in raw:
            out["designated"] = _designated(raw["designated_driver"] or {})
        plain = {
            "currency_symbol": ("currency", str),
            "pickup_payout_per_parcel": ("pickup_rate", money),
            "return_payout_per_parcel": ("return_rate", money),
            "fake_attempt_penalty_per_parcel": ("fake_attempt_rate", money),
            "pending_parcel_penalty_per_parcel": ("pending_parcel_rate", money),
            "no_outbound_scan_penalty_per_parcel": ("no_outbound_scan_rate", money),
            "route_penalty_amount": ("route_pool", money),
            "route_penalty_app_enabled": ("route_statement_enabled", bool),
            "route_penalty_management_enabled": ("route_fleet_enabled", bool),
            "attendance_penalty_management_enabled": ("attendance_penalty_fleet_enabled", bool),
            "forecast_days": ("forecast_days", int),
        }
        for key, (name, convert) in plain.items():
            if raw.get(key) is not None:
                out[name] = convert(raw[key])
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in out.items() if k in known})


def _kpi(rows: Any) -> tuple[Kpi, ...]:
    return tuple(
        Kpi(
            int(r.get("parcels", 0)),
            money(r.get("bonus", 0)),
            r.get("description", f"{r.get('parcels', 0)} parcels"),
        )
        for r in rows or ()
    )


def _special_rate(row: Mapping[str, Any]) -> SpecialRate | None:
    if "date" in row:
        start = end = date.fromisoformat(str(row["date"])[:10])
    elif "start_date" in row and "end_date" in row:
        start = date.fromisoformat(str(row["start_date"])[:10])
        end = date.fromisoformat(str(row["end_date"])[:10])
    else:
        return None
    return SpecialRate(
        start, end, money(row.get("rate", 0)), row.get("description", "Special Rate"),
        int(row.get("min_parcels", 160)),
    )


def _listed(value: Any) -> tuple[str, ...]:
    """One id or several as stripped text; blank ones go."""
    several = value if isinstance(value, (list, tuple)) else [value]
    return tuple(i for i in (str(v).strip() for v in several if v is not None) if i)


#: Settings of a designated driver and how each is read; those not given keep their default.
_DRIVER_SETTINGS = {"basic_amount": money, "basic_parcels": int, "rate_after_basic": money}


def _designated(row: Mapping[str, Any]) -> DesignatedDriver:
    given: dict[str, Any] = {name: read(row[name]) for name, read in _DRIVER_SETTINGS.items() if name in row}
    if "kpi_incentives" in row:
        given["kpi"] = _kpi(row["kpi_incentives"])
    return DesignatedDriver(_listed(row.get("dispatcher_ids") or row.get("dispatcher_id")), **given)
