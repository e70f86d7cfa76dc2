"""Money, weight and number parsing as SQL text. Nothing here fails on bad text, also in ANSI mode."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from parcelpay.functions.text import strip

PARSED = "decimal(28,10)"
MONEY = "decimal(18,2)"
RATE = "decimal(12,4)"

# Currency marks removed from a money cell.
CURRENCY_MARKS = r"r'RM|MYR|S\$|SGD|USD|[$€£,]'"


def is_number(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def _or_zero(x: str) -> str:
    return f"coalesce(try_cast({x} AS {PARSED}), cast(0 AS {PARSED}))"


def money(x: str, kind: T.DataType | None = None) -> str:
    """Money cell as a decimal; blanks, dashes and junk are 0. Not rounded."""
    if is_number(kind):
        return _or_zero(x)
    return _or_zero(strip(f"regexp_replace(cast({x} AS string), {CURRENCY_MARKS}, '')"))


def comma_decimal(x: str, kind: T.DataType | None = None) -> str:
    """Number that may use a decimal comma ("84,3"); junk is 0."""
    return _or_zero(x if is_number(kind) else f"replace({strip(x)}, ',', '.')")


def plain_number(x: str, kind: T.DataType | None = None) -> str:
    """Number without any clean-up; junk is 0."""
    return _or_zero(x if is_number(kind) else strip(x))


def weight(x: str, kind: T.DataType | None = None) -> str:
    """Weight in kg as a double: decimal comma accepted, units dropped, junk is NULL."""
    if is_number(kind):
        return f"nullif(cast({x} AS double), double('NaN'))"
    return f"try_cast(regexp_replace(replace(cast({x} AS string), ',', '.'), '[^0-9.-]', '') AS double)"


def round_money(x: str) -> str:
    """Two decimals, half away from zero."""
    return f"cast(round({x}, 2) AS {MONEY})"


def rate(value: Decimal) -> str:
    return f"cast({value:f}BD AS {RATE})"
