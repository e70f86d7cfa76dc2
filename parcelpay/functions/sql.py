"""Pieces of Spark SQL text: quoted names and literals.

Expressions in this package are SQL text for ``selectExpr`` and ``expr``. One long expression is
then one call into the JVM, where the Column API would need one per operator.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal


def name(column: str) -> str:
    """Quoted column name; source headers may hold dots, blanks and bars."""
    return "`" + column.replace("`", "``") + "`"


def literal(value: str | int | float | bool | Decimal | date | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, date):
        return f"DATE'{value:%Y-%m-%d}'"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, float):
        return f"{value!r}D"
    return f"{value}L"


def literals(values) -> str:
    return ", ".join(literal(v) for v in values)


def case(branches: list[tuple[str, str]], otherwise: str) -> str:
    """First branch whose condition holds."""
    if not branches:
        return otherwise
    body = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {body} ELSE {otherwise} END"
