"""Date parsing and day ranges as SQL text."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import types as T

from parcelpay.functions.sql import literal
from parcelpay.functions.text import strip

# Tried in this order after ISO text: month first, then day first where the month would be > 12.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "MMM d, yyyy[ H:mm[:ss]]",
    "yyyyMMdd",
    "d-MMM-yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "MMM d yyyy[ H:mm[:ss]]",
    "MMMM d, yyyy[ H:mm[:ss]]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy h:mm[:ss] a",
    "yyyy-M-d h:mm[:ss] a",
    "M/d/yyyy H:mm:ss[.SSSSSS][.SSS][.S]",
)


def timestamp(x: str, kind: T.DataType | None = None, formats: tuple[str, ...] = DATE_FORMATS) -> str:
    """Date or timestamp column as it is; text parsed over mixed formats, bad text NULL.

    Typed columns stay untouched so that range filters on them reach the file scan.
    """
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return x
    if isinstance(kind, T.TimestampType):
        return f"cast({x} AS timestamp_ntz)"
    text = strip(x)
    # A time with an offset is an instant; it counts on the day it has in the session's zone (UTC).
    zoned = rf"WHEN {text} RLIKE r'^\d{{4}}-\d.*:.*(Z|[+-]\d\d:?\d\d)$' THEN cast(try_cast({text} AS timestamp) AS timestamp_ntz)"
    iso = rf"CASE {zoned} WHEN {text} RLIKE r'^\d{{4}}-\d' THEN try_cast({text} AS timestamp_ntz) END"
    tries = [f"cast(try_to_timestamp({text}, {literal(f)}) AS timestamp_ntz)" for f in formats]
    return f"coalesce({', '.join([iso, *tries])})"


def in_days(x: str, start: date, end: date) -> str:
    """``start <= day(x) <= end``, written as a range on the bare column for scan pushdown."""
    return f"({x} >= {literal(start)} AND {x} < {literal(end + timedelta(days=1))})"
