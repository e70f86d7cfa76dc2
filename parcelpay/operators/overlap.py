"""Parcels that another sheet already counts: anti joins on waybills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.operators.unions import union_all

PAIR = ["dispatcher_key", "waybill"]

# Rows without a key never match. They still have to land somewhere in the shuffle, so each gets a
# stand-in by the rest of the row instead of all meeting in the one partition of NULL.
# No canonical key or waybill starts with a blank, so a stand-in matches nothing.
def _spread_nulls(df: DataFrame, column: str) -> str:
    others = [c for c in ("dispatcher_key", "waybill", "event_ts", "source") if c in df.columns]
    return f"coalesce({column}, concat(' ', pmod(xxhash64({', '.join(others)}), 65536)))"


def spread_blanks(rows: DataFrame, column: str) -> DataFrame:
    """The rows with stand-ins for blank keys, for joins whose result shows neither the key nor what stand-ins are made of."""
    return rows.withColumn(column, F.expr(_spread_nulls(rows, column)))


def distinct_keys(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-blank keys. Copies of a hot key collapse before the shuffle."""
    return sheet.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).select(*columns).distinct()


def _join(rows: DataFrame, sheet: DataFrame, columns: list[str], how: str, merge: bool = False) -> DataFrame:
    """Join with the distinct keys of a sheet; rows with a blank key match nothing.

    No hint: a key set that is small at run time is broadcast by the adaptive planner after its
    size is known. A large one is sorted and merged, and then the fact is the left side, the one
    that may be split where a partition is skewed. Spark splits only between plain shuffles, so
    the keys are made distinct as structs: their aggregation cannot double as the shuffle of the
    join, and the join gets its own on both sides. Stand-ins are computed in the join condition:
    as columns they would be shuffled beside the keys they repeat.
    """
    names = [f"__match_{c}" for c in columns]
    present = sheet.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    keys = present.selectExpr(f"struct({', '.join(columns)}) AS key").distinct()
    matched = ["true AS __matched"] if how == "left" else []
    right = keys.selectExpr(*[f"key.{c} AS {n}" for c, n in zip(columns, names)], *matched)
    if merge:
        right = right.hint("merge")
    same = [F.expr(_spread_nulls(rows, c)) == F.col(n) for c, n in zip(columns, names)]
    return rows.join(right, reduce(lambda a, b: a & b, same), how)


def _anti_join(rows: DataFrame, sheet: DataFrame, columns: list[str]) -> DataFrame:
    return _join(rows, sheet, columns, "left_anti").select(*rows.columns)


def flag_matches(rows: DataFrame, sheet: DataFrame, columns: list[str], flag: str, merge: bool = False) -> DataFrame:
    """All rows with a boolean: is the row's key on the sheet?

    ``merge`` is for a sheet known to be long: the planner takes compressed files for their rows and
    would broadcast many times what its threshold means.
    """
    joined = _join(rows, sheet, columns, "left", merge)
    return joined.select(*rows.columns, F.coalesce("__matched", F.lit(False)).alias(flag))


def exclude_pairs(dispatch: DataFrame, *sheets: DataFrame, preserve: DataFrame | None = None) -> DataFrame:
    """Dispatch rows whose (dispatcher, waybill) is on none of the sheets.

    ``preserve`` holds waybills that stay even when a sheet lists them. Several sheets cost one
    join, because their pairs are united first.
    """
    pairs = union_all([s.select(*PAIR) for s in sheets])
    if preserve is not None:
        pairs = _anti_join(pairs, preserve, ["waybill"])
    return _anti_join(dispatch, pairs, PAIR)


def exclude_waybills(dispatch: DataFrame, sheet: DataFrame) -> DataFrame:
    """Dispatch rows whose waybill is not on the sheet, whoever the dispatcher is."""
    return _anti_join(dispatch, sheet, ["waybill"])


def net_dispatch(dispatch: DataFrame, returned: DataFrame, pickup: DataFrame, bulky: DataFrame) -> DataFrame:
    """Delivered parcels that count as deliveries: not returned or bulky by the same dispatcher,
    not picked up by anyone."""
    return exclude_waybills(exclude_pairs(dispatch, returned, bulky), pickup)


def waybill_pairs(sheet: DataFrame) -> DataFrame:
    """Dispatcher to waybill as a relation, one row per distinct pair."""
    return distinct_keys(sheet, PAIR)
