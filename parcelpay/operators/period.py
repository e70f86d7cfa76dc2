"""Period filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.functions.dates import in_days


def filter_period(df: DataFrame, start: date, end: date, column: str = "event_ts") -> DataFrame:
    """Rows with ``start <= day <= end``; a sheet without the date column passes unfiltered.

    Where the sheet is stored by ``period_month``, the months are filtered as well, which prunes
    partition folders.
    """
    if column not in df.columns:
        return df
    kept = df.where(in_days(column, start, end))
    if "period_month" in df.columns:
        months = F.col("period_month").cast("string").between(f"{start:%Y-%m}", f"{end:%Y-%m}")
        kept = kept.where(months)
    return kept


def default_period(df: DataFrame, column: str = "event_ts") -> DataFrame:
    """One row (period_start, period_end): the month of the last date, cut at the first date."""
    bounds = df.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last"))
    return bounds.select(
        F.greatest("first", F.trunc("last", "month")).alias("period_start"),
        F.col("last").alias("period_end"),
    )


def filter_default_period(df: DataFrame, column: str = "event_ts") -> DataFrame:
    """Rows of the default period; its bounds come from scalar subqueries, not from the driver."""
    period = default_period(df, column)
    start = period.select("period_start").scalar()
    end = period.select("period_end").scalar()
    return df.where((F.col(column) >= start) & (F.col(column) < F.date_add(end, 1)))


def dispatcher_presence(dispatch: DataFrame, start: date, end: date) -> DataFrame:
    """Per dispatcher: rows in the period, rows without a date, all rows. One pass, combined early.

    Grouped by the key as a struct, so that a join with the result shuffles both sides itself and
    may split a dispatcher with very many rows.
    """
    known = F.col("dispatcher_key").isNotNull() & (F.col("dispatcher_key") != "UNKNOWN")
    return (
        dispatch.where(known)
        .groupBy(F.struct("dispatcher_key").alias("key"))
        .agg(
            F.expr(f"count_if({in_days('event_ts', start, end)})").alias("rows_in_period"),
            F.count_if(F.col("event_ts").isNull()).alias("rows_without_date"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select("key.dispatcher_key", "rows_in_period", "rows_without_date", "rows")
    )


def lost_dispatchers(dispatch: DataFrame, start: date, end: date) -> DataFrame:
    """Dispatchers without any row in the period; ``retained`` tells whether undated rows stand in."""
    return (
        dispatcher_presence(dispatch, start, end)
        .where(F.col("rows_in_period") == 0)
        .select("dispatcher_key", "rows", "rows_without_date", (F.col("rows_without_date") > 0).alias("retained"))
    )


def filter_period_retaining_undated(dispatch: DataFrame, start: date, end: date) -> DataFrame:
    """Rows in the period, plus the undated rows of dispatchers that have no row in it."""
    inside = filter_period(dispatch, start, end)
    lost = lost_dispatchers(dispatch, start, end).where("retained").select("dispatcher_key")
    undated = dispatch.where(F.col("event_ts").isNull()).join(lost, "dispatcher_key", "left_semi")
    return inside.unionByName(undated.select(inside.columns))


def presence_counts(dispatch: DataFrame, measured: DataFrame, start: date, end: date) -> DataFrame:
    """Set sizes behind the diagnostics: dispatchers in the period, measured ones, and their overlap.

    ``measured`` is any relation with a ``dispatcher_key``, such as attendance penalties.
    """
    inside = filter_period(dispatch, start, end).select("dispatcher_key").where("dispatcher_key IS NOT NULL")
    other = measured.select("dispatcher_key").where("dispatcher_key IS NOT NULL")
    tagged = inside.select("dispatcher_key", F.lit(1).alias("in_dispatch"), F.lit(0).alias("in_measured")).unionByName(
        other.select("dispatcher_key", F.lit(0).alias("in_dispatch"), F.lit(1).alias("in_measured"))
    )
    flags = tagged.groupBy("dispatcher_key").agg(
        F.max("in_dispatch").alias("in_dispatch"), F.max("in_measured").alias("in_measured")
    )
    return flags.agg(
        F.count_if(F.col("in_dispatch") == 1).alias("dispatch_ids"),
        F.count_if(F.col("in_measured") == 1).alias("measured_ids"),
        F.count_if((F.col("in_dispatch") == 1) & (F.col("in_measured") == 1)).alias("matched_ids"),
        F.count_if((F.col("in_dispatch") == 0) & (F.col("in_measured") == 1)).alias("unmatched_ids"),
    )
