"""All known dispatchers with a display name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.operators.unions import union_all
from parcelpay.sources.sheets import PENALTY_SHEETS
from parcelpay.sources.workbook import Workbook

# Whose name and id spelling wins: dispatch, then penalty and deduction sheets, reward, bulky.
_PRIORITY = {"dispatch": 1, "reward": 3, "bulky": 4}
_SOURCES = ("dispatch", *PENALTY_SHEETS, "socso", "overpaid", "reward", "bulky")


def mentions(book: Workbook) -> DataFrame:
    """Distinct (dispatcher_key, dispatcher_id, dispatcher_name, priority) over all sheets.

    Distinct on grouping keys first, so the fact sheet shrinks to its dispatchers on the map side.
    """
    parts = []
    for name in _SOURCES:
        if name not in book.sheets:
            continue
        sheet = book[name]
        known = F.col("dispatcher_name") if "dispatcher_name" in sheet.columns else F.lit(None).cast("string")
        parts.append(
            sheet.where("dispatcher_key IS NOT NULL").select(
                "dispatcher_key",
                "dispatcher_id",
                F.when(known != "Unknown", known).alias("dispatcher_name"),
                F.lit(_PRIORITY.get(name, 2)).alias("priority"),
            )
        )
    return union_all(parts).distinct()


def directory(book: Workbook) -> DataFrame:
    """(dispatcher_key, dispatcher_id, dispatcher_name, display), by name and then id.

    The first non-blank name by sheet priority wins; within a sheet, the smallest in text order.
    """
    named = F.when(F.col("dispatcher_name").isNotNull(), F.struct("priority", "dispatcher_name"))
    found = (
        mentions(book)
        .groupBy("dispatcher_key")
        .agg(
            F.min(F.struct("priority", "dispatcher_id")).alias("i"),
            F.min(named).alias("n"),
        )
        .select(
            "dispatcher_key",
            F.col("i.dispatcher_id").alias("dispatcher_id"),
            F.coalesce(F.col("n.dispatcher_name"), F.lit("")).alias("dispatcher_name"),
        )
    )
    display = F.when(
        F.col("dispatcher_name") != "", F.concat_ws(" - ", "dispatcher_id", "dispatcher_name")
    ).otherwise(F.col("dispatcher_id"))
    return found.withColumn("display", display).orderBy(
        F.lower(F.coalesce(F.nullif("dispatcher_name", F.lit("")), "dispatcher_id")), "dispatcher_key"
    )


def all_dispatchers(book: Workbook) -> DataFrame:
    """Distinct dispatcher keys over all sheets."""
    parts = [
        sheet.select("dispatcher_key").where("dispatcher_key IS NOT NULL") for sheet in book.sheets.values()
    ]
    return union_all(parts).distinct()
