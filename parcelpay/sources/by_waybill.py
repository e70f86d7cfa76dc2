"""Canonical sheets stored by waybill, so that overlaps are found without a shuffle of dispatch.

All sheets of a group are bucketed and sorted by waybill into equal numbers of buckets. Joins on the waybill, alone or
with the dispatcher, then read matching buckets side by side. Rows that would crowd a bucket are stored apart: blank
waybills, and every waybill with more than ``CROWD`` rows on any sheet. They take the shuffled joins, which the adaptive
planner splits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelpay.operators import overlap
from parcelpay.operators.unions import union_all

CROWD = 1000


#: Rows that a bucket is meant to hold at most.
BUCKET_ROWS = 500_000


def buckets_for(sheet: DataFrame, least: int) -> int:
    """Buckets for a sheet of that length: ``least`` for a short one, and as many more as its rows need."""
    return max(least, -(-sheet.count() // BUCKET_ROWS))


@dataclass(frozen=True)
class StoredSheet:
    """``bucketed`` rows by waybill, and ``crowded`` rows without or with a very frequent one."""

    bucketed: DataFrame
    crowded: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.bucketed.unionByName(self.crowded)


def _crowding(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """The waybills with too many rows on any sheet."""
    counts = [df.where("waybill IS NOT NULL").groupBy("waybill").agg(F.count(F.lit(1)).alias("n")) for df in sheets.values()]
    return union_all([c.where(F.col("n") > CROWD).select("waybill") for c in counts]).distinct()


def store(sheets: Mapping[str, DataFrame], folder: str, buckets: int, prefix: str = "stored") -> dict[str, StoredSheet]:
    """Write canonical sheets with a waybill as tables ``<prefix>_<sheet>`` and read them back.

    All rows of a sheet stay, in one of the two parts; the same waybills are stored apart on every sheet. Sheets are
    cleaned once, into files that the counts and both parts are then read from.
    """
    spark = next(iter(sheets.values())).sparkSession
    cleaned = {}
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{prefix}_{name}_cleaned")
        cleaned[name] = spark.read.schema(df.schema).parquet(f"{folder}/{prefix}_{name}_cleaned")
    sheets = cleaned
    _crowding(sheets).write.mode("overwrite").parquet(f"{folder}/{prefix}_crowding")
    crowding = spark.read.schema("waybill string").parquet(f"{folder}/{prefix}_crowding")
    for name, df in sheets.items():
        spread = df.where("waybill IS NOT NULL").join(crowding, "waybill", "left_anti").select(df.columns)
        table = spread.repartition(buckets, "waybill").write.mode("overwrite").bucketBy(buckets, "waybill").sortBy("waybill")
        table.option("path", f"{folder}/{prefix}_{name}").saveAsTable(f"{prefix}_{name}")
        crowded = df.where("waybill IS NULL").unionByName(df.join(crowding, "waybill", "left_semi").select(df.columns))
        crowded.write.mode("overwrite").parquet(f"{folder}/{prefix}_{name}_crowded")
    return {name: attach(spark, name, df.schema.simpleString()[7:-1], folder, buckets, prefix) for name, df in sheets.items()}


def attach(spark: SparkSession, sheet: str, columns: str, folder: str, buckets: int, prefix: str = "stored") -> StoredSheet:
    """A stored sheet; a session that did not write it gets the table anew over the same files.

    ``columns`` is the schema as ``name:type, ...``.
    """
    table = f"{prefix}_{sheet}"
    fields = ", ".join(c.replace(":", " ", 1) for c in columns.split(","))
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY (waybill) SORTED BY (waybill) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{folder}/{table}'"
        )
    return StoredSheet(spark.table(table), spark.read.schema(fields).parquet(f"{folder}/{table}_crowded"))


def exclude_pairs(dispatch: StoredSheet, *sheets: StoredSheet) -> StoredSheet:
    """Dispatch rows whose (dispatcher, waybill) is on none of the sheets; bucket by bucket where they are bucketed.

    The waybill is the only key of the bucketed join. As a second key the dispatcher would ask for a shuffle by both, so
    it is compared by two bounds, among the few rows that a bucketed waybill has.
    """
    kept = dispatch.bucketed
    for sheet in sheets:
        other = sheet.bucketed.select(F.col("waybill").alias("__w"), F.col("dispatcher_key").alias("__k"))
        same = (F.col("dispatcher_key") >= F.col("__k")) & (F.col("dispatcher_key") <= F.col("__k"))
        kept = kept.join(other, (F.col("waybill") == F.col("__w")) & same, "left_anti")
    crowded = overlap.exclude_pairs(dispatch.crowded, *[s.crowded for s in sheets])
    return StoredSheet(kept.select(dispatch.bucketed.columns), crowded)


def exclude_waybills(dispatch: StoredSheet, sheet: StoredSheet) -> StoredSheet:
    """Dispatch rows whose waybill is not on the sheet, whoever the dispatcher is."""
    kept = dispatch.bucketed.join(sheet.bucketed.select("waybill"), "waybill", "left_anti")
    return StoredSheet(kept.select(dispatch.bucketed.columns), overlap.exclude_waybills(dispatch.crowded, sheet.crowded))


def net_dispatch(stored: Mapping[str, StoredSheet]) -> StoredSheet:
    """Delivered parcels that count as deliveries, from stored dispatch, return, bulky and pickup sheets."""
    return exclude_waybills(exclude_pairs(stored["dispatch"], stored["return"], stored["bulky"]), stored["pickup"])


def export_counts(dispatch: StoredSheet, returned: StoredSheet) -> DataFrame:
    """(rows_in, rows_out, returned_waybills): the counters of the filtered export, without a shuffle of dispatch."""
    kept = exclude_waybills(dispatch, returned)
    return dispatch.rows.agg(F.count(F.lit(1)).alias("rows_in")).select(
        "rows_in",
        kept.rows.agg(F.count(F.lit(1))).scalar().alias("rows_out"),
        returned.rows.where("waybill IS NOT NULL").agg(F.count_distinct("waybill")).scalar().alias("returned_waybills"),
    )
