"""Dispatch rows without returned waybills, and the counters of that export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.functions import text
from parcelpay.functions.sql import name as quoted
from parcelpay.operators.overlap import distinct_keys, exclude_waybills, flag_matches, spread_blanks
from parcelpay.sources import headers as H
from parcelpay.sources.guards import without_dispatch_copy
from parcelpay.sources.sinks import write_report


def _keyed(raw: DataFrame) -> DataFrame | None:
    """The normalized waybill of every row, next to the untouched source columns."""
    column = H.WAYBILL.find(raw.columns)
    if column is None:
        return None
    source = ", ".join(quoted(c) for c in raw.columns)
    return raw.selectExpr(f"{text.waybill(quoted(column))} AS waybill", f"struct({source}) AS source")


def filtered_dispatch(dispatch: DataFrame, returned: DataFrame) -> DataFrame:
    """Raw dispatch rows whose normalized waybill is not on the return sheet, whoever returned it."""
    keyed = _keyed(dispatch)
    if keyed is None:
        raise ValueError(f"no waybill column on the dispatch sheet; columns: {', '.join(dispatch.columns)}")
    other = _keyed(returned)
    if other is None:
        return dispatch
    return exclude_waybills(keyed, other).select("source.*")


def export_counters(dispatch: DataFrame, returned: DataFrame) -> DataFrame:
    """(metric, value): rows in, return rows, return waybill column, distinct waybills, removed, out.

    Dispatch is read once, flagged instead of filtered, and reduced to two counts.
    """
    keyed, other = _keyed(dispatch), _keyed(returned)
    if keyed is None:
        raise ValueError(f"no waybill column on the dispatch sheet; columns: {', '.join(dispatch.columns)}")
    column = H.WAYBILL.find(returned.columns)
    rows = spread_blanks(keyed.selectExpr("waybill", "xxhash64(source) AS source"), "waybill").select("waybill")
    if other is None:
        flagged, unique = rows.withColumn("returned", F.lit(False)), F.lit(0).cast("bigint")
    else:
        flagged = flag_matches(rows, other, ["waybill"], "returned")
        unique = distinct_keys(other, ["waybill"]).agg(F.count(F.lit(1))).scalar()
    row = flagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if("returned").alias("removed"))
    metrics = [
        ("dispatch_rows_in", F.col("rows")),
        ("return_rows", returned.agg(F.count(F.lit(1))).scalar()),
        ("return_waybill_column", F.lit(column or "")),
        ("unique_return_awbs_norm", unique),
        ("dispatch_rows_removed", F.col("removed")),
        ("dispatch_rows_out", F.col("rows") - F.col("removed")),
    ]
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in metrics])
    return row.select(F.explode(lines).alias("m")).select("m.*")


def write_export(dispatch: DataFrame, returned: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write both outputs; a return sheet that copies dispatch counts as empty."""
    returned = without_dispatch_copy(returned, dispatch)
    write_report(filtered_dispatch(dispatch, returned), f"{path}/dispatch_filtered", file_format)
    write_report(export_counters(dispatch, returned), f"{path}/summary", file_format)
