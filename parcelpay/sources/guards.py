"""Checks that a sheet is what its name says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.functions.sql import name as quoted
from parcelpay.functions.text import strip
from parcelpay.sources.headers import Role


def looks_like_dispatch(columns: list[str]) -> bool:
    """True for a "return" sheet that carries the columns of a delivery and none about returns."""
    if any("return" in c.lower() for c in columns):
        return False
    roles = (Role(("Delivery Signature",)), Role(("Waybill Number", "Waybill")), Role(("Dispatcher ID", "dispatcher_id")))
    return all(role.find(columns) is not None for role in roles)


def same_headers(a: DataFrame, b: DataFrame) -> bool:
    return [c.strip().lower() for c in a.columns] == [c.strip().lower() for c in b.columns]


def _comparable(x: str) -> str:
    value = f"coalesce({strip(x)}, '')"
    number = f"try_cast({value} AS double)"
    return (
        f"CASE WHEN {number} = floor({number}) AND abs({number}) < 1e18D "
        f"THEN cast(cast({number} AS decimal(38,0)) AS string) ELSE {value} END"
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the same for two sheets with the same rows in any order.

    Cells compare trimmed, with integer-like floats as integers. Sums of row hashes are
    order-free and combine on the map side.
    """
    cells = ", ".join(_comparable(quoted(c)) for c in df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"coalesce(sum(cast(xxhash64({cells}) AS decimal(20,0))), 0)").alias("digest"),
    )


def without_dispatch_copy(candidate: DataFrame, dispatch: DataFrame) -> DataFrame:
    """The candidate sheet, or no rows when it is a copy of the dispatch sheet.

    Sheets with different headers cannot be copies, so only equal headers cost two aggregates;
    they run as scalar subqueries of the returned plan.
    """
    if not same_headers(candidate, dispatch):
        return candidate
    marks = [
        fingerprint(df).select(F.concat_ws("/", F.col("rows"), F.col("digest")).alias("mark"))
        for df in (candidate, dispatch)
    ]
    return candidate.where(marks[0].scalar() != marks[1].scalar())


#: Distinct rows of a sheet that are looked up; the share found has a standard error of 1.6 % at most.
SKETCH_ROWS = 1000


def copied_share(candidate: DataFrame, dispatch: DataFrame, rows: int = SKETCH_ROWS) -> DataFrame:
    """One row (sampled, copied, share): the part of the candidate's distinct rows that are on the dispatch sheet.

    The rows with the smallest hashes are a uniform sample of the distinct rows, whatever their order and repeats; up to
    ``rows`` distinct rows the share is exact. Cells compare as in ``fingerprint``. Dispatch is read once against the
    sample.
    """
    def hashes(df: DataFrame) -> DataFrame:
        return df.select(F.expr(f"xxhash64({', '.join(_comparable(quoted(c)) for c in df.columns)})").alias("h"))

    sample = hashes(candidate).distinct().orderBy("h").limit(rows)
    found = hashes(dispatch).join(F.broadcast(sample), "h", "left_semi").distinct()  # the sample has ``rows`` rows at most
    both = sample.join(found.withColumn("copied", F.lit(True)), "h", "left")
    counts = both.agg(F.count(F.lit(1)).alias("sampled"), F.count("copied").alias("copied"))
    return counts.selectExpr("sampled", "copied", "CASE WHEN sampled > 0 THEN copied / sampled ELSE 0D END AS share")


def without_most_of_dispatch(candidate: DataFrame, dispatch: DataFrame, least: float = 0.9, rows: int = SKETCH_ROWS) -> DataFrame:
    """The candidate sheet, or no rows when at least that share of its distinct rows is on the dispatch sheet."""
    if not same_headers(candidate, dispatch):
        return candidate
    return candidate.where(copied_share(candidate, dispatch, rows).select("share").scalar() < least)
