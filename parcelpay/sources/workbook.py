"""A workbook: canonical sheets by name, with absent sheets as empty ones."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelpay.operators.period import filter_period
from parcelpay.operators.unions import union_all
from parcelpay.sources.guards import looks_like_dispatch, without_dispatch_copy
from parcelpay.sources.sheets import SHEETS, canonicalize, empty_sheet, missing_columns


class Workbook:
    """Canonical sheets of one settlement. Lazy: building and filtering run no job."""

    def __init__(self, spark: SparkSession, sheets: Mapping[str, DataFrame], refused: Mapping[str, str] | None = None):
        self.spark = spark
        self.sheets = dict(sheets)
        self.refused = dict(refused or {})

    @classmethod
    def from_raw(
        cls, spark: SparkSession, raw: Mapping[str, DataFrame | None], guard_copies: bool = True
    ) -> "Workbook":
        """Canonicalize raw sheets.

        Dispatch must have its required columns. An optional sheet without them counts as empty,
        as does a return sheet that is dispatch in disguise; ``missing_report`` tells why.
        ``guard_copies`` also empties optional sheets whose content equals the dispatch sheet;
        only sheets with the same headers cost a comparison.
        """
        dispatch = raw.get("dispatch")
        sheets: dict[str, DataFrame] = {}
        refused: dict[str, str] = {}
        for name, df in raw.items():
            if df is None:
                continue
            if name not in SHEETS:
                raise ValueError(f"unknown sheet {name!r}; known sheets: {', '.join(SHEETS)}")
            if name != "dispatch":
                unknown = missing_columns(name, df.columns)
                if unknown:
                    refused[name] = "header not recognised: " + ", ".join(unknown)
                    continue
                if name == "return" and looks_like_dispatch(df.columns):
                    refused[name] = "dispatch columns"
                    continue
                if guard_copies and dispatch is not None:
                    df = without_dispatch_copy(df, dispatch)
            sheets[name] = canonicalize(name, df)
        return cls(spark, sheets, refused)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.sheets:
            return self.sheets[name]
        return empty_sheet(self.spark, name)

    def between(self, start: date, end: date) -> "Workbook":
        """Every dated sheet cut to the inclusive period; sheets without a date column pass whole."""
        return Workbook(self.spark, {n: filter_period(df, start, end) for n, df in self.sheets.items()}, self.refused)

    def replacing(self, **sheets: DataFrame) -> "Workbook":
        return Workbook(self.spark, {**self.sheets, **{k.rstrip("_"): v for k, v in sheets.items()}}, self.refused)

    def missing_report(self) -> DataFrame:
        """(sheet, rows, is_missing, reason) for every optional sheet, absent or present.

        The reason names the headers that no column could supply, a return sheet with dispatch
        columns, an absent sheet, or a sheet without rows (none left by the guard included).
        """
        parts = []
        for name in SHEETS:
            if name == "dispatch":
                continue
            empty = "no rows" if name in self.sheets else self.refused.get(name, "absent")
            counted = self[name].agg(F.count(F.lit(1)).alias("rows"))
            missing = F.col("rows") == 0
            parts.append(
                counted.select(
                    F.lit(name).alias("sheet"), "rows", missing.alias("is_missing"),
                    F.when(missing, F.lit(empty)).alias("reason"),
                )
            )
        return union_all(parts)
