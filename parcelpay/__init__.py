"""Courier settlement on Spark: pay, penalties, statements and fleet reports as lazy DataFrames."""

from parcelpay.config import Rules
from parcelpay.sources.workbook import Workbook

__all__ = ["Rules", "Workbook"]
