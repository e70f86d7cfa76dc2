"""Spark SQL expressions: clean-up of ids, waybills, names, money, weights and dates."""

from parcelpay.functions import dates, numbers, sql, text

__all__ = ["dates", "numbers", "sql", "text"]
