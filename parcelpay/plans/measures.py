"""Everything a dispatcher earns or owes as one long relation.

Each source adds rows (dispatcher_key, measure, quantity, amount); one aggregation by dispatcher
and measure serves them all, combined on the map side inside every branch of the union. The set
of dispatchers is whatever has a row, so nobody known to a single sheet gets lost and no outer
joins are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelpay.functions.numbers import MONEY, PARSED
from parcelpay.functions.sql import literals
from parcelpay.operators.unions import union_all

SEEN = "seen"


def entries(
    df: DataFrame, measure: str, quantity: str = "1", amount: str = "0", flagged: str = "0", name: str = "NULL",
    seen: str = "0",
) -> DataFrame:
    """Rows of one source in the long form, from SQL expressions; rows without a dispatcher go.

    ``flagged`` is a condition, or a count where a row stands for several; ``seen`` counts rows of dispatch.
    """
    return df.where("dispatcher_key IS NOT NULL").selectExpr(
        "dispatcher_key",
        f"{measure} AS measure",
        f"cast({quantity} AS bigint) AS quantity",
        f"cast({amount} AS {PARSED}) AS amount",
        f"cast(({flagged}) AS bigint) AS flagged",
        f"cast({seen} AS bigint) AS seen",
        f"cast({name} AS string) AS dispatcher_name",
    )


def constant(df: DataFrame, measure: str, **expressions: str) -> DataFrame:
    """Entries that all belong to one measure."""
    return entries(df, f"'{measure}'", **expressions)


def penalty_entries(totals: DataFrame) -> DataFrame:
    return entries(totals, "concat('penalty:', kind)", quantity="parcels", amount="amount")


def totalled(parts: list[DataFrame]) -> DataFrame:
    """Sums per dispatcher, measure and name. Names are grouping keys here: a text minimum over
    the facts would turn the hash aggregation into a sort."""
    return (
        union_all(parts)
        .groupBy("dispatcher_key", "measure", "dispatcher_name")
        .agg(
            F.expr("count(1) AS rows"),
            F.expr("sum(quantity) AS quantity"),
            F.expr("sum(amount) AS amount"),
            F.expr("sum(flagged) AS flagged"),
            F.expr("sum(seen) AS seen"),
        )
    )


def _pick(measures: tuple[str, ...], value: str) -> str:
    return f"coalesce(sum(CASE WHEN measure IN ({literals(measures)}) THEN {value} END), 0)"


def count_of(value: str, *measures: str, alias: str) -> Column:
    """Sum of ``rows``, ``quantity`` or ``flagged`` over some measures."""
    return F.expr(f"cast({_pick(measures, value)} AS bigint) AS {alias}")


def quantity_of(*measures: str, alias: str) -> Column:
    return count_of("quantity", *measures, alias=alias)


def amount_of(*measures: str, alias: str) -> Column:
    return F.expr(f"{_pick(measures, 'amount')} AS {alias}")


def money_of(*measures: str, alias: str) -> Column:
    return F.expr(f"cast(round({_pick(measures, 'amount')}, 2) AS {MONEY}) AS {alias}")
