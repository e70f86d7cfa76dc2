"""The parcel sheets as statements and the fleet summary read them: every sheet is cleaned once.

Returns, pickups and bulky parcels are needed twice, as keys that take dispatch rows out and as rows that are paid for;
they are stored together in the few columns used. Dispatch is read once, flagged and not filtered, so that one aggregation
gives the dispatchers seen as well as the net parcels by day or weight tier. Nothing of dispatch is stored, unless several
reports share it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import MONEY, PARSED
from parcelpay.operators import delivery, extras
from parcelpay.operators.overlap import PAIR, flag_matches, spread_blanks
from parcelpay.operators.penalties import route_shares
from parcelpay.operators.unions import union_all
from parcelpay.session import partitions_of
from parcelpay.sources.stage import Stage
from parcelpay.sources.workbook import Workbook


#: More stored rows than these are not broadcast, however small their compressed files are.
BROADCAST_ROWS = 100_000

#: So many dispatchers of a waybill, besides the lowest and the highest, are looked up in a list.
LISTED = 32

#: Words of 64 bits in the filter that keeps most rows of other waybills out of a shuffle.
WORDS = 1 << 17

#: Shuffled size of the parts in which the keys of the sides are sorted by waybill; in memory they take about 15 times that.
HELD_SIZE = "16m"


@dataclass(frozen=True)
class Spine:
    """``dispatch``: dispatcher_key, dispatcher_name, day, tier, weight, net for every row with a dispatcher.

    ``sides``: stored rows of returns, pickups and bulky parcels with source, dispatcher_key, waybill,
    dispatcher_name, day and amount (what the row pays).
    """

    dispatch: DataFrame
    sides: DataFrame

    def side(self, source: str) -> DataFrame:
        return self.sides.where(F.col("source") == source)


def _optional(df: DataFrame, column: str, kind: str) -> str:
    return column if column in df.columns else f"cast(NULL AS {kind})"


def _side(df: DataFrame, source: str, amount: str = "0") -> DataFrame:
    return df.selectExpr(
        "dispatcher_key",
        "waybill",
        f"{_optional(df, 'dispatcher_name', 'string')} AS dispatcher_name",
        f"to_date({_optional(df, 'event_ts', 'timestamp_ntz')}) AS day",
        f"cast({amount} AS {PARSED}) AS amount",
        f"'{source}' AS source",
    )


def _merged(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def near(keys: DataFrame, waybills: DataFrame) -> DataFrame:
    """All keys of the given waybills, and some others; the more there are of those, the more of the others stay.

    Every waybill sets one bit of a filter that has ``WORDS`` rows at most, so it may be broadcast at any size.
    """
    word, bit = f"pmod(xxhash64(waybill), {WORDS})", "cast(pmod(shiftright(xxhash64(waybill), 32), 64) AS int)"
    bits = waybills.groupBy(F.expr(word).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit})) AS __bits"))
    held = keys.join(F.broadcast(bits), F.expr(word) == F.col("__word"))
    return held.where(f"getbit(__bits, {bit}) = 1").select(*keys.columns)


def flag_taken(rows: DataFrame, sides: DataFrame, stage: Stage) -> DataFrame:
    """The rows without their waybill and with ``taken``: returned or bulky by the same dispatcher, or picked up by anyone.

    Both are looked up by the waybill, so dispatch is shuffled once. The stored table has one row per waybill, of bounded
    size whatever a waybill repeats: the lowest and highest dispatcher of its return and bulky rows, and whether it was
    picked up; the highest is left out where it is the lowest. Where more than two rows may hold dispatchers in between,
    these are found by a join of those rows of the sides that pass a filter of such waybills; up to ``LISTED`` are kept as a list, and only waybills with more of them cost dispatch a join by the pair.
    """
    keys = sides.where("waybill IS NOT NULL AND (source = 'pickup' OR dispatcher_key IS NOT NULL)")
    keys = keys.selectExpr("waybill", "CASE WHEN source <> 'pickup' THEN dispatcher_key END AS owner")
    held = keys.groupBy("waybill").agg(
        F.min("owner").alias("low"),
        F.expr("nullif(max(owner), min(owner)) AS high"),
        F.expr("count(1) > count(owner) AS picked"),
        F.expr("high IS NOT NULL AND count(owner) > 2 AS more"),
    )
    with partitions_of(stage.spark, HELD_SIZE):
        held = stage.put(held, "held", partition_by=("more",))
    found = held.agg(F.expr("count(1) AS waybills"), F.expr("count_if(more) AS more")).first()
    held_by = held.where("NOT more").selectExpr("waybill", "low", "high", "picked", "cast(NULL AS array<string>) AS owners")
    hidden = "false"
    if found["more"]:
        several = held.where("more").drop("more")
        spans = _merged(several.select("waybill", "low", "high"), found["more"])
        known = near(keys, spans) if found["more"] > BROADCAST_ROWS else keys
        between = known.join(spans, "waybill").where("low < owner AND owner < high").select("waybill", "owner").distinct()
        between = stage.put(between, "between")
        nth = between.selectExpr("*", "row_number() OVER (PARTITION BY waybill ORDER BY owner) AS n").where(f"n <= {LISTED + 1}")
        lists = stage.put(nth.groupBy("waybill").agg(F.collect_list("owner").alias("owners")), "lists")
        held_by = held_by.unionByName(several.join(lists, "waybill", "left"))
        long = lists.where(f"size(owners) > {LISTED}").select("waybill")
        if not long.isEmpty():
            pairs = stage.put(between.join(long, "waybill").selectExpr("owner AS dispatcher_key", "waybill"), "pairs")
            rows, hidden = flag_matches(rows, pairs, PAIR, "__hidden", pairs.count() > BROADCAST_ROWS), "__hidden"
    held_by = _merged(held_by.withColumnRenamed("waybill", "__waybill"), found["waybills"])
    listed = "picked OR dispatcher_key = low OR dispatcher_key = high OR array_contains(owners, dispatcher_key)"
    kept = [c for c in rows.columns if c not in ("waybill", "__hidden")]
    joined = rows.join(held_by, F.col("waybill") == F.col("__waybill"), "left")
    return joined.selectExpr(*kept, f"{hidden} OR coalesce({listed}, false) AS taken")


def build(book: Workbook, rules: Rules, stage: Stage, shared: bool = False) -> Spine:
    """The spine of a workbook under the given rules; with ``shared`` its dispatch rows are stored for several reports.

    ``net`` is true for rows that are neither returned nor bulky by the same dispatcher nor picked up by anyone.
    """
    pickup, bulky = book["pickup"], book["bulky"]
    sides = union_all([
        _side(book["return"], "return"),
        _side(pickup, "pickup", extras.pickup_commission(pickup, rules)),
        _side(bulky, "bulky", extras.bulky_rate(bulky, rules.bulky)),
    ])
    sides = stage.put(sides, "sides", partition_by=("source",))
    dispatch = book["dispatch"].where("dispatcher_key IS NOT NULL")
    weight = _optional(dispatch, "weight", "double")
    rows = dispatch.selectExpr(*PAIR, "event_ts", "dispatcher_name", f"{weight} AS weight")
    rows = spread_blanks(rows, "waybill").selectExpr(*PAIR, "to_date(event_ts) AS day", "dispatcher_name", "weight")
    rows = flag_taken(rows, sides, stage)
    flagged = rows.selectExpr(
        "dispatcher_key",
        "dispatcher_name",
        "day",
        f"cast({delivery.weight_tier('weight', rules.weight_tiers)} AS int) AS tier",
        "weight",
        "NOT taken AS net",
    )
    return Spine(stage.put(flagged, "dispatch") if shared else flagged, sides)


def daily_parcels(spine: Spine) -> DataFrame:
    """(dispatcher_key, delivery_date, daily_parcels, dispatch_rows) of dispatch and of bulky rows with a waybill.

    ``daily_parcels`` counts net rows with a date; days without any stay, for their dispatchers were seen.
    """
    own = spine.dispatch.selectExpr("dispatcher_key", "day", "net AND day IS NOT NULL AS counted", "1 AS seen")
    bulky = spine.side("bulky").where("dispatcher_key IS NOT NULL AND waybill IS NOT NULL AND day IS NOT NULL")
    rows = own.unionByName(bulky.selectExpr("dispatcher_key", "day", "true AS counted", "0 AS seen"))
    return rows.groupBy("dispatcher_key", F.col("day").alias("delivery_date")).agg(
        F.count_if("counted").alias("daily_parcels"), F.sum("seen").alias("dispatch_rows")
    )


def with_route_share(totals: DataFrame, who: str, penalty: str, rules: Rules, stage: Stage) -> DataFrame:
    """Totals with the route pool split over the dispatchers that meet a condition.

    The totals have one row per dispatcher. They are stored, because the split has to know them all before any share.
    """
    totals = stage.put(totals, "totals")
    shares = route_shares(totals.where(who).select("dispatcher_key"), rules, stage)
    shares = shares.selectExpr("dispatcher_key AS __key", "amount AS __share", "parcels AS __shares")
    changed = {
        "route_penalty": f"cast(route_penalty + coalesce(__share, 0) AS {MONEY})",
        penalty: f"cast({penalty} + coalesce(__share, 0) AS {MONEY})",
        "penalty_count": "penalty_count + coalesce(__shares, 0L)",
    }
    joined = totals.join(shares, F.col("dispatcher_key") == F.col("__key"), "left")
    return joined.selectExpr(*[f"{changed.get(c, c)} AS {c}" for c in totals.columns])
