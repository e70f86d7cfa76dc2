"""Dates of mixed shapes: the shapes that occur are counted first, and only these are tried.

One aggregation counts, per file and column, the values that each shape parses. A file whose dates fit the day first more
often than the month first is read day first, so that 03/04 means what it means in the rest of its file. Values that no
shape parses are counted and reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parcelpay.functions.dates import DATE_FORMATS
from parcelpay.functions.dates import timestamp as parsed
from parcelpay.functions.sql import literal, name as quoted
from parcelpay.functions.text import strip
from parcelpay.sources.stage import Stage

# Shapes that differ only in which of the first two numbers is the month.
_SWAPPED = {f: f.replace("M/d", "d/M").replace("M-d-", "d-M-") for f in DATE_FORMATS if f.startswith(("M/d", "M-d-"))}
_DAY_FIRST = {day: month for month, day in _SWAPPED.items()}


def _is(text: str, shape: str) -> str:
    return f"try_to_timestamp({text}, {literal(shape)}) IS NOT NULL"


def shape_counts(df: DataFrame, columns: Sequence[str], file: Column | str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """(file, column, shape, values): how many values of a text column each shape parses, in one pass over the rows.

    The shape "iso" stands for year-month-day text, with or without a time or zone; "blank" and "unparsed" count the
    rest. A value that several shapes parse counts for each of them.
    """
    counts = []
    for c in columns:
        text = strip(quoted(c))
        shapes = {
            "blank": f"{text} IS NULL OR {text} = ''",
            "iso": f"{parsed(quoted(c), formats=())} IS NOT NULL",
            **{f: _is(text, f) for f in formats},
            "unparsed": f"{text} <> '' AND {parsed(quoted(c), formats=tuple(formats))} IS NULL",
        }
        for shape, condition in shapes.items():
            counts.append((c, shape, F.expr(f"count_if({condition})")))
    which = file if isinstance(file, Column) else F.col(file)
    rows = df.groupBy(which.alias("file")).agg(*[value.alias(f"n{i}") for i, (_, _, value) in enumerate(counts)])
    lines = [
        F.struct(F.lit(c).alias("column"), F.lit(shape).alias("shape"), F.col(f"n{i}").alias("values"))
        for i, (c, shape, _) in enumerate(counts)
    ]
    return rows.select("file", F.explode(F.array(*lines)).alias("line")).select("file", "line.*").where("values > 0")


def day_first_files(counts: DataFrame) -> DataFrame:
    """(file, column, day_first): does the day come first? A tie is read month first, as single values are."""
    months, days = list(_SWAPPED), list(_DAY_FIRST)
    return counts.groupBy("file", "column").agg(
        F.expr(
            f"coalesce(sum(CASE WHEN shape IN ({', '.join(map(literal, days))}) THEN values END), 0) > "
            f"coalesce(sum(CASE WHEN shape IN ({', '.join(map(literal, months))}) THEN values END), 0) AS day_first"
        )
    )


def parse_dates(
    df: DataFrame, columns: Sequence[str], file: str, stage: Stage | None = None, observation: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows with the text columns as timestamps, and their stored shape counts.

    The counts (a row per file, column and shape that occurs) are stored first; then only occurring shapes are tried,
    each file's in its own order. ``observation`` receives ``unparsed_<column>`` when the rows are next written or
    collected: the values that are not blank and have no date.
    """
    stage = stage or Stage(df.sparkSession)
    counts = stage.put(shape_counts(df, columns, file), "shapes")
    # At most the number of shapes.
    present = {r.shape for r in counts.select("shape").distinct().collect()}
    shapes = [f for f in DATE_FORMATS if f in present]
    swapped = [_SWAPPED.get(f, f) for f in shapes]
    swapped += [f for f in shapes if f in _DAY_FIRST and f not in swapped]
    first = [_DAY_FIRST[f] for f in swapped if f in _DAY_FIRST]
    late = swapped + [f for f in first if f not in swapped]
    order = day_first_files(counts).where("day_first").groupBy("file").agg(F.collect_set("column").alias("__day_first"))
    # The same row of the small side for every row of a file; the planner broadcasts it by its size.
    rows = df.join(order.withColumnRenamed("file", "__file"), F.col(file) == F.col("__file"), "left")
    out, missed = [], []
    for c in df.columns:
        if c not in columns:
            out.append(quoted(c))
            continue
        value = (
            f"CASE WHEN array_contains(__day_first, {literal(c)}) THEN {parsed(quoted(c), formats=tuple(late))} "
            f"ELSE {parsed(quoted(c), formats=tuple(shapes))} END"
        )
        blank = f"coalesce({strip(quoted(c))}, '') = ''"
        out += [f"{value} AS {quoted(c)}", f"{blank} AS __blank{len(missed)}"]
        missed.append(F.count_if(F.expr(f"NOT __blank{len(missed)} AND {quoted(c)} IS NULL")).alias(f"unparsed_{c}"))
    dated = rows.selectExpr(*out)
    if observation is not None:
        dated = dated.observe(observation, *missed)
    return dated.select(*[quoted(c) for c in df.columns]), counts
