"""Forecast from one joint least-squares fit per series: trend, trend breaks and weekdays together.

The sums of the normal equations (X'X and X'y) are one aggregation with map-side combination, so a series leaves its
points behind after one pass. The small system of every series is solved where its row is, by elimination over
array expressions. Breaks and weekdays are drawn towards zero by a ridge, which keeps the system solvable for short
series and for weekdays that never occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelpay.operators.trends import BAND_Z, MIN_POINTS


@dataclass(frozen=True)
class JointTrend:
    """``breaks`` changes of slope spread over the first ``break_range`` of the history, and the ridge of each part.

    Time runs from 0 at the first to 1 at the last day of a series, so the ridges do not depend on its length.
    """

    breaks: int = 3
    break_range: float = 0.8
    break_ridge: float = 1.0
    weekday_ridge: float = 0.01
    slope_ridge: float = 1e-6

    @property
    def break_times(self) -> list[float]:
        return [self.break_range * k / (self.breaks + 1) for k in range(1, self.breaks + 1)]

    @property
    def ridges(self) -> list[float]:
        return [0.0, self.slope_ridge, *[self.break_ridge] * self.breaks, *[self.weekday_ridge] * 7]

    def terms(self, t: str, day: str) -> list[str]:
        """Expressions of level, slope, breaks and weekdays (0 is Monday)."""
        bends = [f"greatest({t} - {s!r}D, 0D)" for s in self.break_times]
        return ["1D", t, *bends, *[f"CASE WHEN weekday({day}) = {d} THEN 1D ELSE 0D END" for d in range(7)]]


def fit_joint(points: DataFrame, model: JointTrend = JointTrend()) -> DataFrame:
    """(series, points, first, last, mean_y, solved, beta, spread) of every series with enough points.

    ``points`` has series, ds and y; null days and values are left out. ``solved`` holds per term its weight and its row
    of the inverse, ``spread`` the residual deviation with the degrees of freedom that the ridges leave, one at least.
    """
    ridges = model.ridges
    p = len(ridges)
    whole = Window.partitionBy("series")
    centred = (
        points.where("ds IS NOT NULL AND y IS NOT NULL")
        .withColumn("first", F.min("ds").over(whole))
        .withColumn("last", F.max("ds").over(whole))
        .withColumn("mean_y", F.avg("y").over(whole))
        .selectExpr(
            "series", "ds", "first", "last", "mean_y", "y - mean_y AS r",
            "datediff(ds, first) / cast(greatest(datediff(last, first), 1) AS double) AS t",
        )
    )
    terms = [f"x{i}" for i in range(p)]
    rows = centred.selectExpr("*", *[f"{e} AS {x}" for e, x in zip(model.terms("t", "ds"), terms, strict=True)])
    weekdays = range(p - 7, p)

    def product(i: int, j: int) -> str | None:
        """Sum of the product of two terms; two weekdays never meet."""
        return None if i != j and i in weekdays and j in weekdays else f"g_{min(i, j)}_{max(i, j)}"

    pairs = [(i, j) for i in range(p) for j in range(i, p) if product(i, j)]
    sums = rows.groupBy("series").agg(
        F.expr("count(1) AS points"),
        *[F.expr(f"max({c}) AS {c}") for c in ("first", "last", "mean_y")],
        F.expr("sum(r * r) AS rr"),
        *[F.expr(f"sum(x{i} * r) AS b_{i}") for i in range(p)],
        *[F.expr(f"sum(x{i} * x{j}) AS {product(i, j)}") for i, j in pairs],
    ).where(F.col("points") >= MIN_POINTS)

    def row(i: int) -> str:
        own = [f"{product(i, j) or '0D'} + {ridges[i] if i == j else 0.0!r}D" for j in range(p)]
        unit = [f"{float(i == j)!r}D" for j in range(p)]
        return f"array({', '.join([*own, f'b_{i}', *unit])})"

    # Each step clears one column from all rows but its own; the matrix is positive definite, so no rows are exchanged.
    cleared = (
        "transform(m, (row, i) -> CASE WHEN i = k THEN transform(row, x -> x / m[k][k]) "
        "ELSE zip_with(row, m[k], (x, z) -> x - z * row[k] / m[k][k]) END)"
    )
    solved = (
        sums.withColumn("m", F.expr(f"array({', '.join(row(i) for i in range(p))})"))
        .withColumn("m", F.expr(f"aggregate(sequence(0, {p - 1}), m, (m, k) -> {cleared})"))
        .withColumn("solved", F.expr(f"transform(m, row -> slice(row, {p + 1}, {p + 1}))"))
        .withColumn("beta", F.expr("transform(solved, row -> row[0])"))
    )
    explained = " + ".join(f"beta[{i}] * b_{i} + {ridges[i]!r}D * beta[{i}] * beta[{i}]" for i in range(p))
    bound = " + ".join(f"{ridges[i]!r}D * solved[{i}][{i + 1}]" for i in range(p))
    spread = f"sqrt(greatest(rr - ({explained}), 0D) / greatest(points - {p} + {bound}, 1D)) AS spread"
    return solved.selectExpr("series", "points", "first", "last", "mean_y", "solved", "beta", spread)


def joint_forecast(points: DataFrame, days: int, model: JointTrend = JointTrend()) -> DataFrame:
    """(series, ds, yhat, yhat_lower, yhat_upper) for the next days; the 80 % band widens with the distance from the history."""
    ahead = fit_joint(points, model).selectExpr("*", f"explode(sequence(date_add(last, 1), date_add(last, {days}))) AS ds")
    timed = ahead.selectExpr("*", "datediff(ds, first) / cast(greatest(datediff(last, first), 1) AS double) AS t")
    total = "0D, (s, v) -> s + v)"
    x = timed.selectExpr("*", f"array({', '.join(model.terms('t', 'ds'))}) AS x")
    inner = f"aggregate(zip_with(x, slice(row, 2, {len(model.ridges)}), (a, b) -> a * b), {total}"
    level = x.selectExpr(
        "series", "ds",
        f"mean_y + aggregate(zip_with(x, beta, (a, b) -> a * b), {total} AS yhat",
        f"{BAND_Z!r}D * spread * sqrt(1 + aggregate(zip_with(x, solved, (a, row) -> a * {inner}), {total}) AS margin",
    )
    return level.selectExpr("series", "ds", "yhat", "yhat - margin AS yhat_lower", "yhat + margin AS yhat_upper")


def joint_components(points: DataFrame, model: JointTrend = JointTrend()) -> DataFrame:
    """Per series: slope per day before the first and after the last break, residual deviation, and the weekday effects."""
    fitted = fit_joint(points, model)
    span = "cast(greatest(datediff(last, first), 1) AS double)"
    bends = " + ".join(f"beta[{i}]" for i in range(1, 2 + model.breaks))
    return fitted.selectExpr(
        "series", "points", f"beta[1] / {span} AS slope_first", f"({bends}) / {span} AS slope_last", "spread",
        *[f"beta[{2 + model.breaks + d}] AS weekday_{d}" for d in range(7)],
    )
