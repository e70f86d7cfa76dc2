"""Daily series, daily statistics, and the weekly-seasonal forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelpay.config import Rules
from parcelpay.functions.numbers import round_money
from parcelpay.operators.delivery import weight_tier_counts, weight_tier_value

# Two-sided 80 % band of a normal distribution.
BAND_Z = 1.2815515655446004
MIN_POINTS = 7


def daily_trend(dispatch: DataFrame) -> DataFrame:
    """(signature_date, total_parcels); undated rows are left out."""
    return (
        dispatch.where("event_ts IS NOT NULL")
        .groupBy(F.to_date("event_ts").alias("signature_date"))
        .agg(F.count(F.lit(1)).alias("total_parcels"))
    )


def daily_payout_trend(dispatch: DataFrame, rules: Rules) -> DataFrame:
    """(signature_date, total_payout, parcel_count) at weight-tier rates.

    Counted by tier and priced once per day instead of adding a rate per parcel.
    """
    counted = (
        dispatch.where("event_ts IS NOT NULL")
        .groupBy(F.to_date("event_ts").alias("signature_date"))
        .agg(F.count(F.lit(1)).alias("parcel_count"), *weight_tier_counts(rules.weight_tiers))
    )
    pay = weight_tier_value(rules.weight_tiers)
    return counted.selectExpr("signature_date", f"{pay} AS total_payout", "parcel_count")


def daily_stats(paid_days: DataFrame) -> DataFrame:
    """Per dispatcher: mean and highest daily parcels, mean daily pay, best day and its pay."""
    return (
        paid_days.groupBy("dispatcher_key")
        .agg(
            F.expr("count(1) AS days"),
            F.expr("sum(daily_parcels) AS parcels"),
            F.expr("max(daily_parcels) AS max_daily_parcels"),
            F.expr("sum(payout_per_day) AS pay"),
            F.expr("max(struct(payout_per_day AS pay, -unix_date(delivery_date) AS before)) AS best"),
        )
        .selectExpr(
            "dispatcher_key",
            "parcels / days AS avg_daily_parcels",
            "max_daily_parcels",
            "cast(pay AS double) / days AS avg_daily_payout",
            f"{round_money('best.pay')} AS best_day_payout",
            "date_from_unix_date(-best.before) AS best_day",
        )
    )


def series(daily: DataFrame, date_column: str, value: str, key: Column | None = None) -> DataFrame:
    """(series, ds, y): one point per day and series; without a key all points form one series."""
    return daily.select(
        (key if key is not None else F.lit("all")).cast("string").alias("series"),
        F.col(date_column).alias("ds"),
        F.col(value).cast("double").alias("y"),
    )


def _weekday(day: Column) -> Column:
    """0 is Monday."""
    return F.weekday(day)


def fit(points: DataFrame) -> DataFrame:
    """Per series: linear trend, mean residual per weekday, and residual spread.

    A day is an offset from the first day of its series. All windows are keyed by the series, so
    one shuffle serves them; a series holds one row per day.
    """
    whole = Window.partitionBy("series")
    same_weekday = Window.partitionBy("series", "weekday")
    residual = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t"))
    fitted = (
        points.where("ds IS NOT NULL AND y IS NOT NULL")
        .withColumn("first", F.min("ds").over(whole))
        .withColumn("t", F.datediff("ds", "first").cast("double"))
        .withColumn("weekday", _weekday(F.col("ds")))
        .withColumn("slope", F.coalesce(F.regr_slope("y", "t").over(whole), F.lit(0.0)))
        .withColumn("mean_y", F.avg("y").over(whole))
        .withColumn("mean_t", F.avg("t").over(whole))
        .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_t"))
        .withColumn("r", residual)
        .withColumn("seasonal", F.avg("r").over(same_weekday))
    )
    return (
        fitted.groupBy("series")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("ds").alias("first"),
            F.max("ds").alias("last"),
            F.max("slope").alias("slope"),
            F.max("intercept").alias("intercept"),
            *[F.coalesce(F.max(F.when(F.col("weekday") == d, F.col("seasonal"))), F.lit(0.0)).alias(f"w{d}") for d in range(7)],
            F.coalesce(F.stddev_samp(F.col("r") - F.col("seasonal")), F.lit(0.0)).alias("spread"),
        )
        .where(F.col("points") >= MIN_POINTS)
    )


def forecast(points: DataFrame, days: int) -> DataFrame:
    """(series, ds, yhat, yhat_lower, yhat_upper) for the next days of every series with enough points."""
    fitted = fit(points).withColumn(
        "ds", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days)))
    )
    seasonal = F.element_at(F.array(*[f"w{d}" for d in range(7)]), _weekday(F.col("ds")) + 1)
    yhat = F.col("intercept") + F.col("slope") * F.datediff("ds", "first") + seasonal
    margin = F.col("spread") * BAND_Z
    return fitted.select(
        "series",
        "ds",
        yhat.alias("yhat"),
        (yhat - margin).alias("yhat_lower"),
        (yhat + margin).alias("yhat_upper"),
    )


def last_days(points: DataFrame, n: int = 7) -> DataFrame:
    """The last days of every series."""
    newest = Window.partitionBy("series").orderBy(F.col("ds").desc())
    return points.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n).drop("n")


def forecast_metrics(points: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per series: recent mean, forecast mean, spread, extremes, sum, change in % and its label."""
    recent = last_days(points).groupBy("series").agg(F.avg("y").alias("avg_historical"))
    ahead = predicted.groupBy("series").agg(
        F.avg("yhat").alias("avg_forecast"),
        F.stddev_samp("yhat").alias("forecast_std"),
        F.max("yhat").alias("max_forecast"),
        F.min("yhat").alias("min_forecast"),
        F.sum("yhat").alias("total_forecast"),
    )
    change = F.when(
        F.col("avg_historical") > 0, (F.col("avg_forecast") - F.col("avg_historical")) / F.col("avg_historical") * 100
    ).otherwise(0.0)
    label = F.when(F.col("change_pct") > 10, "growing").when(F.col("change_pct") < -10, "declining").otherwise("stable")
    return (
        recent.join(ahead, "series")
        .withColumn("change_pct", change)
        .withColumn("trend", label)
    )


def combined_forecast(parcels: DataFrame, payout: DataFrame) -> DataFrame:
    """Parcel and payout forecasts side by side, rounded to whole parcels and cents."""
    p = parcels.select(
        "series",
        "ds",
        *[F.bround(c, 0).cast("bigint").alias(f"parcels_{n}") for c, n in _BAND],
    )
    m = payout.select("series", "ds", *[F.round(c, 2).alias(f"payout_{n}") for c, n in _BAND])
    return p.join(m, ["series", "ds"])


_BAND = (("yhat", "forecast"), ("yhat_lower", "lower"), ("yhat_upper", "upper"))


def history_and_forecast(points: DataFrame, predicted: DataFrame) -> DataFrame:
    """(series, ds, type, y): actual and predicted points under one another."""
    actual = points.select("series", "ds", F.lit("Historical").alias("type"), "y")
    ahead = predicted.select("series", "ds", F.lit("Forecast").alias("type"), F.col("yhat").alias("y"))
    return actual.unionByName(ahead)
