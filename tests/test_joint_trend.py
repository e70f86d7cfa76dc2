"""The joint fit against numpy on the same normal equations, and its behaviour on odd series."""

from datetime import date, timedelta

import numpy as np

from parcelpay.operators.joint_trend import JointTrend, fit_joint, joint_components, joint_forecast

START = date(2024, 1, 1)


def series(spark, **values):
    rows = [(name, START + timedelta(days=i), float(v)) for name, ys in values.items() for i, v in enumerate(ys) if v is not None]
    return spark.createDataFrame(rows, "series string, ds date, y double")


def design(days, span, model):
    t = days / span
    bends = [np.maximum(t - s, 0) for s in model.break_times]
    return np.column_stack([np.ones(len(days)), t, *bends, *[(days % 7 == d) * 1.0 for d in range(7)]])


def test_against_numpy(spark):
    noise = np.random.default_rng(3).normal(0, 4, 60)
    y = [50 + 0.5 * i + max(i - 30, 0) * 2 + (10 if i % 7 == 5 else 0) + noise[i] for i in range(60)]
    model, days = JointTrend(), np.arange(60)
    x = design(days, 59, model)
    inverse = np.linalg.inv(x.T @ x + np.diag(model.ridges))
    r = np.array(y) - np.mean(y)
    beta = inverse @ x.T @ r
    spread = np.sqrt(((r - x @ beta) ** 2).sum() / (60 - len(beta) + (np.diag(model.ridges) @ inverse).trace()))
    ahead = design(np.arange(60, 74), 59, model)
    got = joint_forecast(series(spark, a=y), 14).orderBy("ds").collect()
    margin = 1.2815515655446004 * spread * np.sqrt(1 + np.einsum("ij,jk,ik->i", ahead, inverse, ahead))
    assert np.allclose([g.yhat for g in got], np.mean(y) + ahead @ beta, atol=1e-6)
    assert np.allclose([g.yhat_upper - g.yhat for g in got], margin, atol=1e-6)
    assert margin[13] > margin[6] > margin[0]


def test_break_and_weekday_are_found(spark):
    y = [100 + (3 * (i - 120) if i > 120 else 0) + (20 if i % 7 == 6 else 0) for i in range(300)]
    got = joint_components(series(spark, a=y), JointTrend(break_ridge=1e-3)).first()
    assert abs(got.slope_first) < 0.1 and abs(got.slope_last - 3) < 0.1
    assert abs(got.weekday_6 - got.weekday_0 - 20) < 1


def test_odd_series(spark):
    points = series(spark, short=[1] * 6, flat=[5] * 7, gaps=[1, None, None, 4, 5, 6, 7, None, 9, 10, 11])
    repeated = spark.createDataFrame([("one_day", START, float(v)) for v in range(8)], points.schema)
    nulls = spark.createDataFrame([("flat", None, 9.0), ("flat", START, None)], points.schema)
    got = {r.series: r for r in fit_joint(points.unionAll(repeated).unionAll(nulls)).collect()}
    assert set(got) == {"flat", "gaps", "one_day"}
    assert got["flat"].points == 7 and got["flat"].spread == 0 and all(abs(b) < 1e-9 for b in got["flat"].beta)
    assert all(np.isfinite(r.beta).all() for r in got.values())
    assert joint_forecast(points.limit(0), 5).count() == 0
