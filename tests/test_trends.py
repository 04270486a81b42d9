import math

import numpy as np
from pyspark.sql import functions as F

from fieldcounts.operators import trends as TR


def test_t_quantiles_against_printed_table():
    printed = {1: 12.706, 2: 4.303, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}
    for df, v in printed.items():
        assert abs(TR.T975[df - 1] - v) < 5e-4


def test_t_quantiles_do_not_jump_past_the_table(spark):
    want = {200: 1.971896, 201: 1.971837, 400: 1.965912, 1000: 1.962339}
    df = spark.createDataFrame([(k,) for k in want], "n int")
    for r in df.select("n", TR.t975(F.col("n")).alias("t")).collect():
        assert abs(r.t - want[r.n]) < 1e-6
    assert abs(TR.t_quantile(0.975, 200) - sum(c / 200 ** k for k, c in enumerate(TR.T975_SERIES))) < 1e-11


def test_local_trend_with_few_points(spark):
    df = spark.createDataFrame([("one", 1.0, 5.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0), ("tie", 1.0, 2.0),
                                ("tie", 1.0, 4.0), ("gap", 1.0, None)], "g string, x double, y double")
    got = {(r.g, r.x, r.y): r.fitted for r in TR.local_trend(df, ["g"], "x", "y", 1.1).collect()}
    assert got[("one", 1.0, 5.0)] == 5.0 and got[("tie", 1.0, 2.0)] == 3.0
    assert abs(got[("two", 2.0, 4.0)] - 4.0) < 1e-9 and len(got) == 5


def test_linear_trend_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = np.arange(1990, 2010, dtype=float)
    y = 3.0 + 0.5 * (x - 1990) + rng.normal(0, 1, len(x))
    data = [("S", float(a), float(b)) for a, b in zip(x, y)] + [("one", 2000.0, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    out = {r.g: r for r in TR.linear_trend(df, ["g"], "x", "y").collect()}
    b, a = np.polyfit(x, y, 1)
    resid = y - (a + b * x)
    se = math.sqrt((resid @ resid) / (len(x) - 2) / ((x - x.mean()) @ (x - x.mean())))
    t = TR.T975[len(x) - 3]
    assert out["S"].trend == round(b, 2)
    assert abs(out["S"].upper95ci - (b + t * se)) <= 0.005 + 1e-9
    assert abs(out["S"].lower95ci - (b - t * se)) <= 0.005 + 1e-9
    assert out["one"].trend is None and out["one"].upper95ci is None


def test_quadratic_trend_matches_polyfit(spark):
    x = np.array([3, 20, 45, 61, 70, 90, 101, 120], dtype=float)
    y = 500 + 12 * x - 0.08 * x * x + np.array([5, -3, 2, 0, -4, 6, -1, 2], dtype=float)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 1.0, 1.0), (2, 2.0, 3.0)],
                               "g int, x double, y double")
    out = {r.g: r for r in TR.quadratic_trend(df, ["g"], "x", "y").collect()}
    c2, c1, c0 = np.polyfit(x, y, 2)
    assert abs(out[1].quadratic - c2) < 1e-9 and abs(out[1].linear - c1) < 1e-7 and abs(out[1].intercept - c0) < 1e-5
    assert out[2].intercept is None   # two points: no quadratic


def _loess_brute(x, y, span):
    """Weighted quadratic fit at each point, written out with the normal equations."""
    n = len(x)
    q = int(math.floor(n * span + 1e-5))
    fits = []
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1] if span <= 1 else d.max() * span
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        X = np.column_stack([np.ones(n), x - x0, (x - x0) ** 2])
        beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y))
        fits.append(beta[0])
    return np.array(fits)


def test_local_trend_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.arange(1989, 2021, dtype=float)
    y = 1000 + 30 * np.sin((x - 1989) / 5) + rng.normal(0, 5, len(x))
    df = spark.createDataFrame([("all", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    for span in (0.75, 1.1):
        got = {r.x: r.fitted for r in TR.local_trend(df, ["g"], "x", "y", span).collect()}
        ref = _loess_brute(x, y, span)
        assert max(abs(got[a] - b) for a, b in zip(x, ref)) < 1e-6


def test_local_trend_reproduces_a_parabola(spark):
    x = np.arange(0, 12, dtype=float)
    y = 2 + 3 * x - 0.5 * x * x
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    got = TR.local_trend(df, ["g"], "x", "y").select((F.col("fitted") - F.col("y")).alias("e")).collect()
    assert max(abs(r.e) for r in got) < 1e-8


def test_linear_trend_drops_incomplete_pairs(spark):
    data = [("g", 1.0, 1.0), ("g", 2.0, None), ("g", 3.0, 3.0), ("g", 4.0, 5.0),
            ("two", 1.0, 1.0), ("two", 2.0, 2.0)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    out = {r.k: r for r in TR.linear_trend(df, ["k"], "x", "y").collect()}
    b, _ = np.polyfit([1.0, 3.0, 4.0], [1.0, 3.0, 5.0], 1)
    assert out["g"].trend == round(b, 2) and out["g"].upper95ci is not None   # 3 complete pairs: interval
    assert out["two"].trend == 1.0 and out["two"].upper95ci is None          # 2 pairs: no interval
