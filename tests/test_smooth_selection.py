"""A8 by selection, M2 by mergeable moments, M3 as drawn."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldcounts.operators import selection, smooth, summaries, trends


# ---------------------------------------------------------------- A8
def test_medians_of_groups_of_any_shape(spark):
    rng = np.random.default_rng(3)
    data = [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, -3.5), (None, 7.0), (None, 100.0), ("none", None)]
    data += [("ties", float(v)) for v in [4] * 500 + [9] * 500]
    data += [("many", float(v)) for v in rng.normal(size=3001)] + [("many", None)]
    data += [("skew", float(v)) for v in np.exp(rng.normal(size=2000) * 20)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = dict(rows(selection.medians(df, ["g"], "v")))
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    few = dict(rows(selection.medians(df, ["g"], "v", buckets=3)))
    assert few == got
    assert selection.medians(df.limit(0), ["g"], "v").count() == 0
    whole = df.filter("g != 'skew'").select("g", F.round(F.col("v") * 8).cast("long").alias("v"))
    assert dict(rows(selection.medians(whole, ["g"], "v"))) == dict(rows(
        whole.filter("v IS NOT NULL").groupBy("g").agg(F.median("v"))))


def test_no_task_holds_a_groups_values(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("all").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    result = selection.medians(df, ["g"], "v")
    assert rows(result) == rows(df.groupBy("g").agg(F.median("v")))
    # the values of the bucket that holds the middle are few
    counts = df.groupBy("g", F.col("v").alias("v")).count()
    bounds = counts.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 1280)).first()[0]
    middle = rows(result)[0][1]
    k = sum(b < middle for b in bounds)
    low, high = bounds[k - 1], bounds[k]
    assert df.filter(F.col("v").between(low, high)).count() < n / 20


def test_season_median_is_strict(spark):
    df = spark.createDataFrame([(2000, "A", 3), (2000, "A", 8), (2000, "B", None), (2000, "B", 2), (None, "A", 5)],
                               "study_year int, alpha_code string, baywide_count int")
    got = {(r.study_year, r.alpha_code): (r.mean_abund, r.med_abund) for r in summaries.season_mean_median(df).collect()}
    assert got == {(2000, "A"): (5.5, 5.5), (2000, "B"): (None, None), (None, "A"): (5.0, 5.0)}


# ---------------------------------------------------------------- M2
def test_quadratic_far_from_zero_and_without_a_window(spark):
    rng = np.random.default_rng(5)
    data = []
    for name, x in {"far": 1e6 + rng.uniform(-50, 50, 400), "wide": rng.uniform(-1e4, 1e4, 300),
                    "days": rng.integers(1, 366, 300).astype(float), "zero": np.arange(-3.0, 4.0)}.items():
        centre = x.mean()
        y = 3 + 0.5 * (x - centre) - 0.02 * (x - centre) ** 2 + rng.normal(size=len(x)) * 0.1
        data += [(name, float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(data + [("far", None, 1.0), ("far", 2.0, None), ("two", 1.0, 1.0), ("two", 2.0, 1.0),
                                       ("line", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 1.0)], "g string, x double, y double")
    r = trends.quadratic_trend(df, ["g"], "x", "y")
    assert "Window" not in r._jdf.queryExecution().executedPlan().toString()
    got = {t.g: t for t in r.collect()}
    assert got["two"].quadratic is None and got["line"].quadratic is None and got["far"].n == 400
    for name in ("far", "wide", "days", "zero"):
        x, y = (np.array([t[k] for t in data if t[0] == name]) for k in (1, 2))
        centre, spread = x.mean(), x.std()
        c2, c1, _ = np.polyfit((x - centre) / spread, y, 2)
        assert got[name].quadratic == pytest.approx(c2 / spread ** 2, rel=1e-7)
        slope = got[name].linear + 2 * got[name].quadratic * centre
        assert slope == pytest.approx(c1 / spread, rel=1e-5)


# ---------------------------------------------------------------- M3
def test_curve_meets_a_parabola_and_its_vertices():
    x = np.arange(1990.0, 2020.0)
    at, fitted = smooth.curve(x, 2 + 0.1 * (x - 2000) ** 2, 0.75)
    assert len(at) == 80 and at[0] == 1990 and at[-1] == 2019
    ends = smooth.vertices(x, 0.75)
    # cubic pieces through a parabola's values and slopes are the parabola
    assert np.allclose(fitted, 2 + 0.1 * (at - 2000) ** 2, atol=1e-8)
    assert ends[0] < 1990 and ends[-1] > 2019 and all(((x > a) & (x < b)).sum() <= 4 for a, b in zip(ends, ends[1:]))


def test_curve_against_a_direct_fit():
    rng = np.random.default_rng(8)
    x = np.sort(rng.uniform(0, 30, 60))
    y = np.sin(x / 4) + rng.normal(size=60) * 0.1
    at, fitted = smooth.curve(x, y, 0.5)
    direct = np.array([smooth.fit_at(v, x, y, 0.5)[0] for v in at])
    assert np.abs(fitted - direct).max() < 0.03
    for v in smooth.vertices(x, 0.5):        # value and slope against least squares by numpy
        gap = np.abs(x - v)
        h = np.sort(gap)[29]
        w = np.where(gap < h, (1 - (gap / h) ** 3) ** 3, 0)
        c = np.linalg.lstsq(np.sqrt(w)[:, None] * np.vander(x - v, 3), np.sqrt(w) * y, rcond=None)[0]
        assert smooth.fit_at(v, x, y, 0.5) == pytest.approx((c[2], c[1]), rel=1e-6, abs=1e-9)


def test_long_and_short_series(spark):
    n = 10_000
    assert len(smooth.vertices(np.arange(float(n)), 0.75)) < 40           # fits grow with n, not with n squared
    data = [("long", float(k), float(k % 7)) for k in range(n)] + [("one", 5.0, 2.0), (None, 1.0, 1.0), (None, 2.0, 3.0),
                                                                 ("ties", 1.0, 1.0), ("ties", 1.0, 3.0), ("gone", None, 1.0)]
    got = smooth.smooth_curve(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.fitted)
    assert {g: len(v) for g, v in by.items()} == {"long": 80, "one": 80, None: 80, "ties": 80}
    assert by["one"] == pytest.approx([2.0] * 80) and by["ties"] == pytest.approx([2.0] * 80)
    assert all(2.5 < v < 3.5 for v in by["long"])
