"""Fitted trends behind the reference's drawn lines.

M1 (straight line with a 95 % interval) and M2 (quadratic) are closed-form
from grouped sums, so they are ordinary aggregations.  M3 (local quadratic
regression at each x) works on a series already aggregated to one row per
(group, x), gathered into one short array per group; the line as it is drawn,
on a grid and for long series, is in ``smooth``.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add as add_
from operator import mul
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ------------------------------------------------------------ t quantiles
def t_within(t: float, df: int) -> float:
    """P(|T| < t) of Student's t for whole degrees of freedom: a finite sum of cosine powers."""
    angle = math.atan(t / math.sqrt(df))
    square = math.cos(angle) ** 2
    first = 1 if df % 2 else 0                  # odd: cos, cos^3, ...; even: 1, cos^2, ...
    term, total = (math.cos(angle) if first else 1.0), 0.0
    for power in range(first, df - 1, 2):
        total += term
        term *= square * (power + 1) / (power + 2)
    inner = math.sin(angle) * total
    return 2 / math.pi * (angle + inner) if first else inner


def t_quantile(p: float, df: int) -> float:
    """The t with P(T < t) = p (p above one half), by halving an interval."""
    inside, low, high = 2 * p - 1, 0.0, 1.0
    while t_within(high, df) < inside:
        low, high = high, 2 * high
    while high - low > 1e-14 * high:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_within(middle, df) < inside else (low, middle)
    return (low + high) / 2


Z975 = 1.959963984540054


def _series(z: float) -> list[float]:
    """Coefficients of 1, 1/df, 1/df^2, ... in the expansion of the t quantile around the normal one."""
    powers = {1: [1, 1], 2: [3, 16, 5], 3: [-15, 17, 19, 3], 4: [-945, -1920, 1482, 776, 79]}
    divisors = {1: 4, 2: 96, 3: 384, 4: 92160}
    return [z] + [sum(c * z ** (2 * k + 1) for k, c in enumerate(powers[n])) / divisors[n] for n in powers]


T_TABLE_MAX_DF = 200
T975 = [t_quantile(0.975, k) for k in range(1, T_TABLE_MAX_DF + 1)]
T975_SERIES = _series(Z975)                     # past the table: exact to about 1e-13


def t975(df_col: Column) -> Column:
    """0.975 quantile of Student's t for a column of degrees of freedom."""
    table = F.array(*[F.lit(v) for v in T975])
    far = F.lit(0.0)
    for c in reversed(T975_SERIES):
        far = far / df_col + F.lit(c)
    return (F.when((df_col >= 1) & (df_col <= T_TABLE_MAX_DF), F.element_at(table, df_col.cast("int")))
            .when(df_col > T_TABLE_MAX_DF, far))


# ------------------------------------------------------------------- M1
def linear_trend(df: DataFrame, group: Sequence[str], x: str, y: str, digits: int = 2) -> DataFrame:
    """Per group: least-squares slope of y on x and its 95 % interval, rounded.

    Pairs with a NULL are left out (as lm does).  Fewer than 3 pairs give no
    interval; fewer than 2 distinct x give no slope.
    """
    g = df.groupBy(*group).agg(
        F.regr_count(F.col(y), F.col(x)).alias("__n"), F.regr_slope(F.col(y), F.col(x)).alias("__b"),
        F.regr_sxx(F.col(y), F.col(x)).alias("__sxx"), F.regr_sxy(F.col(y), F.col(x)).alias("__sxy"),
        F.regr_syy(F.col(y), F.col(x)).alias("__syy"))
    n, b = F.col("__n"), F.col("__b")
    resid = F.greatest(F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx"), F.lit(0.0))
    se = F.when(n > 2, F.sqrt(resid / (n - 2) / F.col("__sxx")))
    half = t975(n - 2) * se
    return g.select(*group, F.bround(b, digits).alias("trend"),
                    F.bround(b + half, digits).alias("upper95ci"),
                    F.bround(b - half, digits).alias("lower95ci"))


# ------------------------------------------------------------------- M2
BLOCKS_PER_DOUBLING = 1024


def _origin(x: Column) -> Column:
    """A number near x that a whole range of x shares: the middle of one of 1,024 steps between two powers of two."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x)))) / F.lit(float(BLOCKS_PER_DOUBLING))
    return F.when((F.abs(x) < 1e-300) | ~(F.abs(x) < 1e300), F.lit(0.0)).otherwise((F.floor(x / width) + 0.5) * width)


def quadratic_trend(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group: y = b0 + b1 x + b2 x^2 by least squares.

    Sums of powers are taken around an origin near the x of a block, so that
    nothing cancels, and merged by binomial shift to the group's mean: partial
    aggregates all the way, and a group gathers only its blocks, 1,024 at most
    for each doubling of x.  Rows with NULL x or y are left out; fewer than 3 rows
    or a singular system give NULL coefficients.
    """
    d = df.select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter(
        F.col("__x").isNotNull() & F.col("__y").isNotNull()).withColumn("__o", _origin(F.col("__x")))
    u, yy = F.col("__x") - F.col("__o"), F.col("__y")
    blocks = d.groupBy(*group, "__o").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(reduce(mul, [u] * k)).alias(f"s{k}") for k in range(1, 5)],
        F.sum(yy).alias("t0"), F.sum(u * yy).alias("t1"), F.sum(u * u * yy).alias("t2"))
    g = blocks.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("__o", "n", *[f"s{k}" for k in range(1, 5)], "t0", "t1", "t2"))).alias("__b"),
        F.sum("n").alias("__n"), (F.sum(F.col("n") * F.col("__o") + F.col("s1")) / F.sum("n")).alias("__xb"))

    def shifted(power: int, name: str):
        """Sum over the blocks of (u + d)^power, times y for name t; d is the way from the mean to the block's origin."""
        def add(total, b):
            d = b["__o"] - F.col("__xb")
            sums = [b["n"] if name == "s" else b["t0"], *[b[f"{name}{k}"] for k in range(1, power + 1)]]
            terms = [sums[power - k] * F.lit(float(math.comb(power, k))) * reduce(mul, [d] * k, F.lit(1.0))
                     for k in range(power + 1)]
            return total + reduce(add_, terms)
        return F.aggregate("__b", F.lit(0.0), add)

    g = g.select(*group, F.col("__n").cast("long").alias("n"), F.col("__xb"), *[
        shifted(k, "s").alias(f"__s{k}") for k in (2, 3, 4)], *[shifted(k, "t").alias(f"__t{k}") for k in range(3)])
    n, s2, s3, s4 = F.col("n"), F.col("__s2"), F.col("__s3"), F.col("__s4")
    sy, suy, suuy, xb = F.col("__t0"), F.col("__t1"), F.col("__t2"), F.col("__xb")
    q = s4 - s2 * s2 / n
    r = suuy - sy * s2 / n
    det = s2 * q - s3 * s3
    ok = (n >= 3) & (F.abs(det) > F.lit(1e-12) * F.greatest(F.abs(s2 * q), F.abs(s3 * s3), F.lit(1e-300)))
    c1 = (suy * q - s3 * r) / det
    c2 = (s2 * r - s3 * suy) / det
    c0 = (sy - c2 * s2) / n
    return g.select(*group, "n",
                    F.when(ok, c0 - c1 * xb + c2 * xb * xb).alias("intercept"),
                    F.when(ok, c1 - 2 * c2 * xb).alias("linear"),
                    F.when(ok, c2).alias("quadratic"))


# ------------------------------------------------------------------- M3
def local_trend(df: DataFrame, group: Sequence[str], x: str, y: str, span: float = 0.75) -> DataFrame:
    """Per group: local quadratic fit (span, tricube weights) evaluated at each x.

    ``df`` should hold one row per (group, x) -- e.g. yearly means -- so a
    group is one short array, and the fit is array functions on it.  Where the
    weighted points do not determine a parabola, a straight line is fitted,
    and where they do not determine a line, their weighted mean is taken.
    """
    group = list(group)
    rows = df.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    series = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    points, n = F.col("points"), F.size("points")
    near = F.greatest(F.least(F.floor(n * F.lit(span) + F.lit(1e-5)).cast("int"), n), F.lit(1))

    def fit(p):
        gaps = F.transform(points, lambda a: F.abs(a["x"] - p["x"]))
        reach = F.get(F.array_sort(gaps), near - 1) if span <= 1.0 else F.array_max(gaps) * F.lit(span)

        def add(m, a):
            u = F.try_divide(a["x"] - p["x"], reach)
            w = F.when(reach <= 0, F.when(a["x"] == p["x"], 1.0).otherwise(0.0)).when(
                F.abs(u) < 1, F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0)
            u = F.coalesce(u, F.lit(0.0))
            step = [w, w * u, w * u * u, w * u * u * u, w * u * u * u * u, w * a["y"], w * u * a["y"], w * u * u * a["y"]]
            return F.array(*[m[k] + v for k, v in enumerate(step)])

        return F.struct(p["x"].alias("x"), p["y"].alias("y"),
                        F.aggregate(points, F.array(*[F.lit(0.0)] * 8), add).alias("m"))

    fitted = series.select(*group, F.explode(F.transform(points, fit)).alias("f")).select(*group, "f.*")
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col("m")[k] for k in range(8))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    parabola = F.try_divide(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2), det)
    flat = s0 * s2 - s1 * s1
    line = F.try_divide(t0 * s2 - t1 * s1, flat)
    return fitted.select(*group, "x", "y", F.when(det > F.lit(1e-10) * s0 * s2 * s4, parabola)
                         .when(flat > F.lit(1e-10) * s0 * s2, line).otherwise(t0 / s0).alias("fitted"))


def local_trend_sql(series: str, group: str, span: float) -> str:
    """DuckDB CTEs ``m3_gaps`` to ``m3`` for a CTE ``series`` with columns (group, x, y)."""
    reach = (f"max(CASE WHEN rk = greatest(least(CAST(floor(n * {span} + 1e-5) AS BIGINT), n), 1) THEN gap END)"
             if span <= 1.0 else f"max(gap) * {span}")
    sums = ", ".join(f"sum(w * {'*'.join(['u'] * k) or '1'}) AS s{k}" for k in range(5))
    sums += ", " + ", ".join(f"sum(w * {'*'.join(['u'] * k) or '1'} * y1) AS t{k}" for k in range(3))
    return f"""
m3_gaps AS (SELECT a.{group}, a.x, a.y, b.x AS x1, b.y AS y1, abs(b.x - a.x) AS gap,
              row_number() OVER (PARTITION BY a.{group}, a.x ORDER BY abs(b.x - a.x)) AS rk,
              count(*) OVER (PARTITION BY a.{group}, a.x) AS n
            FROM {series} a JOIN {series} b ON a.{group} = b.{group}),
m3_reach AS (SELECT {group}, x, {reach} AS h FROM m3_gaps GROUP BY {group}, x),
m3_weights AS (SELECT g.*, CASE WHEN h > 0 THEN (x1 - g.x) / h ELSE 0 END AS u,
                 CASE WHEN h <= 0 THEN CASE WHEN x1 = g.x THEN 1.0 ELSE 0.0 END
                      WHEN gap / h < 1 THEN pow(1 - pow(gap / h, 3), 3) ELSE 0.0 END AS w
               FROM m3_gaps g JOIN m3_reach r ON g.{group} = r.{group} AND g.x = r.x),
m3_sums AS (SELECT {group}, x, any_value(y) AS y, {sums} FROM m3_weights GROUP BY {group}, x),
m3_det AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
             s0 * s2 - s1 * s1 AS flat FROM m3_sums),
m3 AS (SELECT {group}, x, y, CASE
         WHEN det > 1e-10 * s0 * s2 * s4
           THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det
         WHEN flat > 1e-10 * s0 * s2 THEN (t0 * s2 - t1 * s1) / flat ELSE t0 / s0 END AS fitted FROM m3_det)"""
