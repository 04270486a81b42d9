"""M3 as it is drawn: a local regression fitted at a few vertices and blended between them.

A series' range (a little widened) is cut at the median of its points, and the
halves again, until a cell has at most ``cell`` times the span's points.  At
the ends of the cells a weighted parabola (tricube weights, the span's nearest
points) gives a value and a slope, and a cubic Hermite piece joins two
neighbouring vertices.  The curve is given on a grid of 80 points from the
first to the last x.  A series of n points has about 2 / (span * cell) cells,
so the work is n times that, not n squared.

Where the weighted points do not determine a parabola, a straight line is
fitted, and where they do not determine a line, their weighted mean is taken.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = 0.2                 # largest share of the span's points in a cell
GRID = 80                  # points of the drawn line
MARGIN, FLAT = 0.005, 1e-10


def vertices(x: np.ndarray, span: float, cell: float = CELL) -> np.ndarray:
    """The ends of the cells of the sorted ``x``."""
    most = max(int(np.floor(len(x) * span * cell)), 1)
    margin = MARGIN * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    found, todo = [x[0] - margin, x[-1] + margin], [(0, len(x) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first + 1 <= most or x[first] == x[last]:
            continue
        middle = (first + last + 2) // 2 - 1                # the lower median, counted from 1
        if x[middle] == x[middle + 1]:                      # ties: the nearest place where the values differ
            steps = np.flatnonzero(np.diff(x[first:last + 1]) > 0) + first
            middle = int(steps[np.argmin(np.abs(steps - middle))])
        found.append((x[middle] + x[middle + 1]) / 2)
        todo += [(first, middle), (middle + 1, last)]
    return np.array(sorted(found))


def fit_at(v: float, x: np.ndarray, y: np.ndarray, span: float) -> tuple[float, float]:
    """Value and slope at ``v`` of the weighted parabola through the span's nearest points."""
    gap = np.abs(x - v)
    near = max(min(int(np.floor(len(x) * span + 1e-5)), len(x)), 1)
    reach = np.partition(gap, near - 1)[near - 1] if span <= 1 else gap.max() * span
    if reach <= 0:
        return float(y[gap == 0].mean()), 0.0
    u = (x - v) / reach
    w = np.where(gap < reach, (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0.0)
    s0, s1, s2, s3, s4 = (float((w * u ** k).sum()) for k in range(5))
    t0, t1, t2 = (float((w * u ** k * y).sum()) for k in range(3))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    flat = s0 * s2 - s1 * s1
    if det > FLAT * s0 * s2 * s4:
        value = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
        slope = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
        return value / det, slope / det / reach
    if flat > FLAT * s0 * s2:
        return (t0 * s2 - t1 * s1) / flat, (s0 * t1 - s1 * t0) / flat / reach
    return t0 / s0 if s0 > 0 else float(y[gap == gap.min()].mean()), 0.0


def curve(x: np.ndarray, y: np.ndarray, span: float, grid: int = GRID, cell: float = CELL):
    """(grid, fitted) of one series; ``x`` in any order."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ends = vertices(x, span, cell)
    fits = np.array([fit_at(v, x, y, span) for v in ends])
    at = np.linspace(x[0], x[-1], grid)
    k = np.clip(np.searchsorted(ends, at, side="right") - 1, 0, len(ends) - 2)
    width = ends[k + 1] - ends[k]
    h = (at - ends[k]) / width
    value, slope = fits[:, 0], fits[:, 1]
    fitted = ((1 - h) ** 2 * (1 + 2 * h) * value[k] + h ** 2 * (3 - 2 * h) * value[k + 1]
              + (h * (1 - h) ** 2 * slope[k] - h ** 2 * (1 - h) * slope[k + 1]) * width)
    return at, fitted


def smooth_curve(df: DataFrame, group: Sequence[str], x: str, y: str, span: float = 0.75, grid: int = GRID) -> DataFrame:
    """(group, x, fitted): the drawn line of each group; pairs with a NULL are left out.

    ``df`` should hold one row per (group, x), such as yearly means: a series
    is one task's group, so its length is the number of different x.
    """
    group = list(group)
    rows = df.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    shape = T.StructType([df.schema[g] for g in group] + [T.StructField("x", T.DoubleType()),
                                                          T.StructField("fitted", T.DoubleType())])

    def draw(series: pa.Table) -> pa.Table:
        at, fitted = curve(series.column("x").to_numpy(), series.column("y").to_numpy(), span, grid)
        first = series.slice(0, 1)
        held = {g: pa.concat_arrays([first.column(g).combine_chunks()] * len(at)) for g in group}
        return pa.table({**held, "x": pa.array(at), "fitted": pa.array(fitted)})

    return rows.groupBy(*group).applyInArrow(draw, shape)


def smooth_curve_sql(series: str, group: str, span: float, grid: int = GRID) -> str:
    """DuckDB CTEs ending in ``curve`` for a CTE ``series`` with columns (group, x, y), x different in a group."""
    reach = ("max(CASE WHEN rk = greatest(least(CAST(floor(n * {0} + 1e-5) AS BIGINT), n), 1) THEN gap END)"
             if span <= 1.0 else "max(gap) * {0}").format(span)
    sums = ", ".join(f"sum(w * {'*'.join(['u'] * k) or '1'}) AS s{k}" for k in range(5))
    sums += ", " + ", ".join(f"sum(w * {'*'.join(['u'] * k) or '1'} * y) AS t{k}" for k in range(3))
    return f"""
sc_points AS (SELECT {group} AS g, x, y, row_number() OVER (PARTITION BY {group} ORDER BY x) AS i,
                count(*) OVER (PARTITION BY {group}) AS n FROM {series} WHERE x IS NOT NULL AND y IS NOT NULL),
sc_box AS (SELECT g, n, min(x) AS lo, max(x) AS hi,
             {MARGIN} * greatest(max(x) - min(x), greatest(abs(min(x)), abs(max(x))) * 1e-3 + 1e-30) AS margin,
             greatest(CAST(floor(n * {span} * {CELL}) AS BIGINT), 1) AS most FROM sc_points GROUP BY g, n),
sc_cells(g, l, u, v) AS (
  SELECT g, 1, n, NULL::DOUBLE FROM sc_box
  UNION ALL
  SELECT c.g, CASE WHEN s.side = 0 THEN c.l ELSE (c.l + c.u) // 2 + 1 END,
         CASE WHEN s.side = 0 THEN (c.l + c.u) // 2 ELSE c.u END, (a.x + b.x) / 2
  FROM sc_cells c JOIN sc_box k ON k.g IS NOT DISTINCT FROM c.g
  JOIN sc_points a ON a.g IS NOT DISTINCT FROM c.g AND a.i = (c.l + c.u) // 2
  JOIN sc_points b ON b.g IS NOT DISTINCT FROM c.g AND b.i = (c.l + c.u) // 2 + 1, (VALUES (0), (1)) s(side)
  WHERE c.u - c.l + 1 > k.most),
sc_ends AS (SELECT DISTINCT g, v FROM sc_cells WHERE v IS NOT NULL
  UNION SELECT g, lo - margin FROM sc_box UNION SELECT g, hi + margin FROM sc_box),
sc_gaps AS (SELECT e.g, e.v, p.x, p.y, p.n, abs(p.x - e.v) AS gap,
              row_number() OVER (PARTITION BY e.g, e.v ORDER BY abs(p.x - e.v)) AS rk
            FROM sc_ends e JOIN sc_points p ON p.g IS NOT DISTINCT FROM e.g),
sc_reach AS (SELECT g, v, {reach} AS h FROM sc_gaps GROUP BY g, v),
sc_weights AS (SELECT a.g, a.v, a.y, a.gap, r.h, CASE WHEN r.h > 0 THEN (a.x - a.v) / r.h ELSE 0 END AS u,
                 CASE WHEN r.h <= 0 THEN CASE WHEN a.gap = 0 THEN 1.0 ELSE 0.0 END
                      WHEN a.gap < r.h THEN pow(1 - pow(a.gap / r.h, 3), 3) ELSE 0.0 END AS w
               FROM sc_gaps a JOIN sc_reach r ON r.g IS NOT DISTINCT FROM a.g AND r.v = a.v),
sc_sums AS (SELECT g, v, any_value(h) AS h, arg_min(y, gap) AS near, {sums} FROM sc_weights GROUP BY g, v),
sc_det AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
             s0 * s2 - s1 * s1 AS flat FROM sc_sums),
sc_fits AS (SELECT g, v,
    CASE WHEN det > {FLAT} * s0 * s2 * s4
           THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det
         WHEN flat > {FLAT} * s0 * s2 THEN (t0 * s2 - t1 * s1) / flat WHEN s0 > 0 THEN t0 / s0 ELSE near END AS value,
    CASE WHEN det > {FLAT} * s0 * s2 * s4
           THEN (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det / h
         WHEN flat > {FLAT} * s0 * s2 THEN (s0 * t1 - s1 * t0) / flat / h ELSE 0.0 END AS slope FROM sc_det),
sc_pieces AS (SELECT g, v, value, slope, lead(v) OVER w AS v1, lead(value) OVER w AS value1, lead(slope) OVER w AS slope1
              FROM sc_fits WINDOW w AS (PARTITION BY g ORDER BY v)),
sc_grid AS (SELECT g, k, lo + k * (hi - lo) / {grid - 1} AS x FROM sc_box, range({grid}) r(k)),
sc_at AS (SELECT a.g, a.k, a.x, p.*, (a.x - p.v) / (p.v1 - p.v) AS h FROM sc_grid a JOIN sc_pieces p
  ON p.g IS NOT DISTINCT FROM a.g AND p.v1 IS NOT NULL AND a.x >= p.v AND a.x < p.v1),
curve AS (SELECT g AS {group}, x, (1 - h) * (1 - h) * (1 + 2 * h) * value + h * h * (3 - 2 * h) * value1
            + (h * (1 - h) * (1 - h) * slope - h * h * (1 - h) * slope1) * (v1 - v) AS fitted FROM sc_at)"""
