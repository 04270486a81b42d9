"""Column helpers that give R's missing-value rules on Spark.

Every helper returns a ``Column`` (or a DataFrame for joins) built from
``pyspark.sql.functions`` only, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# An aggregate over a group with any missing value is missing.
def strict(agg, c) -> Column:
    """``agg(c)`` when no value of the group is NULL, else NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c) -> Column:
    return strict(F.sum, c)


def strict_max(c) -> Column:
    return strict(F.max, c)


def strict_min(c) -> Column:
    return strict(F.min, c)


def strict_avg(c) -> Column:
    return strict(F.avg, c)


# T4: ifelse(NA, a, b) is NA.
def if_else(cond: Column, yes, no) -> Column:
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


# T5: NA %in% set is FALSE, so !x %in% set keeps NA rows.
def in_set(c, values: Iterable) -> Column:
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def not_in_set(c, values: Iterable) -> Column:
    return ~in_set(c, values)


# paste() prints NA as "NA".
def as_text(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def paste(*cols, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[as_text(c) for c in cols])


# 0/0 is NaN in R; NULL stands for it here.
def safe_divide(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


# grepl(pattern, NA) is FALSE.
def grepl(c, pattern: str) -> Column:
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


# arrange() puts NA last in both directions.
def sort_keys(*keys) -> list[Column]:
    out = []
    for k in keys:
        if isinstance(k, str) and k.startswith("-"):
            out.append(F.col(k[1:]).desc_nulls_last())
        elif isinstance(k, str):
            out.append(F.col(k).asc_nulls_last())
        else:
            out.append(k)
    return out


# Round-half-even of an exact ratio of two integers.
def round_half_even_ratio(num, den, digits: int) -> Column:
    """``round(num / den, digits)`` with ties to even, computed exactly.

    ``num`` and ``den`` are integral columns (``den > 0``).  Working on the
    integer ratio avoids binary-double ties (2.675) that Spark's ``bround``
    and other engines resolve differently.
    """
    scale = 10 ** digits
    n = _col(num).cast("long") * F.lit(scale)
    d = _col(den).cast("long")
    q0 = F.floor(n.cast("double") / d.cast("double")).cast("long")
    r0 = n - q0 * d
    # the double quotient can miss by one near an integer: correct exactly
    q = F.when(r0 < 0, q0 - 1).when(r0 >= d, q0 + 1).otherwise(q0)
    twice = (n - q * d) * 2
    q_even = F.when(twice > d, q + 1).when(twice < d, q).otherwise(
        F.when(F.pmod(q, F.lit(2)) == 0, q).otherwise(q + 1))
    return q_even.cast("double") / F.lit(float(scale))


def ratio_rounded(total, n, kind: T.DataType, digits: int) -> Column:
    """``total / n`` rounded half-even to ``digits``; ``kind`` is the type of the summed values.

    Whole numbers and decimals are divided as integers (a decimal by its own
    scale), so ties are exact; doubles are rounded as doubles, and so are
    decimals whose total does not fit a long at that scale.
    """
    total, n = _col(total), _col(n)
    if isinstance(kind, T.IntegralType):
        return round_half_even_ratio(total, n, digits)
    rounded = F.bround(total.cast("double") / n, digits)
    if isinstance(kind, T.DecimalType) and kind.scale <= 18:
        unit = 10 ** kind.scale
        fits = (F.abs(total.cast("double")) < 4e18 / (unit * 10 ** digits)) & (n.cast("double") < 4e18 / unit)
        exact = round_half_even_ratio((total * F.lit(unit)).cast("decimal(38,0)"), n * F.lit(unit), digits)
        return F.when(fits, exact).otherwise(rounded)
    return rounded


def mean_rounded(df: DataFrame, column: str, digits: int) -> Column:
    """Strict mean of a column of ``df`` rounded half-even to ``digits`` (see ``ratio_rounded``)."""
    n = F.count(column)
    rounded = ratio_rounded(F.sum(column), n, df.schema[column].dataType, digits)
    return F.when((n == F.count(F.lit(1))) & (n > 0), rounded)


# Dplyr joins match NA keys with NA keys.
def natural_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; one copy of each key column.

    For full joins the key is the first non-NULL of both sides.  Other column
    names must not clash (as with ``by=`` in dplyr, rename beforehand).
    """
    how = {"full_outer": "full", "outer": "full", "left_outer": "left",
           "right_outer": "right"}.get(how, how)
    lk = {k: f"__l_{k}" for k in keys}
    rk = {k: f"__r_{k}" for k in keys}
    l2 = left.select(*[F.col(c).alias(lk[c]) if c in lk else F.col(c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(rk[c]) if c in rk else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(lk[k]).eqNullSafe(F.col(rk[k])) for k in keys])
    joined = l2.join(r2, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined.select(*[F.col(lk[c]).alias(c) if c in lk else F.col(c) for c in left.columns])
    if how == "full":
        key_cols = [F.coalesce(F.col(lk[k]), F.col(rk[k])).alias(k) for k in keys]
    elif how == "right":
        key_cols = [F.col(rk[k]).alias(k) for k in keys]
    else:
        key_cols = [F.col(lk[k]).alias(k) for k in keys]
    rest_l = [c for c in left.columns if c not in lk]
    rest_r = [c for c in right.columns if c not in rk]
    return joined.select(*key_cols, *rest_l, *rest_r)


# K1: ordered output (only at sinks: a global sort is a range shuffle).
def arrange(df: DataFrame, *keys) -> DataFrame:
    """Sort like ``arrange``: ``"col"`` ascending, ``"-col"`` descending, NULLs last both ways."""
    return df.orderBy(*sort_keys(*keys))
