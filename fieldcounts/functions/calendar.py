"""Survey calendar: study year, study day, season, survey period.

All are closed-form column expressions: no lookup join, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nullsafe import _col


def study_year(date) -> Column:
    """Months before June belong to the previous study year (rule 1)."""
    d = _col(date)
    m, y = F.month(d), F.year(d)
    return F.when(m < 6, y - 1).when(m >= 6, y)


def season(date, rule: int = 1) -> Column:
    """Season label.

    rule 1: month < 6 -> year - 1, else year (June is this year's season).
    rule 2: month > 6 -> year, else year - 1 (June is last year's season).
    """
    d = _col(date)
    m, y = F.month(d), F.year(d)
    if rule == 1:
        return F.when(m < 6, y - 1).when(m >= 6, y)
    if rule == 2:
        return F.when(m > 6, y).when(m <= 6, y - 1)
    raise ValueError("rule must be 1 or 2")


def study_day(date, first_year: int | None = None, last_year: int | None = None) -> Column:
    """Days after Nov 1 of the calendar year; earlier days count on from Dec 31.

    Keeps the reference's result exactly: Nov 1 itself is not "after" Nov 1,
    so it gets ``yday + (dec31 - nov1)`` (365, or 366 in leap years).  With
    ``first_year`` and ``last_year`` (the surveyed lookup has 1989 to 2020),
    other calendar years give NULL, as a lookup without their row does.
    """
    d = _col(date)
    y = F.year(d)
    yday = F.dayofyear(d)
    nov1 = F.dayofyear(F.make_date(y, F.lit(11), F.lit(1)))
    dec31 = F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))
    value = F.when(yday > nov1, yday - nov1).otherwise(yday + (dec31 - nov1))
    if first_year is not None:
        value = F.when(y >= first_year, value)
    return value if last_year is None else F.when(y <= last_year, value)


def survey_period(date) -> Column:
    """Dec -> 1; Jan 1-15 -> 2; Jan 16-31 -> 3; Feb -> 4; otherwise NULL."""
    d = _col(date)
    m, day = F.month(d), F.dayofmonth(d)
    return (F.when(m == 12, 1)
            .when((m == 1) & (day <= 15), 2)
            .when((m == 1) & (day > 15), 3)
            .when(m == 2, 4))


def with_study_day(df: DataFrame, date: str = "visit_date", first_year: int | None = None,
                   last_year: int | None = None) -> DataFrame:
    """add ``year_day``, ``study_year`` and ``study_day``."""
    return df.withColumns({
        "year_day": F.dayofyear(F.col(date)),
        "study_year": study_year(date),
        "study_day": study_day(date, first_year, last_year),
    })


def with_season(df: DataFrame, date: str = "visit_date", rule: int = 1, name: str = "season") -> DataFrame:
    """add a season column under either rule."""
    return df.withColumn(name, season(date, rule))


def with_survey_period(df: DataFrame, date: str = "visit_date", name: str = "survey_period") -> DataFrame:
    """add the survey period."""
    return df.withColumn(name, survey_period(date))
