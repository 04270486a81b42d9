"""SQL text of the calendar expressions (twins of functions/calendar.py)."""

from __future__ import annotations


def study_year(d: str = "visit_date") -> str:
    return (f"CAST(CASE WHEN month({d}) < 6 THEN year({d}) - 1 "
            f"WHEN month({d}) >= 6 THEN year({d}) END AS INTEGER)")


def season(d: str = "visit_date", rule: int = 1) -> str:
    if rule == 1:
        return study_year(d)
    return (f"CAST(CASE WHEN month({d}) > 6 THEN year({d}) "
            f"WHEN month({d}) <= 6 THEN year({d}) - 1 END AS INTEGER)")


def study_day(d: str = "visit_date") -> str:
    nov1 = f"dayofyear(make_date(CAST(year({d}) AS INTEGER), 11, 1))"
    dec31 = f"dayofyear(make_date(CAST(year({d}) AS INTEGER), 12, 31))"
    return (f"CAST(CASE WHEN dayofyear({d}) > {nov1} THEN dayofyear({d}) - {nov1} "
            f"ELSE dayofyear({d}) + ({dec31} - {nov1}) END AS INTEGER)")


def survey_period(d: str = "visit_date") -> str:
    return (f"CAST(CASE WHEN month({d}) = 12 THEN 1 WHEN month({d}) = 1 AND day({d}) <= 15 THEN 2 "
            f"WHEN month({d}) = 1 AND day({d}) > 15 THEN 3 WHEN month({d}) = 2 THEN 4 END AS INTEGER)")


def with_study_day(src: str, name: str, d: str = "visit_date") -> str:
    """CTE ``name`` = ``src`` plus year_day, study_year, study_day."""
    return (f"{name} AS (SELECT *, CAST(dayofyear({d}) AS INTEGER) AS year_day, "
            f"{study_year(d)} AS study_year, {study_day(d)} AS study_day FROM {src})")
