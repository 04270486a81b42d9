import datetime as dt

from fieldcounts.functions.calendar import with_season, with_study_day, with_survey_period
from conftest import rows

D = dt.date


def _frame(spark, dates):
    return spark.createDataFrame([(d,) for d in dates], "visit_date date")


def test_study_day_quirks(spark):
    dates = [D(1995, 11, 1), D(1995, 11, 2), D(1996, 11, 1), D(1996, 11, 2), D(1996, 12, 31), D(1997, 1, 1),
             D(1996, 2, 29), D(2021, 1, 5), D(1988, 12, 1), None]
    out = {r.visit_date: (r.study_year, r.study_day)
           for r in with_study_day(_frame(spark, dates)).collect()}
    assert out[D(1995, 11, 1)] == (1995, 365)   # Nov 1 is not "after" Nov 1
    assert out[D(1995, 11, 2)] == (1995, 1)
    assert out[D(1996, 11, 1)] == (1996, 366)   # leap year
    assert out[D(1996, 11, 2)] == (1996, 1)
    assert out[D(1996, 12, 31)] == (1996, 60)
    assert out[D(1997, 1, 1)] == (1996, 61)
    assert out[D(1996, 2, 29)] == (1995, 120)
    assert out[D(2021, 1, 5)] == (2020, 65)      # no last year unless asked for
    assert out[D(1988, 12, 1)] == (1988, 30)
    bounded = {r.visit_date: r.study_day for r in with_study_day(_frame(spark, dates), first_year=1989,
                                                                 last_year=2020).collect()}
    assert bounded[D(2021, 1, 5)] is None and bounded[D(1988, 12, 1)] is None and bounded[D(1996, 12, 31)] == 60
    assert out[None] == (None, None)


def test_season_rules_differ_in_june(spark):
    dates = [D(2000, 5, 31), D(2000, 6, 1), D(2000, 6, 30), D(2000, 7, 1)]
    df = with_season(with_season(_frame(spark, dates), rule=1, name="r1"), rule=2, name="r2")
    assert rows(df, "visit_date", "r1", "r2") == [
        (D(2000, 5, 31), 1999, 1999), (D(2000, 6, 1), 2000, 1999),
        (D(2000, 6, 30), 2000, 1999), (D(2000, 7, 1), 2000, 2000)]


def test_survey_period(spark):
    dates = [D(2000, 12, 1), D(2001, 1, 15), D(2001, 1, 16), D(2001, 2, 28), D(2001, 3, 1)]
    df = with_survey_period(_frame(spark, dates))
    assert rows(df, "visit_date", "survey_period") == [
        (D(2000, 12, 1), 1), (D(2001, 1, 15), 2), (D(2001, 1, 16), 3), (D(2001, 2, 28), 4), (D(2001, 3, 1), None)]
