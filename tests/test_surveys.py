import datetime as dt

from fieldcounts.functions.calendar import with_study_day
from fieldcounts.operators import surveys as SV
from conftest import rows

D = dt.date


def _obs(spark, dates):
    data = [(d, "X", 1, 5) for d in dates]
    return with_study_day(spark.createDataFrame(data, "visit_date date, alpha_code string, section int, "
                                                      "section_final long"))


def test_numbering_branches(spark):
    dates = [
        # 2001: four surveys -> order
        D(2001, 12, 10), D(2002, 1, 5), D(2002, 1, 20), D(2002, 2, 5),
        # 2003: three, one in February -> period
        D(2004, 1, 5), D(2004, 1, 20), D(2004, 2, 5),
        # 2005: three, none in February -> order
        D(2005, 12, 10), D(2006, 1, 5), D(2006, 1, 20),
        # 2007: five -> NULL
        D(2007, 12, 1), D(2007, 12, 20), D(2008, 1, 5), D(2008, 1, 20), D(2008, 2, 5),
        # 2009: a March date -> NULL period, strict max unknown -> period
        D(2010, 1, 5), D(2010, 1, 20), D(2010, 3, 5),
    ]
    n = SV.survey_numbers(_obs(spark, dates), overrides=[])
    got = {r.visit_date: r.cor_survey_num for r in n.collect()}
    assert [got[d] for d in dates[:4]] == [1, 2, 3, 4]
    assert [got[d] for d in dates[4:7]] == [2, 3, 4]
    assert [got[d] for d in dates[7:10]] == [1, 2, 3]
    assert [got[d] for d in dates[10:15]] == [None] * 5
    assert [got[d] for d in dates[15:18]] == [2, 3, None]


def test_overrides_apply_in_order(spark):
    dates = [D(2005, 12, 10), D(2006, 1, 5), D(2006, 1, 20)]
    ov = [{"study_year": 2005, "add": 1}, {"study_year": 2005, "survey_num": 2, "set": 9}]
    n = SV.survey_numbers(_obs(spark, dates), overrides=ov)
    assert rows(n, "survey_num", "cor_survey_num") == [(1, 2), (2, 9), (3, 4)]


def test_intervals_lag_crosses_years(spark):
    # 2003 ends with number 4 (Feb 5 2004); 2004's first kept row is number 2:
    # not consecutive with 4 -> NULL; inside 2004, 2 -> 3 is consecutive.
    dates = [D(2004, 1, 5), D(2004, 1, 20), D(2004, 2, 5), D(2005, 1, 5), D(2005, 1, 20), D(2005, 2, 5)]
    n = SV.survey_numbers(_obs(spark, dates), overrides=[])
    iv = SV.survey_intervals(n)
    got = {r.visit_date: (r.cor_survey_num, r.survey_interval) for r in iv.collect()}
    assert got[D(2004, 1, 20)] == (3, 15)
    assert got[D(2004, 2, 5)] == (4, 16)
    assert got[D(2005, 1, 5)] == (2, None)
    assert got[D(2005, 1, 20)] == (3, 15)
    # a year whose last number is 1 followed by a year starting at 2: consecutive across years
    dates2 = [D(2005, 12, 10), D(2006, 1, 5), D(2006, 1, 20), D(2007, 1, 10)]
    n2 = SV.survey_numbers(_obs(spark, dates2), overrides=[{"study_year": 2006, "survey_num": 1, "set": 4}])
    iv2 = {r.visit_date: r.survey_interval for r in SV.survey_intervals(n2).collect()}
    # 2005: 1,2,3 (rows 2, 3 kept); 2006: single date -> number 1 set to 4; 3 -> 4 consecutive across years
    # study days: Jan 10 -> 70, Jan 20 -> 80 (the difference of study days, as in the reference)
    assert iv2[D(2007, 1, 10)] == -10


def test_sample_is_repeatable_and_k_per_year(spark):
    dates = [D(2001, 12, 10), D(2002, 1, 5), D(2002, 1, 20), D(2002, 2, 5),
             D(2003, 12, 10), D(2004, 1, 5), D(2004, 1, 20), D(2004, 2, 5)]
    n = SV.survey_numbers(_obs(spark, dates), overrides=[])
    a = rows(SV.sample_surveys(n, 3, seed=7), "study_year", "cor_survey_num")
    b = rows(SV.sample_surveys(n, 3, seed=7), "study_year", "cor_survey_num")
    assert a == b
    per_year = {}
    for y, _ in a:
        per_year[y] = per_year.get(y, 0) + 1
    # years span 2001..2003; 2002 has no surveys, so nothing joins for it
    assert per_year == {2001: 3, 2003: 3}


def test_effort_subsets_null_number_only_in_all(spark):
    obs_num = spark.createDataFrame(
        [(2000, "X", 1, 10), (2000, "X", 2, 20), (2000, "X", 3, 30), (2000, "X", None, 40)],
        "study_year int, alpha_code string, cor_survey_num int, section_final long")
    e = SV.effort_subsets(obs_num)
    got = {r.which_surveys: r.mean_bay_survey_count for r in e.collect()}
    assert got == {"all": 25.0, "3": 20.0, "2": 15.0, "1": 10.0}


def test_effort_all_equals_bay_mean_on_driver_tables(spark):
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from fieldcounts.plans import views as V
    o = with_study_day(V.survey_obs(spark, SF_SMALL))
    on = SV.attach_survey_numbers(o, SV.survey_numbers(o))
    a22 = SV.effort_subsets(on).filter(F.col("which_surveys") == "all").drop("which_surveys")
    a21 = SV.bay_mean_by_taxon(on)
    assert a22.count() == a21.count() > 0
    assert a22.exceptAll(a21.select(*a22.columns)).count() == 0
