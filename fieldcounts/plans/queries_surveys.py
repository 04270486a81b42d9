"""Bound queries: survey numbering, intervals, sampling and effort comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import with_study_day
from ..operators import surveys as SV
from . import sqlcal as C
from . import views as V
from .catalog import r6, register
from .sqltext import strict, strict_sum

# Test binding of the manual corrections (FIXTURES.md): add 1 in 1997; (1995, 2) -> 3.
TEST_OVERRIDES = [{"study_year": 1997, "add": 1}, {"study_year": 1995, "survey_num": 2, "set": 3}]
SAMPLE_SEED = 42


def _override_sql(overrides, base="c0"):
    expr = base
    for o in overrides:
        cond = f"study_year = {o['study_year']}"
        if o.get("survey_num") is not None:
            cond += f" AND survey_num = {o['survey_num']}"
        new = str(o["set"]) if "set" in o else f"({expr}) + {o.get('add', 0)}"
        expr = f"CASE WHEN {cond} THEN {new} WHEN NOT ({cond}) THEN {expr} END"
    return expr


def _numbers_sql(src_cte: str, src: str, overrides) -> str:
    return src_cte + ",\n" + C.with_study_day(src, "so_cal") + f""",
cal AS (SELECT DISTINCT study_year, visit_date, study_day FROM so_cal),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_year ORDER BY visit_date ASC NULLS LAST) AS INTEGER)
                  AS survey_num, {C.survey_period()} AS survey_period FROM cal),
agg AS (SELECT *, max(survey_num) OVER (PARTITION BY study_year) AS mx,
               CASE WHEN count(survey_period) OVER (PARTITION BY study_year) = count(*) OVER (PARTITION BY study_year)
                    THEN max(survey_period) OVER (PARTITION BY study_year) END AS mp FROM num),
cor0 AS (SELECT *, CASE WHEN mx = 4 THEN survey_num WHEN mx < 4 AND mp < 4 THEN survey_num
                        WHEN mx < 4 THEN survey_period END AS c0 FROM agg),
numbers AS (SELECT study_year, visit_date, study_day, survey_num, survey_period,
                   CAST({_override_sql(overrides)} AS INTEGER) AS cor_survey_num FROM cor0),
obs_num AS (SELECT o.*, n.cor_survey_num FROM so_cal o LEFT JOIN numbers n
            ON o.study_year IS NOT DISTINCT FROM n.study_year AND o.visit_date IS NOT DISTINCT FROM n.visit_date),
st AS (SELECT study_year, alpha_code, cor_survey_num, {strict_sum('section_final')} AS bay_total
       FROM obs_num GROUP BY study_year, alpha_code, cor_survey_num)"""


SQL_NUM = _numbers_sql(V.SQL_SURVEY_OBS, "survey_obs", TEST_OVERRIDES)
SQL_NUM_ALL = _numbers_sql(V.SQL_OBS, "obs", SV.REFERENCE_OVERRIDES)


def numbers(spark, d):
    return SV.survey_numbers(with_study_day(V.survey_calendar(spark, d)), TEST_OVERRIDES)


def obs_num(spark, d):
    return SV.attach_survey_numbers(with_study_day(V.survey_obs(spark, d)), numbers(spark, d))


@register("w6_survey_numbers", V.ctes(SQL_NUM) + "\nSELECT * FROM numbers")
def w6_survey_numbers(spark, d):
    """W6 on the chosen survey calendar: every correction branch, test overrides."""
    return numbers(spark, d)


@register("w6_survey_numbers_all_dates", V.ctes(SQL_NUM_ALL) + "\nSELECT * FROM numbers")
def w6_survey_numbers_all_dates(spark, d):
    """W6 on every date of the table (years with more than 4 dates -> NULL), reference overrides."""
    return SV.survey_numbers(with_study_day(V.obs(spark, d)))


@register("w6_attach_survey_numbers", V.ctes(SQL_NUM) + """
SELECT cor_survey_num, count(*) AS n_records, CAST(sum(section_final) AS BIGINT) AS total
FROM obs_num GROUP BY cor_survey_num""")
def w6_attach_survey_numbers(spark, d):
    """W6 attached back to every record (records and totals per corrected number)."""
    return obs_num(spark, d).groupBy("cor_survey_num").agg(F.count(F.lit(1)).alias("n_records"),
                                                           F.sum("section_final").alias("total"))


@register("w7_survey_intervals", V.ctes(SQL_NUM, """
f AS (SELECT * FROM numbers WHERE cor_survey_num > 1)""") + """
SELECT *, CASE WHEN cor_survey_num = lag(cor_survey_num) OVER w + 1 THEN study_day - lag(study_day) OVER w END
          AS survey_interval
FROM f WINDOW w AS (ORDER BY study_year ASC NULLS LAST, study_day ASC NULLS LAST, visit_date ASC NULLS LAST)""")
def w7_survey_intervals(spark, d):
    """Days between consecutive corrected surveys (global lag, computed per year)."""
    return SV.survey_intervals(numbers(spark, d))


@register("w7_survey_intervals_all_dates", V.ctes(SQL_NUM_ALL, """
f AS (SELECT * FROM numbers WHERE cor_survey_num > 1)""") + """
SELECT *, CASE WHEN cor_survey_num = lag(cor_survey_num) OVER w + 1 THEN study_day - lag(study_day) OVER w END
          AS survey_interval
FROM f WINDOW w AS (ORDER BY study_year ASC NULLS LAST, study_day ASC NULLS LAST, visit_date ASC NULLS LAST)""")
def w7_survey_intervals_all_dates(spark, d):
    """W7 on every date (all numbers NULL there, so no rows: the filter is exercised)."""
    return SV.survey_intervals(SV.survey_numbers(with_study_day(V.obs(spark, d))))


_DATE_CELLS = ", ".join(
    f"string_agg(CAST(visit_date AS VARCHAR), ', ' ORDER BY CAST(visit_date AS VARCHAR)) "
    f"FILTER (WHERE cor_survey_num = {i}) AS s_{i}" for i in range(1, 5)) + """,
  string_agg(cor_survey_num || ': ' || visit_date, ', ' ORDER BY cor_survey_num || ': ' || visit_date)
    FILTER (WHERE cor_survey_num NOT BETWEEN 1 AND 4) AS s_over"""


@register("r17_survey_date_matrix", V.ctes(SQL_NUM) + "\nSELECT study_year, " + _DATE_CELLS
          + " FROM numbers GROUP BY study_year")
def r17_survey_date_matrix(spark, d):
    """Study year x corrected survey number -> date text."""
    return SV.survey_date_matrix(numbers(spark, d))


@register("k3_sample_surveys", V.ctes(SQL_NUM, f"""
grid AS (SELECT CAST(y AS INTEGER) AS study_year, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS cor_survey_num
         FROM (SELECT unnest(generate_series(min(study_year), max(study_year))) AS y FROM numbers)),
picked AS (SELECT study_year, cor_survey_num FROM (
             SELECT *, row_number() OVER (PARTITION BY study_year ORDER BY
                 (CAST(study_year AS BIGINT) * 2654435761 + CAST(cor_survey_num AS BIGINT) * 40503
                  + {SAMPLE_SEED} * 97) % 1000003, cor_survey_num) AS r FROM grid) WHERE r <= 3)""") + """
SELECT p.study_year, p.cor_survey_num, n.visit_date, n.study_day, n.survey_num, n.survey_period
FROM picked p JOIN numbers n ON p.study_year = n.study_year AND p.cor_survey_num = n.cor_survey_num""")
def k3_sample_surveys(spark, d):
    """K3: three of the four survey slots per year, drawn by a seeded hash, joined to the numbers."""
    return SV.sample_surveys(numbers(spark, d), 3, SAMPLE_SEED)


@register("a19_between_survey_variation", V.ctes(SQL_NUM) + """
SELECT study_year, alpha_code, round_even(avg(bay_total), 6) AS mean_total,
       round_even(stddev_samp(bay_total), 6) AS sd_total, count(*) AS num_surveys
FROM st GROUP BY study_year, alpha_code""")
def a19_between_survey_variation(spark, d):
    """Per (year, code) mean, sd and count of per-survey totals."""
    r = SV.between_survey_variation(obs_num(spark, d))
    return r.select("study_year", "alpha_code", r6("mean_total").alias("mean_total"),
                    r6("sd_total").alias("sd_total"), "num_surveys")


@register("a21_bay_mean_by_taxon", V.ctes(SQL_NUM) + """
SELECT study_year, alpha_code, round_even(avg(bay_total), 6) AS mean_bay_survey_count
FROM st GROUP BY study_year, alpha_code""")
def a21_bay_mean_by_taxon(spark, d):
    """Per (year, code) mean of per-survey totals."""
    r = SV.bay_mean_by_taxon(obs_num(spark, d))
    return r.withColumn("mean_bay_survey_count", r6("mean_bay_survey_count"))


SQL_EFFORT = SQL_NUM + f""",
eff AS (SELECT study_year, alpha_code, 'all' AS which_surveys, {strict('avg', 'bay_total')} AS m FROM st GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '3', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 4 GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '2', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 3 GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '1', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 2 GROUP BY 1, 2),
spy AS (SELECT study_year, max(survey_num) AS survey_num FROM numbers GROUP BY study_year)"""


def effort(spark, d):
    return SV.effort_subsets(obs_num(spark, d))


@register("a22_effort_subsets", V.ctes(SQL_EFFORT) + """
SELECT study_year, alpha_code, which_surveys, round_even(m, 6) AS mean_bay_survey_count FROM eff""")
def a22_effort_subsets(spark, d):
    """A21 on all surveys and on the first 3, 2, 1, stacked (one pass)."""
    r = effort(spark, d)
    return r.withColumn("mean_bay_survey_count", r6("mean_bay_survey_count"))


@register("a23_surveys_per_year", V.ctes(SQL_EFFORT) + "\nSELECT * FROM spy")
def a23_surveys_per_year(spark, d):
    """Number of surveys (largest survey number) per study year."""
    return SV.surveys_per_year(numbers(spark, d))


@register("a24_effort_comparison", V.ctes(SQL_EFFORT) + f"""
SELECT s.study_year, e.which_surveys, round_even(e.total_birds, 6) AS total_birds, s.survey_num
FROM (SELECT study_year, which_surveys, {strict('sum', 'm')} AS total_birds FROM eff GROUP BY 1, 2) e
RIGHT JOIN spy s ON e.study_year IS NOT DISTINCT FROM s.study_year""")
def a24_effort_comparison(spark, d):
    """Summed means per (year, subset) with the year's number of surveys (right join)."""
    r = SV.effort_comparison(effort(spark, d), SV.surveys_per_year(numbers(spark, d)))
    return r.withColumn("total_birds", r6("total_birds"))


# Whole-table variants: every date of the table is a survey (years with more than
# four dates get no corrected number, so the subsets reduce to "all").
SQL_EFFORT_ALL = SQL_NUM_ALL + f""",
eff AS (SELECT study_year, alpha_code, 'all' AS which_surveys, {strict('avg', 'bay_total')} AS m FROM st GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '3', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 4 GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '2', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 3 GROUP BY 1, 2
        UNION ALL SELECT study_year, alpha_code, '1', {strict('avg', 'bay_total')} FROM st WHERE cor_survey_num < 2 GROUP BY 1, 2),
spy AS (SELECT study_year, max(survey_num) AS survey_num FROM numbers GROUP BY study_year)"""


def numbers_all(spark, d):
    return SV.survey_numbers(with_study_day(V.obs(spark, d)))


def obs_num_all(spark, d):
    o = with_study_day(V.obs(spark, d))
    return SV.attach_survey_numbers(o, SV.survey_numbers(o))


@register("a19_between_survey_variation_all_dates", V.ctes(SQL_NUM_ALL) + """
SELECT study_year, alpha_code, round_even(avg(bay_total), 6) AS mean_total,
       round_even(stddev_samp(bay_total), 6) AS sd_total, count(*) AS num_surveys
FROM st GROUP BY study_year, alpha_code""")
def a19_between_survey_variation_all_dates(spark, d):
    """A19 on every date of the table."""
    r = SV.between_survey_variation(obs_num_all(spark, d))
    return r.select("study_year", "alpha_code", r6("mean_total").alias("mean_total"),
                    r6("sd_total").alias("sd_total"), "num_surveys")


@register("a22_effort_subsets_all_dates", V.ctes(SQL_EFFORT_ALL) + """
SELECT study_year, alpha_code, which_surveys, round_even(m, 6) AS mean_bay_survey_count FROM eff""")
def a22_effort_subsets_all_dates(spark, d):
    """A22 on every date of the table."""
    r = SV.effort_subsets(obs_num_all(spark, d))
    return r.withColumn("mean_bay_survey_count", r6("mean_bay_survey_count"))


@register("a24_effort_comparison_all_dates", V.ctes(SQL_EFFORT_ALL) + f"""
SELECT s.study_year, e.which_surveys, round_even(e.total_birds, 6) AS total_birds, s.survey_num
FROM (SELECT study_year, which_surveys, {strict('sum', 'm')} AS total_birds FROM eff GROUP BY 1, 2) e
RIGHT JOIN spy s ON e.study_year IS NOT DISTINCT FROM s.study_year""")
def a24_effort_comparison_all_dates(spark, d):
    """A23 + A24 on every date of the table."""
    r = SV.effort_comparison(SV.effort_subsets(obs_num_all(spark, d)), SV.surveys_per_year(numbers_all(spark, d)))
    return r.withColumn("total_birds", r6("total_birds"))


@register("r17_survey_date_matrix_all_dates", V.ctes(SQL_NUM_ALL) + "\nSELECT study_year, " + _DATE_CELLS
          + " FROM numbers GROUP BY study_year")
def r17_survey_date_matrix_all_dates(spark, d):
    """R17 on every date of the table."""
    return SV.survey_date_matrix(numbers_all(spark, d))
