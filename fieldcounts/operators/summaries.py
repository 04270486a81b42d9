"""Plain aggregations over the analysis table.

Each operator is ``DataFrame -> DataFrame`` with no action inside.  Sums
are strict (a group with a missing count has a missing sum, as in R);
groups are aggregated map-side first, so a hot key costs one partial
aggregate per task, not one giant task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import (mean_rounded, natural_join, ratio_rounded, round_half_even_ratio, strict_avg,
                                  strict_max, strict_min, strict_sum)
from ..functions.calendar import season as season_expr
from .selection import medians


# A2
def taxon_survey_total(obs: DataFrame, code: str = "alpha_code", year: str = "study_year",
                       date: str = "visit_date", value: str = "section_final") -> DataFrame:
    """(code, study year, date) -> baywide total of the survey."""
    return obs.groupBy(code, year, date).agg(strict_sum(value).alias("spp_survey_tot"))


# A3
def taxon_annual_mean(obs: DataFrame, code: str = "alpha_code", year: str = "study_year",
                      date: str = "visit_date", value: str = "section_final") -> DataFrame:
    """Mean over a study year's surveys of the per-survey baywide total."""
    tot = taxon_survey_total(obs, code, year, date, value)
    return tot.groupBy(code, year).agg(strict_avg("spp_survey_tot").alias("spp_annual_mean"))


# A4
def taxon_section_annual_mean(obs: DataFrame, code: str = "alpha_code", year: str = "study_year",
                              section: str = "section", value: str = "section_final") -> DataFrame:
    return obs.groupBy(code, year, section).agg(strict_avg(value).alias("spp_section_annual_mean"))


# A5
def years_detected(obs: DataFrame, code: str = "alpha_code", year: str = "study_year",
                   value: str = "section_final") -> DataFrame:
    """Number of study years in which the code was counted above zero (a missing year counts as one)."""
    return (obs.filter(F.col(value) > 0).groupBy(code)
            .agg((F.countDistinct(year) + F.max(F.col(year).isNull().cast("long"))).alias("num_years_detected")))


def years_recorded(yearly: DataFrame, code: str = "alpha_code") -> DataFrame:
    """Report variant of A5: rows per code of a yearly table (zeros included)."""
    return yearly.groupBy(code).agg(F.count(F.lit(1)).alias("num_year_detected"))


# A6
def baywide_counts(obs: DataFrame, year: str = "study_year", date: str = "visit_date",
                   code: str = "alpha_code", value: str = "section_final",
                   all_label: str = "all", carry: Sequence[str] = ()) -> DataFrame:
    """Per-survey totals for every code and for all codes together, one pass.

    The records are aggregated once per (year, date, code); these rows are the
    codes' totals, and their sums by date the total of all codes (both read one
    exchange).  ``carry`` names columns that depend on the date only (such as
    the survey number); they ride along as keys.
    """
    keys = [year, date, *carry]
    per = obs.groupBy(*keys, code).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"),
                                       F.count(F.lit(1)).alias("_rows"))
    whole = per.groupBy(*keys).agg(F.when(F.sum("_n") == F.sum("_rows"), F.sum("_sum")).alias("baywide_count"))
    each = per.select(*keys, code, F.when(F.col("_n") == F.col("_rows"), F.col("_sum")).alias("baywide_count"))
    return each.unionByName(whole.select(*keys, F.lit(all_label).alias(code), "baywide_count"))


# A7
def first_survey_extract(baywide: DataFrame, survey: str = "survey_num") -> DataFrame:
    return baywide.filter(F.col(survey) == 1).drop(survey)


# A8
def season_mean_median(baywide: DataFrame, year: str = "study_year", code: str = "alpha_code",
                       value: str = "baywide_count") -> DataFrame:
    """Mean and exact median of per-survey totals (the median by selection: no task holds a group's values)."""
    means = baywide.groupBy(year, code).agg(
        strict_avg(value).alias("mean_abund"), (F.count(value) == F.count(F.lit(1))).alias("__whole"))
    return natural_join(means, medians(baywide, [year, code], value, "__med"), [year, code], "left").select(
        year, code, "mean_abund", F.when(F.col("__whole"), F.col("__med")).alias("med_abund"))


# A9
def all_taxa_annual_mean(obs: DataFrame, year: str = "study_year", date: str = "visit_date",
                         value: str = "section_final") -> DataFrame:
    tot = obs.groupBy(year, date).agg(strict_sum(value).alias("baywide_count"))
    return tot.groupBy(year).agg(strict_avg("baywide_count").alias("all_taxa"))


# A12
def taxon_survey_season_total(obs: DataFrame, code: str = "alpha_code", survey: str = "survey_num",
                              season: str = "season", value: str = "section_final") -> DataFrame:
    return obs.groupBy(code, survey, season).agg(strict_sum(value).alias("summed_num"))


# A13
def first_survey_totals(season_totals: DataFrame, by: str | None, code: str = "alpha_code",
                        survey: str = "survey_num", season: str = "season") -> DataFrame:
    """Survey-1 totals as they are (``by=None``), per season or per code."""
    first = season_totals.filter(F.col(survey) == 1)
    if by is None:
        return first.withColumnRenamed("summed_num", "total_count_spp_seas")
    key = season if by == "season" else code
    return first.groupBy(key).agg(strict_sum("summed_num").alias("total_count_seas"))


# A14
def taxon_season_summary(season_totals: DataFrame, code: str = "alpha_code",
                         season: str = "season") -> DataFrame:
    """(code, season) -> mean (half-even, 2 digits), max and min of survey totals."""
    return season_totals.groupBy(code, season).agg(
        mean_rounded(season_totals, "summed_num", 2).alias("mean_num"),
        strict_max("summed_num").alias("max_num"),
        strict_min("summed_num").alias("min_num"))


# A15
def taxon_summary(season_summary: DataFrame, code: str = "alpha_code") -> DataFrame:
    """Per code: mean, max and min of the rounded season means."""
    hundredths = F.round(F.col("mean_num") * 100).cast("long")
    return season_summary.groupBy(code).agg(
        F.when(F.count("mean_num") == F.count(F.lit(1)),
               round_half_even_ratio(F.sum(hundredths), F.count("mean_num") * 100, 2)).alias("spp_mean_num"),
        strict_max("mean_num").alias("spp_max_num"),
        strict_min("mean_num").alias("spp_min_num"))


# A16
def season_total_summary(obs: DataFrame, date: str = "visit_date", value: str = "section_final",
                         rule: int = 2) -> DataFrame:
    """Daily totals, season by ``rule``, then per season mean/max/min."""
    daily = obs.groupBy(date).agg(strict_sum(value).alias("summed_num"))
    daily = daily.withColumn("season", season_expr(date, rule))
    return daily.groupBy("season").agg(
        mean_rounded(daily, "summed_num", 2).alias("seas_mean_num"),
        strict_max("summed_num").alias("seas_max_num"),
        strict_min("summed_num").alias("seas_min_num"))


# A17
def section_mean_and_records(obs: DataFrame, code: str = "alpha_code", section: str = "section",
                             value: str = "section_final") -> DataFrame:
    """(code, section) -> mean rounded to 1 digit, and the number of records."""
    return obs.groupBy(code, section).agg(
        mean_rounded(obs, value, 1).alias("spp_section_mean"),
        F.count(F.lit(1)).alias("num_surveys_detected"))


# A18
def section_taxon_trend(obs: DataFrame, code: str = "alpha_code", section: str = "section",
                        year: str = "study_year", value: str = "section_final") -> DataFrame:
    """For every (code, section): yearly means and the rounded long-term mean.

    The long-term mean is recombined from yearly sums and counts over a
    window on the small yearly table, so the raw rows are shuffled once.
    """
    from pyspark.sql import Window
    yearly = obs.groupBy(code, section, year).agg(
        strict_avg(value).alias("spp_section_year_mean"),
        strict_sum(value).alias("_s"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(code, section)
    total_s, total_n, rows = F.sum("_s").over(w), F.sum("_n").over(w), F.sum("_rows").over(w)
    complete = (total_n == rows) & (F.count("_s").over(w) == F.count(F.lit(1)).over(w))
    return yearly.select(
        code, section, year, "spp_section_year_mean",
        F.when(complete, ratio_rounded(total_s, total_n, obs.schema[value].dataType, 1))
        .alias("spp_section_mean"))


# A25
def value_summary(records: DataFrame, key: str = "species", value: str = "count") -> DataFrame:
    """Per key: max, min, mean (1 digit, half-even), n."""
    return records.groupBy(key).agg(
        strict_max(value).alias("max_count"),
        strict_min(value).alias("min_count"),
        mean_rounded(records, value, 1).alias("mean_count"),
        F.count(F.lit(1)).alias("num_records"))


# A20
def day_total(obs: DataFrame, year: str = "study_year", day: str = "study_day",
              value: str = "section_final") -> DataFrame:
    return obs.groupBy(year, day).agg(strict_sum(value).alias("bay_total"))


# R18
def totals_by_type_matrix(raw: DataFrame, types: Sequence[str], date: str = "visit_date",
                          kind: str = "survey_type", value: str = "section_final") -> DataFrame:
    """Calendar year x survey type totals, one column per type, and ``unlisted`` for all other types together."""
    listed = F.col(kind).isin(list(types))
    label = F.when(listed, F.col(kind)).otherwise("unlisted")
    per = raw.withColumn("year", F.year(date)).withColumn("__kind", label)
    return per.groupBy("year").pivot("__kind", [*types, "unlisted"]).agg(strict_sum(value))
