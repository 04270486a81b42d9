"""Survey numbering and survey-effort comparisons (SURVEY §2.6 W6-W7, R17,
K3, A19-A24).

The survey calendar has one row per survey date, so windows over it are
small (a study year's dates per partition).  It is joined back to the
count table on (study year, date) as a broadcast: its size is bounded by
the number of days in the data's span, not by the number of records.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import survey_period
from ..functions.nullsafe import if_else, natural_join, strict_sum

# The reference's manual corrections.  Each entry sets or adds
# to the corrected number of one study year (optionally one survey number).
REFERENCE_OVERRIDES = [
    {"study_year": 2002, "add": 1},
    {"study_year": 2017, "survey_num": 2, "set": 3},
]


# W6
def survey_numbers(obs: DataFrame, overrides: Sequence[dict] = REFERENCE_OVERRIDES, year: str = "study_year",
                   date: str = "visit_date", day: str = "study_day") -> DataFrame:
    """Number the surveys of each study year and correct the numbers.

    Rules per year: 4 surveys -> their order; fewer than 4 and no survey in
    period 4 -> their order; fewer than 4 otherwise -> the survey period;
    more than 4 -> NULL.  A NULL period makes the period test unknown
    (strict max), so such a year falls through to the period.  Overrides
    apply last, in order.
    """
    cal = obs.select(year, date, day).distinct()
    by_date = Window.partitionBy(year).orderBy(F.col(date).asc_nulls_last())
    whole = Window.partitionBy(year)
    num = (cal.withColumn("survey_num", F.row_number().over(by_date))
           .withColumn("survey_period", survey_period(date)))
    mx = F.max("survey_num").over(whole)
    mp = F.when(F.count("survey_period").over(whole) == F.count(F.lit(1)).over(whole),
                F.max("survey_period").over(whole))
    cor = (F.when(mx == 4, F.col("survey_num"))
           .when((mx < 4) & (mp < 4), F.col("survey_num"))
           .when(mx < 4, F.col("survey_period")))
    for o in overrides:
        cond = F.col(year) == o["study_year"]
        if o.get("survey_num") is not None:
            cond = cond & (F.col("survey_num") == o["survey_num"])
        new = F.lit(o["set"]) if "set" in o else cor + o.get("add", 0)
        cor = if_else(cond, new, cor)
    return num.withColumn("cor_survey_num", cor.cast("int"))


def attach_survey_numbers(obs: DataFrame, numbers: DataFrame, year: str = "study_year",
                          date: str = "visit_date") -> DataFrame:
    """Corrected survey number of each record (the calendar comes from the same table).

    The calendar has one row per survey date (a study year is a function of
    the date), so at most 366 rows a year whatever the number of records: it
    is broadcast, and the count table is not shuffled for this join.
    """
    cal = F.broadcast(numbers.select(year, date, "cor_survey_num"))
    return natural_join(obs, cal, [year, date], "left")


# W7
def survey_intervals(numbers: DataFrame, year: str = "study_year", date: str = "visit_date",
                     day: str = "study_day") -> DataFrame:
    """Days since the previous survey when the corrected numbers are consecutive.

    Rows with a corrected number above 1, in (year, day) order; the previous
    row crosses year boundaries as in the reference.  The lag runs per year;
    each year's first row takes the last row of the closest earlier year
    from a table with one row per year.
    """
    rows = numbers.filter(F.col("cor_survey_num") > 1)
    order = [F.col(day).asc_nulls_last(), F.col(date).asc_nulls_last()]
    w = Window.partitionBy(year).orderBy(*order)
    back = Window.partitionBy(year).orderBy(F.col(day).desc_nulls_first(), F.col(date).desc_nulls_first())
    rows = (rows.withColumn("__rn", F.row_number().over(w))
            .withColumn("__pc", F.lag("cor_survey_num").over(w))
            .withColumn("__pd", F.lag(day).over(w))
            .withColumn("__rb", F.row_number().over(back)))
    # each year's last row (first in reverse order): one row per study year
    last = rows.filter(F.col("__rb") == 1).select(year, F.col("cor_survey_num").alias("__lc"),
                                                   F.col(day).alias("__ld"))
    # one row per study year: ordering it in one partition is cheap
    yw = Window.orderBy(F.col(year).asc_nulls_last())
    prev = last.select(year, F.lag("__lc").over(yw).alias("__yc"), F.lag("__ld").over(yw).alias("__yd"))
    j = natural_join(rows, prev, [year], "left")
    first = F.col("__rn") == 1
    pc = F.when(first, F.col("__yc")).otherwise(F.col("__pc"))
    pd = F.when(first, F.col("__yd")).otherwise(F.col("__pd"))
    interval = F.when(F.col("cor_survey_num") == pc + 1, F.col(day) - pd)
    return j.withColumn("survey_interval", interval).drop("__rn", "__rb", "__pc", "__pd", "__yc", "__yd")


# R17
def survey_date_matrix(numbers: DataFrame, slots: int = 4, year: str = "study_year",
                       date: str = "visit_date") -> DataFrame:
    """Study year x corrected survey number -> survey dates as text (s_1 .. s_4, s_over).

    A slot with several dates lists them all, in order, as "date, date";
    ``s_over`` lists "number: date" of numbers above ``slots`` and of numbers
    below 1, so no numbered survey is lost.
    """
    cor = F.col("cor_survey_num")
    inside = cor.between(1, slots)
    text = F.when(inside, F.col(date).cast("string")).otherwise(
        F.concat(cor.cast("string"), F.lit(": "), F.col(date).cast("string")))
    names = [*[f"s_{i}" for i in range(1, slots + 1)], "s_over"]
    n = numbers.select(year, F.when(inside, F.concat(F.lit("s_"), cor.cast("string")))
                       .when(cor.isNotNull(), "s_over").alias("__slot"), text.alias("__text"))
    # a study year's survey dates: a few short texts per cell
    wide = n.groupBy(year).pivot("__slot", names).agg(F.array_join(F.array_sort(F.collect_list("__text")), ", "))
    return wide.select(year, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in names])


# K3
def sample_surveys(numbers: DataFrame, k: int = 3, seed: int = 42, slots: int = 4,
                   year: str = "study_year") -> DataFrame:
    """Per study year, ``k`` of the slots 1..``slots`` at random (repeatable), joined to the numbers.

    ``slots`` is the sampling grid: surveys numbered above it cannot be drawn.

    Years span min..max of the calendar; the draw orders slots by an integer
    hash of (seed, year, slot), so the same seed gives the same sample.
    """
    span = numbers.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias(year))
    grid = years.select(year, F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("cor_survey_num"))
    h = F.pmod(F.col(year).cast("long") * 2654435761 + F.col("cor_survey_num").cast("long") * 40503
               + F.lit(seed).cast("long") * 97, F.lit(1000003))
    w = Window.partitionBy(year).orderBy(h, F.col("cor_survey_num"))
    picked = grid.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    return picked.join(numbers, [year, "cor_survey_num"], "inner")


def _survey_totals(obs_num: DataFrame, year: str, code: str, value: str) -> DataFrame:
    return obs_num.groupBy(year, code, "cor_survey_num").agg(strict_sum(value).alias("bay_total"))


# A19
def between_survey_variation(obs_num: DataFrame, year: str = "study_year", code: str = "alpha_code",
                             value: str = "section_final") -> DataFrame:
    """Per (year, code): mean, sd and number of the per-survey totals."""
    t = _survey_totals(obs_num, year, code, value)
    return t.groupBy(year, code).agg(
        F.when(F.count("bay_total") == F.count(F.lit(1)), F.avg("bay_total")).alias("mean_total"),
        F.when(F.count("bay_total") == F.count(F.lit(1)), F.stddev_samp("bay_total")).alias("sd_total"),
        F.count(F.lit(1)).alias("num_surveys"))


# A21
def bay_mean_by_taxon(obs_num: DataFrame, year: str = "study_year", code: str = "alpha_code",
                      value: str = "section_final") -> DataFrame:
    t = _survey_totals(obs_num, year, code, value)
    return t.groupBy(year, code).agg(
        F.when(F.count("bay_total") == F.count(F.lit(1)), F.avg("bay_total")).alias("mean_bay_survey_count"))


# The effort subsets (label, keep surveys numbered below).
EFFORT_SUBSETS = [("all", None), ("3", 4), ("2", 3), ("1", 2)]


# A22
def effort_subsets(obs_num: DataFrame, subsets: Sequence[tuple] = EFFORT_SUBSETS, year: str = "study_year",
                   code: str = "alpha_code", value: str = "section_final") -> DataFrame:
    """A21 over all surveys and over surveys numbered below 4, 3, 2, stacked, in one pass.

    Survey totals are computed once; each is then emitted under every label
    whose rule keeps it (a compacted label array plus explode), and averaged.
    """
    t = _survey_totals(obs_num, year, code, value)
    cor = F.col("cor_survey_num")
    labels = F.array_compact(F.array(*[F.lit(lab) if lim is None else F.when(cor < lim, F.lit(lab))
                                       for lab, lim in subsets]))
    e = t.select(year, code, "bay_total", F.explode(labels).alias("which_surveys"))
    return e.groupBy(year, code, "which_surveys").agg(
        F.when(F.count("bay_total") == F.count(F.lit(1)), F.avg("bay_total")).alias("mean_bay_survey_count"))


# A23
def surveys_per_year(numbers: DataFrame, year: str = "study_year") -> DataFrame:
    return numbers.groupBy(year).agg(F.max("survey_num").alias("survey_num"))


# A24
def effort_comparison(subsets: DataFrame, per_year: DataFrame, year: str = "study_year") -> DataFrame:
    """Summed means per (year, subset); a missing mean makes the sum missing, a missing year matches a missing year."""
    tot = subsets.groupBy(year, "which_surveys").agg(strict_sum("mean_bay_survey_count").alias("total_birds"))
    return natural_join(tot, per_year, [year], "right")
