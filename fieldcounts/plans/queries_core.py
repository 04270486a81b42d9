"""Bound queries: calendar, aggregates, ranks and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import with_season, with_study_day, with_survey_period
from ..functions.nullsafe import strict_sum as strict_sum_of
from ..operators import reshape as RS
from ..operators import shares as SH
from ..operators import summaries as S
from ..operators import taxa as TX
from ..operators import smooth as SM
from ..operators import trends as TR
from . import sqlcal as C
from . import views as V
from .catalog import r6, register
from .sqltext import rhe, strict, strict_sum

OBS_CAL = V.SQL_OBS + ",\n" + C.with_study_day("obs", "obs_cal")


def obs_cal(spark, d):
    return with_study_day(V.obs(spark, d))


# ------------------------------------------------------------ calendar
@register("f1_with_study_day", V.ctes(OBS_CAL) + """
SELECT visit_date, year_day, study_year, study_day, count(*) AS n_records
FROM obs_cal GROUP BY visit_date, year_day, study_year, study_day""")
def f1_with_study_day(spark, d):
    """F1 on every record, reported per date (year day, study year, study day)."""
    return (obs_cal(spark, d).groupBy("visit_date", "year_day", "study_year", "study_day")
            .agg(F.count(F.lit(1)).alias("n_records")))


@register("f1_study_day_events", V.ctes(V.SQL_EVENTS_VALUES) + f"""
SELECT visit_date, CAST(dayofyear(visit_date) AS INTEGER) AS year_day, {C.study_year()} AS study_year,
       {C.study_day()} AS study_day, count(*) AS n_records
FROM events_values GROUP BY ALL""")
def f1_study_day_events(spark, d):
    """F1 on dates outside the 1989-2020 lookup: study day is NULL."""
    ev = with_study_day(V.events_values(spark, d))
    return ev.groupBy("visit_date", "year_day", "study_year", "study_day").agg(
        F.count(F.lit(1)).alias("n_records"))


@register("f2_with_season", V.ctes(V.SQL_OBS) + f"""
SELECT visit_date, {C.season(rule=1)} AS season_rule1, {C.season(rule=2)} AS season_rule2,
       CAST(sum(section_final) AS BIGINT) AS total
FROM obs GROUP BY visit_date""")
def f2_with_season(spark, d):
    """both season rules per date with the date's total."""
    o = with_season(with_season(V.obs(spark, d), rule=1, name="season_rule1"), rule=2, name="season_rule2")
    return o.groupBy("visit_date", "season_rule1", "season_rule2").agg(
        F.sum("section_final").alias("total"))


@register("f3_with_survey_period", V.ctes(V.SQL_OBS) + f"""
SELECT {C.survey_period()} AS survey_period, CAST(sum(section_final) AS BIGINT) AS total,
       count(DISTINCT visit_date) AS n_dates
FROM obs GROUP BY 1""")
def f3_with_survey_period(spark, d):
    """survey period per record, totals per period (NULL = no period)."""
    o = with_survey_period(V.obs(spark, d))
    return o.groupBy("survey_period").agg(F.sum("section_final").alias("total"),
                                          F.countDistinct("visit_date").alias("n_dates"))


# ---------------------------------------------------------- aggregates
@register("a2_taxon_survey_total", V.ctes(OBS_CAL) + f"""
SELECT alpha_code, study_year, visit_date, {strict_sum('section_final')} AS spp_survey_tot
FROM obs_cal GROUP BY alpha_code, study_year, visit_date""")
def a2_taxon_survey_total(spark, d):
    """A2: (code, study year, date) -> baywide total."""
    return S.taxon_survey_total(obs_cal(spark, d))


@register("a3_taxon_annual_mean", V.ctes(OBS_CAL, f"""
tot AS (SELECT alpha_code, study_year, visit_date, {strict_sum('section_final')} AS t
        FROM obs_cal GROUP BY alpha_code, study_year, visit_date)""") + f"""
SELECT alpha_code, study_year, round_even({strict('avg', 't')}, 6) AS spp_annual_mean
FROM tot GROUP BY alpha_code, study_year""")
def a3_taxon_annual_mean(spark, d):
    """A3: mean per study year of per-survey totals, by code."""
    r = S.taxon_annual_mean(obs_cal(spark, d))
    return r.withColumn("spp_annual_mean", r6("spp_annual_mean"))


@register("a4_taxon_section_annual_mean", V.ctes(OBS_CAL) + f"""
SELECT alpha_code, study_year, section, round_even({strict('avg', 'section_final')}, 6) AS spp_section_annual_mean
FROM obs_cal GROUP BY alpha_code, study_year, section""")
def a4_taxon_section_annual_mean(spark, d):
    """A4: (code, study year, section) -> mean of records."""
    r = S.taxon_section_annual_mean(obs_cal(spark, d))
    return r.withColumn("spp_section_annual_mean", r6("spp_section_annual_mean"))


@register("a5_years_detected", V.ctes(OBS_CAL) + """
SELECT alpha_code, count(DISTINCT study_year) + max(CAST(study_year IS NULL AS BIGINT)) AS num_years_detected
FROM obs_cal WHERE section_final > 0 GROUP BY alpha_code""")
def a5_years_detected(spark, d):
    """A5: number of study years with a count above zero, per code."""
    return S.years_detected(obs_cal(spark, d))


SQL_BW = OBS_CAL + f""",
bw AS (SELECT study_year, visit_date, alpha_code, {strict_sum('section_final')} AS baywide_count
       FROM obs_cal GROUP BY study_year, visit_date, alpha_code),
bw_all AS (SELECT study_year, visit_date, 'all' AS alpha_code, {strict_sum('section_final')} AS baywide_count
       FROM obs_cal GROUP BY study_year, visit_date),
bwu AS (SELECT * FROM bw UNION ALL SELECT * FROM bw_all),
sm AS (SELECT study_year, alpha_code, {strict('avg', 'baywide_count')} AS mean_abund,
              CASE WHEN count(baywide_count) = count(*) THEN median(baywide_count) END AS med_abund
       FROM bwu GROUP BY study_year, alpha_code)"""


def season_means(spark, d):
    return S.season_mean_median(S.baywide_counts(obs_cal(spark, d)))


@register("a6_baywide_counts", V.ctes(SQL_BW) + """
SELECT study_year, visit_date, alpha_code, baywide_count FROM bwu""")
def a6_baywide_counts(spark, d):
    """Per-survey totals per code plus the all-codes total, one grouping-sets pass."""
    return S.baywide_counts(obs_cal(spark, d))


@register("a7_first_survey_extract", V.ctes(OBS_CAL, f"""
b1 AS (SELECT study_year, visit_date, survey_num, alpha_code, {strict_sum('section_final')} AS baywide_count
       FROM obs_cal GROUP BY study_year, visit_date, survey_num, alpha_code
       UNION ALL
       SELECT study_year, visit_date, survey_num, 'all', {strict_sum('section_final')}
       FROM obs_cal GROUP BY study_year, visit_date, survey_num)""") + """
SELECT study_year, visit_date, alpha_code, baywide_count FROM b1 WHERE survey_num = 1""")
def a7_first_survey_extract(spark, d):
    """Survey-1 rows of A6 (the survey number rides along as a date-level key)."""
    return S.first_survey_extract(S.baywide_counts(obs_cal(spark, d), carry=["survey_num"]))


@register("a8_season_mean_median", V.ctes(SQL_BW) + """
SELECT study_year, alpha_code, round_even(mean_abund, 6) AS mean_abund, round_even(med_abund, 6) AS med_abund
FROM sm""")
def a8_season_mean_median(spark, d):
    """Mean and exact median of per-survey totals by (study year, code)."""
    r = season_means(spark, d)
    return r.select("study_year", "alpha_code", r6("mean_abund").alias("mean_abund"),
                    r6("med_abund").alias("med_abund"))


@register("a9_all_taxa_annual_mean", V.ctes(SQL_BW) + f"""
SELECT study_year, round_even({strict('avg', 'baywide_count')}, 6) AS all_taxa FROM bw_all GROUP BY study_year""")
def a9_all_taxa_annual_mean(spark, d):
    """Mean per study year of the all-codes survey totals."""
    r = S.all_taxa_annual_mean(obs_cal(spark, d))
    return r.withColumn("all_taxa", r6("all_taxa"))


SQL_RANK = SQL_BW + """,
ranked AS (SELECT study_year, alpha_code, mean_abund, med_abund,
                  CAST(row_number() OVER (PARTITION BY study_year ORDER BY mean_abund DESC NULLS LAST,
                                          alpha_code ASC NULLS LAST) AS INTEGER) AS abund_rank
           FROM sm WHERE alpha_code <> 'all')"""


@register("w1_abundance_rank", V.ctes(SQL_RANK) + """
SELECT study_year, alpha_code, round_even(mean_abund, 6) AS mean_abund, round_even(med_abund, 6) AS med_abund,
       abund_rank FROM ranked""")
def w1_abundance_rank(spark, d):
    """Rank of codes within a study year by mean survey total."""
    r = SH.abundance_rank(season_means(spark, d))
    return r.select("study_year", "alpha_code", r6("mean_abund").alias("mean_abund"),
                    r6("med_abund").alias("med_abund"), "abund_rank")


@register("a10_top5_abundance", V.ctes(SQL_RANK) + """
SELECT study_year, CASE WHEN abund_rank <= 5 THEN alpha_code ELSE 'all.others' END AS abund_rank_spp,
       round_even(sum(mean_abund), 6) AS abundance
FROM ranked GROUP BY 1, 2""")
def a10_top5_abundance(spark, d):
    """A10: top-5 codes per year keep their code, the rest become all.others; summed."""
    r = SH.top5_abundance(SH.abundance_rank(season_means(spark, d)))
    return r.withColumn("abundance", r6("abundance"))


@register("a10_top5_codes", V.ctes(SQL_RANK) + """
SELECT DISTINCT alpha_code AS abund_rank_spp FROM ranked WHERE abund_rank <= 5""")
def a10_top5_codes(spark, d):
    """A10: distinct codes that were among some year's five most abundant."""
    return SH.top_k_codes(SH.abundance_rank(season_means(spark, d)))


@register("k2_top5_per_year", V.ctes(SQL_RANK) + """
SELECT study_year, alpha_code, round_even(mean_abund, 6) AS mean_abund, abund_rank AS rank
FROM ranked WHERE abund_rank <= 5""")
def k2_top5_per_year(spark, d):
    """K2: five most abundant codes per study year (row_number filter)."""
    sm = season_means(spark, d).filter(F.col("alpha_code") != "all")
    r = SH.top_k_per_group(sm, ["study_year"], [F.col("mean_abund").desc_nulls_last(),
                                                 F.col("alpha_code").asc_nulls_last()], 5)
    return r.select("study_year", "alpha_code", r6("mean_abund").alias("mean_abund"), "rank")


SQL_CUM = SQL_BW + """,
tot AS (SELECT study_year, alpha_code, sum(mean_abund) AS total FROM sm WHERE alpha_code <> 'all'
        GROUP BY study_year, alpha_code),
cum AS (SELECT study_year, alpha_code, total,
          sum(total) OVER (PARTITION BY study_year ORDER BY total DESC NULLS LAST, alpha_code ASC NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumu_sum,
          sum(total) OVER (PARTITION BY study_year) AS year_sum FROM tot),
cum2 AS (SELECT *, CASE WHEN year_sum <> 0 THEN cumu_sum / year_sum END AS year_cum_prop,
                CASE WHEN year_sum <> 0 THEN total / year_sum END AS year_prop FROM cum),
thr AS (SELECT study_year, min(year_cum_prop) AS min_over90 FROM cum2 WHERE year_cum_prop >= 0.9
        GROUP BY study_year)"""


def cum_share(spark, d):
    return SH.cumulative_share(season_means(spark, d))


@register("w2_cumulative_share", V.ctes(SQL_CUM) + """
SELECT study_year, alpha_code, round_even(total, 6) AS total, round_even(cumu_sum, 6) AS cumu_sum,
       round_even(year_sum, 6) AS year_sum, round_even(year_cum_prop, 6) AS year_cum_prop,
       round_even(year_prop, 6) AS year_prop FROM cum2""")
def w2_cumulative_share(spark, d):
    """Running and total sums of mean abundance per year, shares and cumulative shares."""
    r = cum_share(spark, d)
    return r.select("study_year", "alpha_code", *[r6(c).alias(c) for c in
                    ["total", "cumu_sum", "year_sum", "year_cum_prop", "year_prop"]])


@register("w3_share_threshold", V.ctes(SQL_CUM) + """
SELECT study_year, round_even(min_over90, 6) AS min_over90 FROM thr""")
def w3_share_threshold(spark, d):
    """Per year the smallest cumulative share at or above 0.9."""
    r = SH.share_threshold(cum_share(spark, d))
    return r.withColumn("min_over90", r6("min_over90"))


# Test binding of A11 (the reference's bird names and DUCK do not occur here).
A11_ALWAYS_LUMPED = ["Brand#25"]
A11_NAME_ORDER = ["blue anvil 10", "blue anvil 2", "blue bolt 12", "blue gear 1", "Remaining spp."]


def _sql_list(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@register("a11_remaining_lump", V.ctes(SQL_CUM, V.SQL_TAXA, f"""
lump AS (SELECT c.study_year,
            CASE WHEN (c.year_cum_prop > t.min_over90 OR c.alpha_code IN ({_sql_list(A11_ALWAYS_LUMPED)}))
                 THEN 'Remaining spp'
                 WHEN NOT (c.year_cum_prop > t.min_over90 OR c.alpha_code IN ({_sql_list(A11_ALWAYS_LUMPED)}))
                 THEN c.alpha_code END AS alpha_code, c.total
         FROM cum2 c FULL JOIN thr t ON c.study_year = t.study_year)""") + f"""
SELECT g.study_year, g.alpha_code, round_even(g.total2, 6) AS total2,
       coalesce(x.common_name, 'Remaining spp.') AS common_name,
       CAST(CASE WHEN list_position([{_sql_list(A11_NAME_ORDER)}], coalesce(x.common_name, 'Remaining spp.')) > 0
            THEN list_position([{_sql_list(A11_NAME_ORDER)}], coalesce(x.common_name, 'Remaining spp.')) END
            AS INTEGER) AS common_name_order
FROM (SELECT study_year, alpha_code, sum(total) AS total2 FROM lump GROUP BY study_year, alpha_code) g
LEFT JOIN taxa x ON g.alpha_code = x.alpha_code""")
def a11_remaining_lump(spark, d):
    """A11 + F13: codes past the 90 % cumulative share lumped, names attached, fixed order."""
    cum = cum_share(spark, d)
    r = SH.remaining_lump(cum, SH.share_threshold(cum), V.taxa(spark, d), A11_NAME_ORDER,
                          always_lumped=A11_ALWAYS_LUMPED)
    return r.withColumn("total2", r6("total2"))


# Test binding of the report's recode and code sets (FIXTURES.md).
RECODE_MEMBERS = ["Brand#1", "Brand#3"]
RECODE_TO = "Brand#2"
SHARE_CUT = 0.061
USEFUL = ["Brand#4", "Brand#5"]
USELESS = ["Brand#6", "Brand#7", "Brand#13"]


def daily(spark, d):
    o = TX.recode_taxa(obs_cal(spark, d), RECODE_MEMBERS, RECODE_TO)
    return SH.daily_shares(o)


SQL_DAILY = OBS_CAL + f""",
rec AS (SELECT * REPLACE (CASE WHEN alpha_code IN ({_sql_list(RECODE_MEMBERS)}) THEN '{RECODE_TO}'
                          ELSE alpha_code END AS alpha_code) FROM obs_cal),
per AS (SELECT study_year, visit_date, alpha_code, {strict_sum('section_final')} AS baywide_count
        FROM rec GROUP BY study_year, visit_date, alpha_code),
dsh AS (SELECT *, CASE WHEN baywide_total_birds <> 0 THEN baywide_count / baywide_total_birds END
               AS date_spp_proportion_all
        FROM (SELECT *, CAST(sum(baywide_count) OVER (PARTITION BY study_year, visit_date) AS BIGINT)
                     AS baywide_total_birds FROM per)),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_year, visit_date
                  ORDER BY date_spp_proportion_all DESC NULLS LAST, alpha_code ASC NULLS LAST) AS INTEGER)
                  AS abund_rank FROM dsh),
ys AS (SELECT study_year, alpha_code, avg(date_spp_proportion_all) AS mean_proportion
       FROM dr GROUP BY study_year, alpha_code),
ay AS (SELECT alpha_code, avg(mean_proportion) AS mean_proportion FROM ys GROUP BY alpha_code)"""


def _cls(x, cut):
    return f"CASE WHEN {x} <= {cut} THEN 'less' WHEN {x} > {cut} THEN 'more' END"


@register("w4_daily_shares", V.ctes(SQL_DAILY) + """
SELECT study_year, visit_date, alpha_code, baywide_count, baywide_total_birds,
       round_even(date_spp_proportion_all, 6) AS date_spp_proportion_all, abund_rank FROM dr""")
def w4_daily_shares(spark, d):
    """W4 (after the F4 recode): per survey, each code's share of the day and its rank."""
    r = daily(spark, d)
    return r.withColumn("date_spp_proportion_all", r6("date_spp_proportion_all"))


@register("f4_recode_taxa", V.ctes(SQL_DAILY) + f"""
SELECT alpha_code, count(*) AS n_records, {strict_sum('section_final')} AS total FROM rec GROUP BY alpha_code""")
def f4_recode_taxa(spark, d):
    """codes replaced in place (no summing); records and totals per resulting code."""
    o = TX.recode_taxa(obs_cal(spark, d), RECODE_MEMBERS, RECODE_TO)
    return o.groupBy("alpha_code").agg(F.count(F.lit(1)).alias("n_records"),
                                       F.sum("section_final").alias("total"))


@register("g4_yearly_share", V.ctes(SQL_DAILY) + f"""
SELECT study_year, alpha_code, round_even(mean_proportion, 6) AS mean_proportion,
       {_cls('mean_proportion', SHARE_CUT)} AS prop_group FROM ys""")
def g4_yearly_share(spark, d):
    """G4 + F10: mean daily share per (study year, code), classed at 0.061."""
    r = SH.yearly_share(daily(spark, d), cut=SHARE_CUT)
    return r.withColumn("mean_proportion", r6("mean_proportion"))


@register("g4_all_year_share", V.ctes(SQL_DAILY) + f"""
SELECT alpha_code, round_even(mean_proportion, 6) AS mean_proportion,
       {_cls('mean_proportion', SHARE_CUT)} AS prop_group FROM ay""")
def g4_all_year_share(spark, d):
    """G4 + F10: mean over years of the yearly mean share, classed at 0.061."""
    r = SH.all_year_share(SH.yearly_share(daily(spark, d), cut=SHARE_CUT), cut=SHARE_CUT)
    return r.withColumn("mean_proportion", r6("mean_proportion"))


@register("f10_share_class_default", V.ctes(SQL_DAILY) + f"""
SELECT alpha_code, round_even(mean_proportion, 6) AS mean_proportion,
       {_cls('mean_proportion', 0.05)} AS prop_group FROM ay""")
def f10_share_class_default(spark, d):
    """F10 with the reference's 5 % cut (every code lands in 'more' on this data)."""
    r = SH.all_year_share(SH.yearly_share(daily(spark, d)))
    return r.withColumn("mean_proportion", r6("mean_proportion"))


SURVEY_YEAR_CUTS = (5, 6)


def _years_class_sql(x, cuts):
    lo, hi = cuts
    return (f"CASE WHEN {x} <= {lo} THEN 'low' WHEN {x} <= {hi} THEN 'middle' WHEN {x} > {hi} THEN 'high' END",
            f"CAST(CASE WHEN {x} <= {lo} THEN 1 WHEN {x} <= {hi} THEN 2 WHEN {x} > {hi} THEN 3 END AS INTEGER)")


_YC = _years_class_sql("num_year_detected", SURVEY_YEAR_CUTS)
SQL_NYD = SQL_DAILY + f""",
nyd AS (SELECT y.alpha_code, count(*) AS num_year_detected, any_value(x.common_name) AS common_name
        FROM ys y LEFT JOIN taxa x ON y.alpha_code = x.alpha_code GROUP BY y.alpha_code),
nyd2 AS (SELECT *, {_YC[0]} AS abund_group, {_YC[1]} AS abund_group_ord FROM nyd)"""


def num_years(spark, d):
    yearly = SH.yearly_share(daily(spark, d), cut=SHARE_CUT)
    r = TX.attach_taxonomy(S.years_recorded(yearly), V.taxa(spark, d), ["common_name"])
    return SH.years_class(r, cuts=SURVEY_YEAR_CUTS)


@register("a5_f11_years_class", V.ctes(V.SQL_TAXA, SQL_NYD) + """
SELECT alpha_code, num_year_detected, common_name, abund_group, abund_group_ord FROM nyd2""")
def a5_f11_years_class(spark, d):
    """A5 report variant + L1 + F11: years with any record per code, classed (cuts 5, 6)."""
    return num_years(spark, d)


@register("f12_detections_without_groups", V.ctes(V.SQL_TAXA, SQL_NYD) + f"""
SELECT alpha_code, num_year_detected, common_name, abund_group FROM nyd2
WHERE alpha_code NOT IN ({_sql_list(USELESS)}) AND alpha_code NOT IN ({_sql_list(USEFUL)})""")
def f12_detections_without_groups(spark, d):
    """years detected without either group list."""
    return SH.without_codes(num_years(spark, d), USELESS, USEFUL).select(
        "alpha_code", "num_year_detected", "common_name", "abund_group")


@register("f12_high_class_shares", V.ctes(V.SQL_TAXA, SQL_NYD) + f"""
SELECT a.alpha_code, round_even(a.mean_proportion, 6) AS mean_proportion, a.prop_group,
       x.common_name, round_even(a.mean_proportion * 100, 6) AS percent
FROM (SELECT *, {_cls('mean_proportion', SHARE_CUT)} AS prop_group FROM ay) a
LEFT JOIN taxa x ON a.alpha_code = x.alpha_code
WHERE a.alpha_code IN (SELECT alpha_code FROM nyd2 WHERE abund_group = 'high')
  AND a.alpha_code NOT IN ({_sql_list(USEFUL)})""")
def f12_high_class_shares(spark, d):
    """all-year shares of codes in the 'high' years class, useful groups removed, as percent."""
    yearly = SH.yearly_share(daily(spark, d), cut=SHARE_CUT)
    ay = SH.all_year_share(yearly, cut=SHARE_CUT)
    high = num_years(spark, d).filter(F.col("abund_group") == "high").select("alpha_code")
    r = SH.without_codes(ay.join(high, "alpha_code", "left_semi"), USEFUL)
    r = SH.percent(TX.attach_taxonomy(r, V.taxa(spark, d), ["common_name"]))
    return r.select("alpha_code", r6("mean_proportion").alias("mean_proportion"), "prop_group",
                    "common_name", r6("percent").alias("percent"))


def _yearly_subset_sql(where):
    return V.ctes(V.SQL_TAXA, SQL_NYD) + f"""
SELECT y.study_year, y.alpha_code, round_even(y.mean_proportion, 6) AS mean_proportion, x.common_name,
       round_even(y.mean_proportion * 100, 6) AS percent
FROM ys y LEFT JOIN taxa x ON y.alpha_code = x.alpha_code WHERE {where}"""


def _yearly_subset(spark, d, fn):
    yearly = SH.yearly_share(daily(spark, d), cut=SHARE_CUT)
    r = SH.percent(TX.attach_taxonomy(fn(yearly), V.taxa(spark, d), ["common_name"]))
    return r.select("study_year", "alpha_code", r6("mean_proportion").alias("mean_proportion"),
                    "common_name", r6("percent").alias("percent"))


@register("f12_more_class_yearly", _yearly_subset_sql(
    f"""y.alpha_code IN (SELECT alpha_code FROM ay WHERE {_cls('mean_proportion', SHARE_CUT)} = 'more')
        AND y.alpha_code NOT IN ({_sql_list(USELESS)})"""))
def f12_more_class_yearly(spark, d):
    """yearly shares of codes in the all-year 'more' class, useless groups removed."""
    def pick(yearly):
        more = (SH.all_year_share(yearly, cut=SHARE_CUT).filter(F.col("prop_group") == "more")
                .select("alpha_code"))
        return SH.without_codes(yearly.join(more, "alpha_code", "left_semi"), USELESS)
    return _yearly_subset(spark, d, pick)


@register("f12_useful_groups_yearly", _yearly_subset_sql(f"y.alpha_code IN ({_sql_list(USEFUL)})"))
def f12_useful_groups_yearly(spark, d):
    """yearly shares of the useful group codes."""
    return _yearly_subset(spark, d, lambda y: SH.with_codes(y, USEFUL))


@register("f12_useless_groups_yearly", _yearly_subset_sql(f"y.alpha_code IN ({_sql_list(USELESS)})"))
def f12_useless_groups_yearly(spark, d):
    """yearly shares of the useless group codes."""
    return _yearly_subset(spark, d, lambda y: SH.with_codes(y, USELESS))


@register("f12_high_class_count", V.ctes(V.SQL_TAXA, SQL_NYD) + """
SELECT count(*) AS n_high FROM nyd2 WHERE abund_group = 'high'""")
def f12_high_class_count(spark, d):
    """how many codes are in the 'high' years class."""
    return num_years(spark, d).filter(F.col("abund_group") == "high").agg(F.count(F.lit(1)).alias("n_high"))


W5_CODES = ["Brand#2", "Brand#3", "Brand#12"]


@register("w5_section_vs_bay", V.ctes(OBS_CAL, f"""
sec AS (SELECT study_year, visit_date, alpha_code, section, {strict_sum('section_final')} AS section_count
        FROM obs_cal WHERE alpha_code IN ({_sql_list(W5_CODES)})
        GROUP BY study_year, visit_date, alpha_code, section)""") + """
SELECT *, CAST(sum(section_count) OVER (PARTITION BY study_year, visit_date, alpha_code) AS BIGINT) AS baywide_count
FROM sec""")
def w5_section_vs_bay(spark, d):
    """Section totals beside the baywide total, for one code set."""
    return SH.section_vs_bay(obs_cal(spark, d), W5_CODES)


@register("w5_section_vs_bay_all", V.ctes(OBS_CAL, f"""
sec AS (SELECT study_year, visit_date, alpha_code, section, {strict_sum('section_final')} AS section_count
        FROM obs_cal GROUP BY study_year, visit_date, alpha_code, section)""") + """
SELECT *, CAST(sum(section_count) OVER (PARTITION BY study_year, visit_date, alpha_code) AS BIGINT) AS baywide_count
FROM sec""")
def w5_section_vs_bay_all(spark, d):
    """W5 for every code at once (the per-set outputs are filters of this)."""
    return SH.section_vs_bay(obs_cal(spark, d))


# ------------------------------------------------- season summaries
OBS_SEASON = V.SQL_OBS + f""",
obs_s AS (SELECT *, {C.season(rule=2)} AS season FROM obs),
sst AS (SELECT alpha_code, survey_num, season, {strict_sum('section_final')} AS summed_num
        FROM obs_s GROUP BY alpha_code, survey_num, season)"""


def season_totals(spark, d):
    return S.taxon_survey_season_total(with_season(V.obs(spark, d), rule=2))


@register("a12_taxon_survey_season_total", V.ctes(OBS_SEASON) + """
SELECT alpha_code, survey_num, season, summed_num FROM sst""")
def a12_taxon_survey_season_total(spark, d):
    """(code, survey number, season by rule 2) -> total."""
    return season_totals(spark, d)


@register("a13_first_survey_spp_season", V.ctes(OBS_SEASON) + """
SELECT alpha_code, survey_num, season, summed_num AS total_count_spp_seas FROM sst WHERE survey_num = 1""")
def a13_first_survey_spp_season(spark, d):
    """Survey-1 totals per (code, season)."""
    return S.first_survey_totals(season_totals(spark, d), None)


@register("a13_first_survey_by_season", V.ctes(OBS_SEASON) + f"""
SELECT season, {strict_sum('summed_num')} AS total_count_seas FROM sst WHERE survey_num = 1 GROUP BY season""")
def a13_first_survey_by_season(spark, d):
    """Survey-1 totals per season."""
    return S.first_survey_totals(season_totals(spark, d), "season")


@register("a13_first_survey_by_species", V.ctes(OBS_SEASON) + f"""
SELECT alpha_code, {strict_sum('summed_num')} AS total_count_seas FROM sst WHERE survey_num = 1
GROUP BY alpha_code""")
def a13_first_survey_by_species(spark, d):
    """Survey-1 totals per code."""
    return S.first_survey_totals(season_totals(spark, d), "species")


SQL_A14 = OBS_SEASON + f""",
a14 AS (SELECT alpha_code, season, {rhe('s', 'n', 2)} AS mean_num, max_num, min_num
        FROM (SELECT alpha_code, season, sum(summed_num) AS s, count(*) AS n, max(summed_num) AS max_num,
                     min(summed_num) AS min_num FROM sst GROUP BY alpha_code, season))"""


@register("a14_taxon_season_summary", V.ctes(SQL_A14) + """
SELECT alpha_code, season, mean_num, max_num, min_num FROM a14""")
def a14_taxon_season_summary(spark, d):
    """(code, season) -> mean (2 digits, half-even), max, min of survey totals."""
    return S.taxon_season_summary(season_totals(spark, d))


@register("a15_taxon_summary", V.ctes(SQL_A14) + f"""
SELECT alpha_code, {rhe('s', 'n * 100', 2)} AS spp_mean_num, spp_max_num, spp_min_num
FROM (SELECT alpha_code, sum(CAST(round(mean_num * 100) AS BIGINT)) AS s, count(*) AS n,
             max(mean_num) AS spp_max_num, min(mean_num) AS spp_min_num FROM a14 GROUP BY alpha_code)""")
def a15_taxon_summary(spark, d):
    """Per code, mean / max / min of the rounded season means."""
    return S.taxon_summary(S.taxon_season_summary(season_totals(spark, d)))


@register("a16_season_total_summary", V.ctes(V.SQL_OBS) + f"""
SELECT season, {rhe('s', 'n', 2)} AS seas_mean_num, seas_max_num, seas_min_num
FROM (SELECT {C.season('visit_date', 2)} AS season, sum(summed_num) AS s, count(*) AS n,
             max(summed_num) AS seas_max_num, min(summed_num) AS seas_min_num
      FROM (SELECT visit_date, {strict_sum('section_final')} AS summed_num FROM obs GROUP BY visit_date)
      GROUP BY 1)""")
def a16_season_total_summary(spark, d):
    """Daily totals -> season (rule 2) mean, max, min."""
    return S.season_total_summary(V.obs(spark, d))


@register("a17_section_mean_and_records", V.ctes(V.SQL_OBS) + f"""
SELECT alpha_code, section, {rhe('s', 'n', 1)} AS spp_section_mean, n AS num_surveys_detected
FROM (SELECT alpha_code, section, sum(section_final) AS s, count(*) AS n FROM obs GROUP BY alpha_code, section)""")
def a17_section_mean_and_records(spark, d):
    """(code, section) -> mean rounded to 1 digit, and record count."""
    return S.section_mean_and_records(V.obs(spark, d))


@register("a18_section_taxon_trend", V.ctes(OBS_CAL) + f"""
SELECT alpha_code, section, study_year, round_even(ym, 6) AS spp_section_year_mean,
       {rhe('sum(s) OVER (PARTITION BY alpha_code, section)', 'sum(n) OVER (PARTITION BY alpha_code, section)', 1)}
       AS spp_section_mean
FROM (SELECT alpha_code, section, study_year, avg(section_final) AS ym, sum(section_final) AS s, count(*) AS n
      FROM obs_cal GROUP BY alpha_code, section, study_year)""")
def a18_section_taxon_trend(spark, d):
    """A18 (batch form): yearly means and rounded long-term mean of every (code, section)."""
    r = S.section_taxon_trend(obs_cal(spark, d))
    return r.withColumn("spp_section_year_mean", r6("spp_section_year_mean"))


@register("a20_day_total", V.ctes(OBS_CAL) + f"""
SELECT study_year, study_day, {strict_sum('section_final')} AS bay_total FROM obs_cal
GROUP BY study_year, study_day""")
def a20_day_total(spark, d):
    """(study year, study day) -> total."""
    return S.day_total(obs_cal(spark, d))


@register("a25_value_summary", V.ctes(V.SQL_EVENTS_VALUES) + f"""
SELECT species, round_even(max_count, 6) AS max_count, round_even(min_count, 6) AS min_count,
       round_even(m, 1) AS mean_count, n AS num_records
FROM (SELECT species, max(count) AS max_count, min(count) AS min_count, avg(count) AS m, count(*) AS n
      FROM events_values GROUP BY species)""")
def a25_value_summary(spark, d):
    """Per species max, min, mean (1 digit) and records, on signed counts."""
    r = S.value_summary(V.events_values(spark, d))
    return r.select("species", r6("max_count").alias("max_count"), r6("min_count").alias("min_count"),
                    "mean_count", "num_records")


SURVEY_TYPES = ["A", "N", "R"]


@register("r18_totals_by_type_matrix", V.ctes(V.SQL_OBS) + "\nSELECT CAST(year(visit_date) AS INTEGER) AS year, "
          + ", ".join(f"CAST(sum(section_final) FILTER (WHERE survey_type = '{t}') AS BIGINT) AS {t}"
                      for t in SURVEY_TYPES)
          + ", CAST(sum(section_final) FILTER (WHERE survey_type IS NULL OR survey_type NOT IN ("
          + ", ".join(f"'{t}'" for t in SURVEY_TYPES) + ")) AS BIGINT) AS unlisted\nFROM obs GROUP BY 1")
def r18_totals_by_type_matrix(spark, d):
    """Calendar year x survey type totals, one column per type."""
    return S.totals_by_type_matrix(V.obs(spark, d), SURVEY_TYPES)


R19_CODE = "Brand#12"


@register("r19_mean_median_series", V.ctes(SQL_BW) + f"""
SELECT study_year, alpha_code, 'Mean' AS mean_median, round_even(mean_abund, 6) AS value FROM sm
WHERE alpha_code = '{R19_CODE}'
UNION ALL
SELECT study_year, alpha_code, 'Median', round_even(med_abund, 6) FROM sm WHERE alpha_code = '{R19_CODE}'""")
def r19_mean_median_series(spark, d):
    """One code's yearly mean and median as a long series labelled Mean / Median."""
    r = RS.mean_median_series(season_means(spark, d), R19_CODE)
    return r.withColumn("value", r6("value"))


# ---------------------------------------------------------------- taxa
LUMP_MEMBERS = ["Brand#1", "Brand#2", "Brand#3"]
LUMP_LABEL = "Brand#2"


@register("a1_lump_taxa", V.ctes(V.SQL_OBS, f"""
obs_a AS (SELECT {C.season()} AS season, visit_date, survey_num, section, alpha_code, section_final,
                 CAST(NULL AS VARCHAR) AS data_is FROM obs)""") + f"""
SELECT season, visit_date, survey_num, section, '{LUMP_LABEL}' AS alpha_code,
       {strict_sum('section_final')} AS section_final, 'lumped.brand2' AS data_is
FROM obs_a WHERE alpha_code IN ({_sql_list(LUMP_MEMBERS)}) GROUP BY season, visit_date, survey_num, section
UNION ALL
SELECT season, visit_date, survey_num, section, alpha_code, section_final, data_is FROM obs_a
WHERE alpha_code IS NULL OR alpha_code NOT IN ({_sql_list(LUMP_MEMBERS)})""")
def a1_lump_taxa(spark, d):
    """A1: member codes summed per (season, date, survey, section) into one label."""
    o = with_season(V.obs(spark, d)).withColumn("data_is", F.lit(None).cast("string"))
    return TX.lump_taxa(o, LUMP_MEMBERS, LUMP_LABEL, "lumped.brand2")


# stand-ins for the two lumping groups of the reference (three codes each)
LUMP_GROUPS = {"scaup": (TX.SCAUP_GROUP, ["Brand#11", "Brand#12", "Brand#13"]),
               "grebe": (TX.GREBE_GROUP, ["Brand#21", "Brand#22", "Brand#23"])}


@register("a1_lump_groups", V.ctes(V.SQL_OBS, f"""
obs_a AS (SELECT {C.season()} AS season, visit_date, survey_num, section, section_final,
                 CASE """ + " ".join(f"WHEN alpha_code = '{b}' THEN '{c}'" for codes, brands in LUMP_GROUPS.values()
                                     for c, b in zip(codes, brands)) + """ ELSE alpha_code END AS alpha_code FROM obs)""")
          + "\nUNION ALL\n".join(f"""
SELECT season, visit_date, survey_num, section, '{codes[-1]}' AS alpha_code, {strict_sum('section_final')} AS section_final,
       'lumped.{name}' AS data_is
FROM obs_a WHERE alpha_code IN ({_sql_list(codes)}) GROUP BY season, visit_date, survey_num, section"""
                                  for name, (codes, _) in LUMP_GROUPS.items()) + f"""
UNION ALL
SELECT season, visit_date, survey_num, section, alpha_code, section_final, NULL FROM obs_a
WHERE alpha_code IS NULL OR alpha_code NOT IN ({_sql_list([c for codes, _ in LUMP_GROUPS.values() for c in codes])})""")
def a1_lump_groups(spark, d):
    """A1 twice: the scaup group and the grebe group, each into its pooled code."""
    o = with_season(V.obs(spark, d)).withColumn("data_is", F.lit(None).cast("string"))
    names = {b: c for codes, brands in LUMP_GROUPS.values() for c, b in zip(codes, brands)}
    o = o.replace(names, subset=["alpha_code"])
    for name, (codes, _) in LUMP_GROUPS.items():
        o = TX.lump_taxa(o, codes, codes[-1], f"lumped.{name}")
    return o


@register("l1_attach_taxonomy", V.ctes(V.SQL_TAXA, SQL_BW) + """
SELECT s.study_year, s.alpha_code, round_even(s.mean_abund, 6) AS mean_abund, t.common_name, t.species,
       t.species_number
FROM sm s LEFT JOIN taxa t ON s.alpha_code = t.alpha_code""")
def l1_attach_taxonomy(spark, d):
    """L1: taxonomy attached to yearly means (unmatched codes and 'all' keep NULL names)."""
    r = TX.attach_taxonomy(season_means(spark, d), V.taxa(spark, d))
    return r.select("study_year", "alpha_code", r6("mean_abund").alias("mean_abund"), "common_name",
                    "species", "species_number")


@register("l2_translate_codes", V.ctes(V.SQL_TAXA, V.SQL_NEW_YEAR_COUNTS) + """
SELECT n.common_name, n.count, t.alpha_code
FROM new_year_counts n LEFT JOIN (SELECT common_name, min(alpha_code) AS alpha_code FROM taxa GROUP BY 1) t
  ON n.common_name = t.common_name""")
def l2_translate_codes(spark, d):
    """L2: common names of a tally translated to codes (no match -> NULL)."""
    return TX.translate_codes(V.new_year_counts(spark, d), V.taxa(spark, d), "common_name", "alpha_code")


# Test binding of F5: exact fixes and one regex fix on this data's names.
F5_FIXES = [("exact", "blue anvil 2", "blue anvil 10"), ("regex", "small.ring", "blue gear 1"),
            ("exact", "blue bolt 17", "blue bolt 12")]
F5_SEASON = 2021


def _f5_case():
    parts = []
    for kind, pat, new in F5_FIXES:
        cond = f"common_name = '{pat}'" if kind == "exact" else f"coalesce(regexp_matches(common_name, '{pat}'), false)"
        parts.append(f"WHEN {cond} THEN '{new}'")
    return "CASE " + " ".join(parts) + " ELSE common_name END"


SQL_F5 = V.SQL_TAXA + ",\n" + V.SQL_NEW_YEAR_COUNTS + f""",
f5 AS (SELECT n.count AS baywide_count, t.alpha_code, CAST({F5_SEASON} AS INTEGER) AS season
       FROM (SELECT {_f5_case()} AS common_name, count FROM new_year_counts) n
       LEFT JOIN (SELECT common_name, min(alpha_code) AS alpha_code FROM taxa GROUP BY 1) t
         ON n.common_name = t.common_name
       WHERE n.count IS NOT NULL)"""


def f5(spark, d):
    return TX.normalise_names(V.new_year_counts(spark, d), V.taxa(spark, d), F5_SEASON, F5_FIXES)


@register("f5_normalise_names", V.ctes(SQL_F5) + "\nSELECT baywide_count, alpha_code, season FROM f5")
def f5_normalise_names(spark, d):
    """ordered name fixes, translation to codes, season tag, NA counts dropped."""
    return f5(spark, d)


@register("u8_new_year_vs_history", V.ctes(SQL_F5, OBS_CAL, f"""
hist AS (SELECT study_year AS season, alpha_code, {strict_sum('section_final')} AS baywide_count
         FROM obs_cal WHERE survey_num = 1 GROUP BY study_year, visit_date, alpha_code)""") + """
SELECT alpha_code, season, baywide_count, 'history' AS source FROM hist
UNION ALL SELECT alpha_code, season, baywide_count, 'new' FROM f5""")
def u8_new_year_vs_history(spark, d):
    """U8: survey-1 history (A7) stacked with the new season's normalised tally."""
    hist = S.first_survey_extract(S.baywide_counts(obs_cal(spark, d), carry=["survey_num"]))
    hist = hist.filter(F.col("alpha_code") != "all").withColumnRenamed("study_year", "season")
    return TX.new_year_vs_history(hist, f5(spark, d))


@register("f6_detected_taxa", V.ctes(V.SQL_TAXA, V.SQL_OBS) + """
SELECT t.common_name, c.species, t.species_number
FROM (SELECT DISTINCT alpha_code AS species FROM obs WHERE section_final > 0) c
LEFT JOIN taxa t ON c.species = t.alpha_code""")
def f6_detected_taxa(spark, d):
    """codes counted above zero with common names and taxonomic order."""
    return TX.detected_taxa(V.obs(spark, d), V.taxa(spark, d))


@register("f7_taxon_list", V.ctes(V.SQL_TAXA, V.SQL_OBS) + """
SELECT DISTINCT o.alpha_code, t.common_name, t.species FROM obs o LEFT JOIN taxa t ON o.alpha_code = t.alpha_code""")
def f7_taxon_list(spark, d):
    """distinct (code, common name, scientific name) among records."""
    named = TX.attach_taxonomy(V.obs(spark, d), V.taxa(spark, d), ["common_name", "species"])
    return TX.taxon_list(named)


@register("f7_species_list", V.ctes(V.SQL_EVENTS_VALUES) + "\nSELECT DISTINCT species FROM events_values")
def f7_species_list(spark, d):
    """distinct species of the raw records."""
    return TX.taxon_list(V.events_values(spark, d), ["species"])


# -------------------------------------------------------------- trends
def _t975_sql(df_expr: str) -> str:
    lst = "[" + ", ".join(repr(v) for v in TR.T975) + "]"
    return (f"CASE WHEN {df_expr} BETWEEN 1 AND {TR.T_TABLE_MAX_DF} THEN {lst}[CAST({df_expr} AS INTEGER)] "
            f"WHEN {df_expr} > {TR.T_TABLE_MAX_DF} THEN "
            + " + ".join(f"{c!r} / pow({df_expr}, {k})" for k, c in enumerate(TR.T975_SERIES)) + " END")


@register("m1_linear_trend", V.ctes(SQL_A14) + f"""
SELECT alpha_code, round_even(b, 2) AS trend, round_even(b + half, 2) AS upper95ci, round_even(b - half, 2) AS lower95ci
FROM (SELECT *, {_t975_sql('n - 2')} * CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2) / sxx) END
             AS half
      FROM (SELECT alpha_code, CAST(regr_count(mean_num, season) AS BIGINT) AS n, regr_slope(mean_num, season) AS b,
                   regr_sxx(mean_num, season) AS sxx, regr_sxy(mean_num, season) AS sxy,
                   regr_syy(mean_num, season) AS syy
            FROM a14 GROUP BY alpha_code))""")
def m1_linear_trend(spark, d):
    """M1: per code, slope of the season mean on season with a 95 % interval (2 digits)."""
    return TR.linear_trend(S.taxon_season_summary(season_totals(spark, d)), ["alpha_code"], "season", "mean_num")


@register("m1_linear_trend_survey_totals", V.ctes(OBS_SEASON) + f"""
SELECT alpha_code, round_even(b, 2) AS trend, round_even(b + half, 2) AS upper95ci, round_even(b - half, 2) AS lower95ci
FROM (SELECT *, {_t975_sql('n - 2')} * CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2) / sxx) END
             AS half
      FROM (SELECT alpha_code, CAST(regr_count(summed_num, season) AS BIGINT) AS n, regr_slope(summed_num, season) AS b,
                   regr_sxx(summed_num, season) AS sxx, regr_sxy(summed_num, season) AS sxy,
                   regr_syy(summed_num, season) AS syy
            FROM sst GROUP BY alpha_code))""")
def m1_linear_trend_survey_totals(spark, d):
    """M1 on the survey totals of A12: per code, slope on season with a 95 % interval (2 digits)."""
    return TR.linear_trend(season_totals(spark, d), ["alpha_code"], "season", "summed_num")


@register("m2_quadratic_trend", V.ctes(OBS_CAL, f"""
dt AS (SELECT study_year, study_day, CAST({strict('sum', 'section_final')} AS DOUBLE) AS bay_total
       FROM obs_cal GROUP BY study_year, study_day),
c AS (SELECT study_year, CAST(study_day AS DOUBLE) - avg(CAST(study_day AS DOUBLE)) OVER (PARTITION BY study_year) AS u,
             avg(CAST(study_day AS DOUBLE)) OVER (PARTITION BY study_year) AS xb, bay_total AS y
      FROM dt WHERE study_day IS NOT NULL AND bay_total IS NOT NULL),
g AS (SELECT study_year, count(*) AS n, any_value(xb) AS xb, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4,
             sum(y) AS sy, sum(u*y) AS suy, sum(u*u*y) AS suuy FROM c GROUP BY study_year),
h AS (SELECT *, s4 - s2 * s2 / n AS q, suuy - sy * s2 / n AS r FROM g),
k AS (SELECT *, s2 * q - s3 * s3 AS det,
             n >= 3 AND abs(s2 * q - s3 * s3) > 1e-12 * greatest(abs(s2 * q), abs(s3 * s3), 1e-300) AS ok FROM h),
cc AS (SELECT *, (suy * q - s3 * r) / det AS c1, (s2 * r - s3 * suy) / det AS c2 FROM k)""") + """
SELECT study_year, n,
       round_even(CASE WHEN ok THEN (sy - c2 * s2) / n - c1 * xb + c2 * xb * xb END, 4) AS intercept,
       round_even(CASE WHEN ok THEN c1 - 2 * c2 * xb END, 6) AS linear,
       round_even(CASE WHEN ok THEN c2 END, 9) AS quadratic
FROM cc""")
def m2_quadratic_trend(spark, d):
    """M2: per study year, quadratic fit of day totals on study day."""
    r = TR.quadratic_trend(S.day_total(obs_cal(spark, d)), ["study_year"], "study_day", "bay_total")
    return r.select("study_year", "n", F.bround("intercept", 4).alias("intercept"),
                    F.bround("linear", 6).alias("linear"), F.bround("quadratic", 9).alias("quadratic"))


@register("m3_local_trend", V.ctes(SQL_BW, """
m3_in AS (SELECT alpha_code, CAST(study_year AS DOUBLE) AS x, mean_abund AS y FROM sm
          WHERE alpha_code <> 'all' AND mean_abund IS NOT NULL)""", TR.local_trend_sql("m3_in", "alpha_code", 0.75)) + """
SELECT alpha_code, x, round_even(y, 6) AS y, round_even(fitted, 6) AS fitted FROM m3""")
def m3_local_trend(spark, d):
    """M3: local quadratic smoother (span 0.75) of each code's yearly mean."""
    sm = season_means(spark, d).filter(F.col("alpha_code") != "all")
    r = TR.local_trend(sm, ["alpha_code"], "study_year", "mean_abund", span=0.75)
    return r.select("alpha_code", "x", r6("y").alias("y"), r6("fitted").alias("fitted"))


@register("m3_local_trend_all_taxa", V.ctes(SQL_BW, f"""
m3_in AS (SELECT 'all' AS series, CAST(study_year AS DOUBLE) AS x, {strict('avg', 'baywide_count')} AS y FROM bw_all
          GROUP BY study_year)""", TR.local_trend_sql("m3_in", "series", 1.1)) + """
SELECT series, x, round_even(y, 6) AS y, round_even(fitted, 6) AS fitted FROM m3""")
def m3_local_trend_all_taxa(spark, d):
    """M3 with span 1.1 on the all-codes yearly mean (one value per year)."""
    a = S.all_taxa_annual_mean(obs_cal(spark, d)).withColumn("series", F.lit("all"))
    r = TR.local_trend(a, ["series"], "study_year", "all_taxa", span=1.1)
    return r.select("series", "x", r6("y").alias("y"), r6("fitted").alias("fitted"))


@register("m3_smooth_curve", V.ctes(SQL_BW, """
m3_in AS (SELECT alpha_code, CAST(study_year AS DOUBLE) AS x, mean_abund AS y FROM sm
          WHERE alpha_code <> 'all' AND mean_abund IS NOT NULL)""").replace("WITH ", "WITH RECURSIVE ", 1)
          + "," + SM.smooth_curve_sql("m3_in", "alpha_code", 0.75) + """
SELECT alpha_code, round_even(x, 6) AS x, round_even(fitted, 5) AS fitted FROM curve""")
def m3_smooth_curve(spark, d):
    """M3 as drawn: each code's yearly mean as a curve of 80 points, fitted at the vertices of its cells."""
    sm = season_means(spark, d).filter(F.col("alpha_code") != "all")
    r = SM.smooth_curve(sm, ["alpha_code"], "study_year", "mean_abund", span=0.75)
    return r.select("alpha_code", r6("x").alias("x"), F.bround("fitted", 5).alias("fitted"))


@register("m3_smooth_curve_all_taxa", V.ctes(SQL_BW, f"""
m3_in AS (SELECT 'all' AS series, CAST(study_year AS DOUBLE) AS x, {strict('avg', 'baywide_count')} AS y FROM bw_all
          GROUP BY study_year)""").replace("WITH ", "WITH RECURSIVE ", 1)
          + "," + SM.smooth_curve_sql("m3_in", "series", 1.1) + """
SELECT series, round_even(x, 6) AS x, round_even(fitted, 5) AS fitted FROM curve""")
def m3_smooth_curve_all_taxa(spark, d):
    """M3 as drawn, with span 1.1, on the all-codes yearly mean."""
    a = S.all_taxa_annual_mean(obs_cal(spark, d)).withColumn("series", F.lit("all"))
    r = SM.smooth_curve(a, ["series"], "study_year", "all_taxa", span=1.1)
    return r.select("series", r6("x").alias("x"), F.bround("fitted", 5).alias("fitted"))


# ------------------------------------------------------------- sources
@register("s3_analysis_table_roundtrip", V.ctes(OBS_CAL) + """
SELECT visit_date, alpha_code, section, survey_type, survey_num, section_final, status, year_day, study_day,
       study_year FROM obs_cal""")
def s3_analysis_table_roundtrip(spark, d):
    """S3: the analysis table saved as Parquet partitioned by study year, read back whole."""
    from ..session import scratch_path
    from ..sources import files
    path = scratch_path(spark, "analysis")
    files.write_analysis_table(obs_cal(spark, d), path)
    return files.read_analysis_table(spark, path)


@register("s3_added_seasons", V.ctes(OBS_CAL) + f"""
SELECT study_year, count(*) AS n_rows, {strict_sum('section_final')} AS total, true AS whole
FROM obs_cal GROUP BY study_year""")
def s3_added_seasons(spark, d):
    """S3: a saved table whose even years are replaced by right rows later; each year against the manifest."""
    from ..session import scratch_path
    from ..sources import files
    path, obs = scratch_path(spark, "seasons"), obs_cal(spark, d)
    even = F.col("study_year") % 2 == 0
    files.write_seasons(obs.withColumn("section_final", F.when(even, 0).otherwise(F.col("section_final"))), path)
    files.write_seasons(obs.filter(even), path)
    found = files.read_seasons(spark, path).groupBy("study_year").agg(
        F.count(F.lit(1)).alias("n_rows"), strict_sum_of("section_final").alias("total"))
    return found.join(files.check_seasons(spark, path).select("study_year", "whole"), "study_year")


@register("s5_s2_csv_roundtrip", V.ctes(SQL_BW) + """
SELECT study_year, visit_date, alpha_code, baywide_count FROM bwu""")
def s5_s2_csv_roundtrip(spark, d):
    """S5 + S2: the A6 summary exported as CSV with a header and read back with its schema."""
    from ..session import scratch_path
    from ..sources import files
    path = scratch_path(spark, "summary")
    files.write_csv_table(S.baywide_counts(obs_cal(spark, d)), path)
    return files.read_csv_table(spark, path, "study_year int, visit_date date, alpha_code string, baywide_count long")


@register("k1_ordered_survey_totals", V.ctes(OBS_CAL) + f"""
SELECT alpha_code, study_year, visit_date, {strict_sum('section_final')} AS spp_survey_tot
FROM obs_cal GROUP BY alpha_code, study_year, visit_date
ORDER BY study_year ASC NULLS LAST, visit_date ASC NULLS LAST, spp_survey_tot DESC NULLS LAST, alpha_code""")
def k1_ordered_survey_totals(spark, d):
    """K1: survey totals in report order (year, date, descending total, code), NULLs last."""
    from ..functions.nullsafe import arrange
    return arrange(S.taxon_survey_total(obs_cal(spark, d)), "study_year", "visit_date", "-spp_survey_tot",
                   "alpha_code")


_K1_KEYS = ["study_year", "visit_date", "-spp_survey_tot", "alpha_code"]


@register("k1_numbered_survey_totals", V.ctes(OBS_CAL, f"""
k1 AS (SELECT alpha_code, study_year, visit_date, {strict_sum('section_final')} AS spp_survey_tot
       FROM obs_cal GROUP BY alpha_code, study_year, visit_date)""") + """
SELECT *, row_number() OVER (ORDER BY study_year ASC NULLS LAST, visit_date ASC NULLS LAST,
                             spp_survey_tot DESC NULLS LAST, alpha_code ASC NULLS LAST) AS position FROM k1""")
def k1_numbered_survey_totals(spark, d):
    """K1: the ordered export with each row's position in it, written as files in order and read back."""
    from ..session import scratch_path
    from ..sources import files
    path = scratch_path(spark, "ordered")
    files.write_ordered(S.taxon_survey_total(obs_cal(spark, d)), path, _K1_KEYS)
    return files.read_ordered(spark, path)


W5_SETS = [["Brand#2", "Brand#3"], ["Brand#12"], ["Brand#2", "Brand#22"]]


@register("w5_section_vs_bay_by_set", V.ctes(OBS_CAL, f"""
sec AS (SELECT study_year, visit_date, alpha_code, section, {strict_sum('section_final')} AS section_count
        FROM obs_cal GROUP BY study_year, visit_date, alpha_code, section),
secb AS (SELECT *, CAST(sum(section_count) OVER (PARTITION BY study_year, visit_date, alpha_code) AS BIGINT)
                AS baywide_count FROM sec)""") + "\n" + "\nUNION ALL\n".join(
    f"SELECT *, '{','.join(s)}' AS code_set FROM secb WHERE alpha_code IN ({_sql_list(s)})" for s in W5_SETS))
def w5_section_vs_bay_by_set(spark, d):
    """W5 over several (overlapping) code sets in one pass, labelled by set."""
    return SH.section_vs_bay_by_set(obs_cal(spark, d), W5_SETS)
