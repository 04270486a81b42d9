"""Ranks, shares and cumulative shares.

Windows run on tables already aggregated to one row per (year, date, code)
or (year, code), so a window partition holds at most one row per taxon; the
raw rows are reduced map-side before the first shuffle.  Ties are broken by
the code, which reproduces R's stable sort after a grouped summary.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import if_else, in_set, natural_join, not_in_set, safe_divide, strict_avg, strict_sum


# The code sets of the section-versus-bay check, in report order.
SECTION_CHECK_SETS = [["GRSC", "SCAUP"], ["DCCO", "BRAC"], ["BUFF"], ["SUSC"], ["RUDU"], ["HOGR", "EAGR", "HEGR"],
                      ["BLBR"], ["AMCO"], ["WEGR"], ["AMWI"]]


def _strict_over(agg, c: str, w) -> F.Column:
    """Window aggregate that is NULL when any value in the frame is NULL (R without na.rm)."""
    return F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), agg(c).over(w))


# W1
def abundance_rank(season_means: DataFrame, year: str = "study_year", code: str = "alpha_code",
                   value: str = "mean_abund", all_label: str = "all") -> DataFrame:
    """Rank codes within a year by descending mean ("all" removed)."""
    w = Window.partitionBy(year).orderBy(F.col(value).desc_nulls_last(), F.col(code).asc_nulls_last())
    return (season_means.filter(F.col(code) != all_label)
            .withColumn("abund_rank", F.row_number().over(w)))


# A10 (row form)
def top_k_label(ranked: DataFrame, k: int = 5, code: str = "alpha_code",
                other: str = "all.others") -> DataFrame:
    return ranked.withColumn("abund_rank_spp", F.when(F.col("abund_rank") <= k, F.col(code))
                             .otherwise(F.lit(other)))


# A10
def top5_abundance(ranked: DataFrame, k: int = 5, year: str = "study_year", code: str = "alpha_code",
                   value: str = "mean_abund", other: str = "all.others") -> DataFrame:
    """Sum of means per (year, label): top-k codes keep their code, the rest are lumped."""
    lab = top_k_label(ranked, k, code, other)
    return lab.groupBy(year, "abund_rank_spp").agg(strict_sum(value).alias("abundance"))


def top_k_codes(ranked: DataFrame, k: int = 5, code: str = "alpha_code") -> DataFrame:
    """Distinct codes that were in some year's top k."""
    return ranked.filter(F.col("abund_rank") <= k).select(F.col(code).alias("abund_rank_spp")).distinct()


# K2
def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int,
                    rank_name: str = "rank") -> DataFrame:
    """Rows ranked 1..k in each group (a filter on row_number: WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)


# W2
def cumulative_share(season_means: DataFrame, year: str = "study_year", code: str = "alpha_code",
                     value: str = "mean_abund", all_label: str = "all") -> DataFrame:
    """Per year: each code's total, running total by descending total, shares."""
    tot = (season_means.filter(F.col(code) != all_label).groupBy(year, code)
           .agg(strict_sum(value).alias("total")))
    order = [F.col("total").desc_nulls_last(), F.col(code).asc_nulls_last()]
    run = Window.partitionBy(year).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(year)
    return (tot.withColumn("cumu_sum", _strict_over(F.sum, "total", run))
            .withColumn("year_sum", _strict_over(F.sum, "total", whole))
            .withColumn("year_cum_prop", safe_divide("cumu_sum", "year_sum"))
            .withColumn("year_prop", safe_divide("total", "year_sum")))


# W3
def share_threshold(cum: DataFrame, year: str = "study_year", cut: float = 0.9) -> DataFrame:
    """Per year, the smallest cumulative share at or above ``cut`` (one row per year)."""
    return (cum.filter(F.col("year_cum_prop") >= cut).groupBy(year)
            .agg(F.min("year_cum_prop").alias("min_over90")))


# A11 + F13
def remaining_lump(cum: DataFrame, threshold: DataFrame, taxa: DataFrame, name_order: Sequence[str],
                   year: str = "study_year", code: str = "alpha_code",
                   always_lumped: Sequence[str] = ("DUCK",), label: str = "Remaining spp",
                   name_label: str = "Remaining spp.") -> DataFrame:
    """Codes past the share threshold (or always lumped) become one label; names attached."""
    j = natural_join(cum, threshold, [year], "full")
    lumped = if_else((F.col("year_cum_prop") > F.col("min_over90")) | in_set(code, always_lumped),
                     F.lit(label), F.col(code))
    g = j.withColumn("alpha_code2", lumped).groupBy(year, "alpha_code2").agg(strict_sum("total").alias("total2"))
    g = g.withColumnRenamed("alpha_code2", code)
    named = natural_join(g, taxa.select(code, "common_name"), [code], "left")
    named = named.withColumn("common_name", F.coalesce("common_name", F.lit(name_label)))
    return fixed_category_order(named, "common_name", name_order)


def fixed_category_order(df: DataFrame, col: str, levels: Sequence[str], name: str | None = None) -> DataFrame:
    """ordinal of ``col`` in ``levels`` (1-based), NULL when not listed."""
    name = name or f"{col}_order"
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(col))
    return df.withColumn(name, F.when(pos > 0, pos.cast("int")))


# W4
def daily_shares(obs: DataFrame, year: str = "study_year", date: str = "visit_date",
                 code: str = "alpha_code", value: str = "section_final") -> DataFrame:
    """Per survey: each code's total, the day total, the share and the rank by share."""
    per = obs.groupBy(year, date, code).agg(strict_sum(value).alias("baywide_count"))
    day = Window.partitionBy(year, date)
    rank_w = day.orderBy(F.col("date_spp_proportion_all").desc_nulls_last(), F.col(code).asc_nulls_last())
    return (per.withColumn("baywide_total_birds", _strict_over(F.sum, "baywide_count", day))
            .withColumn("date_spp_proportion_all", safe_divide("baywide_count", "baywide_total_birds"))
            .withColumn("abund_rank", F.row_number().over(rank_w)))


# F10
def share_class(df: DataFrame, value: str = "mean_proportion", cut: float = 0.05,
                name: str = "prop_group") -> DataFrame:
    """Right-closed cut: (-Inf, cut] -> less, (cut, Inf) -> more."""
    v = F.col(value)
    return df.withColumn(name, F.when(v <= cut, "less").when(v > cut, "more"))


# F11
def years_class(df: DataFrame, value: str = "num_year_detected", cuts: tuple = (10, 20),
                name: str = "abund_group") -> DataFrame:
    """Right-closed cuts at ``cuts`` -> low / middle / high, with an ordinal."""
    v = F.col(value)
    lo, hi = cuts
    lab = F.when(v <= lo, "low").when(v <= hi, "middle").when(v > hi, "high")
    ordinal = F.when(v <= lo, 1).when(v <= hi, 2).when(v > hi, 3)
    return df.withColumn(name, lab).withColumn(f"{name}_ord", ordinal)


# G4
def yearly_share(daily: DataFrame, year: str = "study_year", code: str = "alpha_code",
                 cut: float = 0.05) -> DataFrame:
    """Mean daily share per (year, code), classed at ``cut``."""
    g = daily.groupBy(year, code).agg(strict_avg("date_spp_proportion_all").alias("mean_proportion"))
    return share_class(g, cut=cut)


def all_year_share(yearly: DataFrame, code: str = "alpha_code", cut: float = 0.05) -> DataFrame:
    """Mean over years of the yearly mean share, classed at ``cut``."""
    g = yearly.groupBy(code).agg(strict_avg("mean_proportion").alias("mean_proportion"))
    return share_class(g, cut=cut)


# W5
def section_vs_bay(obs: DataFrame, codes: Sequence[str] | None = None, year: str = "study_year",
                   date: str = "visit_date", code: str = "alpha_code", section: str = "section",
                   value: str = "section_final") -> DataFrame:
    """Section totals with the baywide total of the same survey and code."""
    src = obs if codes is None else obs.filter(in_set(code, codes))
    per = src.groupBy(year, date, code, section).agg(strict_sum(value).alias("section_count"))
    w = Window.partitionBy(year, date, code)
    return per.withColumn("baywide_count", _strict_over(F.sum, "section_count", w))


# F12 family
def without_codes(df: DataFrame, *code_sets: Sequence[str], code: str = "alpha_code") -> DataFrame:
    cond = F.lit(True)
    for s in code_sets:
        cond = cond & not_in_set(code, s)
    return df.filter(cond)


def with_codes(df: DataFrame, codes: Sequence[str], code: str = "alpha_code") -> DataFrame:
    return df.filter(in_set(code, codes))


def percent(df: DataFrame, value: str = "mean_proportion", name: str = "percent") -> DataFrame:
    return df.withColumn(name, F.col(value) * 100)


def section_vs_bay_by_set(obs: DataFrame, code_sets: Sequence[Sequence[str]] = SECTION_CHECK_SETS,
                          code: str = "alpha_code", **kw) -> DataFrame:
    """W5 for several code sets at once, labelled by set ("GRSC,SCAUP", ...).

    Only codes of some set are aggregated, once; each row is then emitted once
    per set containing its code (sets may overlap).
    """
    wanted = sorted({c for s in code_sets for c in s})
    per = section_vs_bay(obs, wanted, code=code, **kw)
    sets = F.array(*[F.struct(F.lit(",".join(s)).alias("label"), F.array(*[F.lit(c) for c in s]).alias("codes"))
                     for s in code_sets])
    hits = F.filter(sets, lambda s: F.array_contains(s["codes"], F.col(code)))
    return per.withColumn("__set", F.explode(hits)).withColumn("code_set", F.col("__set.label")).drop("__set")
